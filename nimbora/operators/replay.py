"""Cycles told again: which are worth opening, how the risk moves from lead to lead, what is charted, where members part.

``events`` (region_id, init_date, valid_date, lead_time_days, p, band, dominant_variable) are scored events, ``values``
(the same keys, variable, predicted_value, observed_value, spread, bust_threshold) their variables. Every function treats
all cycles that it is given side by side, and none gathers more into a row than the leads of one region and variable or
the members of one chart. Events without p count for leads and regions alone. Ties go to the earlier lead, then to the
smaller region, then to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places to which means are rounded before they are compared.
PLACES = 9


def _highest(p: Column, *ties: str) -> Column:
    """An order whose least value is the highest ``p``; rows without it take no part."""
    return F.when(p.isNotNull(), F.struct((-p).alias("least"), *ties))


def _verified(values: DataFrame) -> DataFrame:
    """The rows whose outcome is known, with their error."""
    known = values.where("observed_value IS NOT NULL AND predicted_value IS NOT NULL")
    return known.withColumn("abs_err", F.abs(F.col("predicted_value") - F.col("observed_value")))


def cycle_list(events: DataFrame, values: DataFrame, angles: list[str], near: int = 3) -> DataFrame:
    """One row a cycle: leads, regions, the peak, how much of the cycle is verified and by how much the peak was missed.

    ``growth`` is the mean p beyond ``near`` days less that up to it (0 where one of them has none). The peak's miss is the
    mean error of its dominant variable in its region over verified leads, also as a multiple of that variable's
    threshold; null for an angle, whose errors are no plain differences, and where nothing is verified.
    """
    p, lead = F.col("p"), F.col("lead_time_days")
    whole = events.groupBy("init_date").agg(
        F.countDistinct("lead_time_days").alias("leads"),
        F.countDistinct("region_id").alias("n_regions"),
        F.min_by(F.struct("region_id", "lead_time_days", "p", "dominant_variable"), _highest(p, "lead_time_days", "region_id")).alias("peak"),
        F.coalesce(F.avg(F.when(lead > near, p)) - F.avg(F.when(lead <= near, p)), F.lit(0.0)).alias("growth"),
    )
    high = events.groupBy("init_date", "lead_time_days").agg(F.count(F.when(F.col("band") == "high", 1)).alias("n_high_at_peak"))
    known = _verified(values)
    leads = known.groupBy("init_date").agg(F.countDistinct("lead_time_days").alias("verified_leads"))
    misses = known.where(~F.col("variable").isin(angles)).groupBy("init_date", "region_id", "variable").agg(F.avg("abs_err").alias("peak_abs_err"), F.min("bust_threshold").alias("_cut"))
    flat = whole.select("init_date", "leads", "n_regions", F.col("peak.p").alias("peak_p"), F.col("peak.lead_time_days").alias("lead_time_days"), F.col("peak.region_id").alias("region_id"), F.col("peak.dominant_variable").alias("variable"), "growth")
    joined = flat.join(high, ["init_date", "lead_time_days"], "left").join(leads, "init_date", "left").join(misses, ["init_date", "region_id", "variable"], "left")
    return joined.select(
        "init_date", "leads", "n_regions", "peak_p", lead.alias("peak_lead"), F.col("region_id").alias("peak_region"), F.col("variable").alias("peak_variable"),
        F.coalesce("n_high_at_peak", F.lit(0)).alias("n_high_at_peak"), F.coalesce("verified_leads", F.lit(0)).alias("verified_leads"),
        "peak_abs_err", F.when(F.col("_cut") > 0, F.col("peak_abs_err") / F.col("_cut")).alias("peak_rel_err"), "growth",
    )


def ordered_cycles(cycles: DataFrame, tier: float = 0.1) -> DataFrame:
    """Adds each cycle's ``place``: coverage in tiers of the best one's, verified ones, the miss, the growth, the peak, then the newest.

    A cycle that shows few regions comes after one that shows many, whatever is known of it; nothing is left out.
    """
    best = F.greatest(F.max("n_regions").over(Window.partitionBy()), F.lit(1))
    keys = [
        F.bround(F.col("n_regions") / best / tier),
        F.col("verified_leads") > 0,
        F.bround(F.coalesce("peak_rel_err", F.lit(0.0)), 3),
        F.bround(F.greatest("growth", F.lit(0.0)), 3),
        F.bround(F.coalesce("peak_p", F.lit(0.0)), 3),
        F.col("verified_leads"),
        F.col("init_date"),
    ]
    keyed = cycles.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    place = F.row_number().over(Window.orderBy(*[F.desc(f"_k{i}") for i in range(len(keys))]))  # a row a cycle: a small table
    return keyed.withColumn("place", place).drop(*[f"_k{i}" for i in range(len(keys))])


def lead_story(events: DataFrame, least_rise: float = 0.05) -> DataFrame:
    """One row a cycle and lead: counts, mean p, the highest region, and what changed since the cycle's lead before.

    ``rising_region`` is the region whose p grew most since that lead, if by ``least_rise`` or more, with both its p's;
    ``new_driver`` the highest region's dominant variable where it is not the one of the lead before.
    """
    p = F.col("p")
    steps = events.groupBy("init_date", "lead_time_days").agg(
        F.min("valid_date").alias("valid_date"),
        F.count(F.when(F.col("band") == "high", 1)).alias("n_high"),
        F.count(F.when(F.col("band") == "medium", 1)).alias("n_medium"),
        F.avg("p").alias("mean_p"),
        F.min_by(F.struct("region_id", "p", "dominant_variable"), _highest(p, "region_id")).alias("top"),
    )
    w = Window.partitionBy("init_date").orderBy("lead_time_days")  # the leads of a cycle
    told = steps.select("init_date", "lead_time_days", "valid_date", "n_high", "n_medium", "mean_p", F.col("top.region_id").alias("top_region"), F.col("top.p").alias("top_p"), F.col("top.dominant_variable").alias("driver"), F.lag("lead_time_days").over(w).alias("_lead"))
    told = told.withColumn("new_driver", F.when(~F.coalesce(F.lag("driver").over(w), F.lit("")).eqNullSafe(F.col("driver")), F.col("driver")))
    own = Window.partitionBy("init_date", "region_id").orderBy("lead_time_days")
    moved = events.select("init_date", "region_id", "lead_time_days", "p", F.lag("lead_time_days").over(own).alias("_lead"), F.lag("p").over(own).alias("from_p"))
    rise = F.round(p - F.col("from_p"), PLACES)
    most = F.min_by(F.struct("region_id", "from_p", F.col("p").alias("to_p"), rise.alias("rise")), F.when(rise.isNotNull(), F.struct((-rise).alias("least"), "region_id")))
    risen = moved.where("_lead IS NOT NULL").groupBy("init_date", "lead_time_days", "_lead").agg(most.alias("r")).where(F.col("r.rise") >= least_rise)
    joined = told.join(risen, ["init_date", "lead_time_days", "_lead"], "left")
    return joined.select(*[c for c in told.columns if c != "_lead"], F.col("r.region_id").alias("rising_region"), F.col("r.from_p").alias("from_p"), F.col("r.to_p").alias("to_p"))


def trend(steps: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row a cycle of ``lead_story``: the mean p of its first and last lead, and whether the risk climbs, eases or holds."""
    ends = steps.groupBy("init_date").agg(F.min(F.struct("lead_time_days", "mean_p")).alias("a"), F.max(F.struct("lead_time_days", "mean_p")).alias("z"))
    first, last = F.coalesce("a.mean_p", F.lit(0.0)), F.coalesce("z.mean_p", F.lit(0.0))
    change = F.round(last - first, PLACES)
    kind = F.when(change > margin, "climbs").when(change < -margin, "eases").otherwise("holds")
    return ends.select("init_date", F.col("a.lead_time_days").alias("first_lead"), first.alias("first_p"), F.col("z.lead_time_days").alias("last_lead"), last.alias("last_p"), kind.alias("trend"))


def focus(events: DataFrame, values: DataFrame, angles: list[str], region=None) -> DataFrame:
    """One row a cycle and region that has verified, chartable values: the variable to chart and its points by lead.

    The variable is the dominant one of the region's worst event where it is charted, else the one of the largest mean
    error against its threshold, else of the largest mean error. ``is_default`` marks the cycle's first choice: ``region``
    if it is there, else the region of the highest p.
    """
    worst = events.groupBy("init_date", "region_id").agg(F.max("p").alias("worst_p"), F.min_by("dominant_variable", _highest(F.col("p"), "lead_time_days")).alias("_dominant")).where("worst_p IS NOT NULL")
    charted = _verified(values).where(~F.col("variable").isin(angles))
    point = F.struct("lead_time_days", "valid_date", "predicted_value", "observed_value", "spread")
    series = charted.groupBy("init_date", "region_id", "variable").agg(
        F.round(F.avg("abs_err"), PLACES).alias("_err"),
        F.round(F.avg(F.when(F.col("bust_threshold") > 0, F.col("abs_err") / F.col("bust_threshold"))), PLACES).alias("_ratio"),
        F.min("bust_threshold").alias("bust_threshold"),
        F.array_sort(F.collect_list(point)).alias("points"),
    )
    met = series.join(worst, ["init_date", "region_id"])
    order = F.struct((~F.col("variable").eqNullSafe(F.col("_dominant"))).alias("a"), F.col("_ratio").isNull().alias("b"), (-F.col("_ratio")).alias("c"), (-F.col("_err")).alias("d"), F.col("variable").alias("e"))
    chosen = met.groupBy("init_date", "region_id").agg(F.min_by(F.struct("variable", "bust_threshold", "points"), order).alias("s"), F.max("worst_p").alias("worst_p"))
    wanted = F.lit(True) if region is None else F.col("region_id") == F.lit(region)
    # the cycle's default by an aggregation of keys alone: a row a cycle meets the charts
    default = chosen.groupBy("init_date").agg(F.min_by("region_id", F.struct((~wanted).alias("a"), (-F.col("worst_p")).alias("b"), F.col("region_id").alias("c"))).alias("_default"))
    return chosen.join(default, "init_date").select("init_date", "region_id", "worst_p", F.col("s.variable").alias("variable"), F.col("s.bust_threshold").alias("bust_threshold"), F.col("s.points").alias("points"), (F.col("region_id") == F.col("_default")).alias("is_default"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def divergence(events: DataFrame, values: DataFrame, angles: list[str], high: float, region=None, least: float = 0.15, days: int = 7) -> DataFrame:
    """One row a cycle that has a subject: the region and variable whose spread grows most from its early to its late leads.

    Early and late are the first and last third of the leads that have a spread (one at least, of three or more); a late
    spread below ``least`` of the threshold is no divergence. Growth is in thresholds; of two alike the region of the higher p
    comes first. ``region`` is taken where it has a subject. Beside it stand the first lead at which the region reaches
    ``high``, what the whole cycle says, and the mean p of the cycle before, if it is not more than ``days`` older.
    """
    p, lead = F.col("p"), F.col("lead_time_days")
    usable = values.where((~F.col("variable").isin(angles)) & F.col("spread").isNotNull() & (F.col("bust_threshold") > 0))
    curves = usable.groupBy("init_date", "region_id", "variable").agg(F.min("bust_threshold").alias("bust_threshold"), F.array_sort(F.collect_list(F.struct("lead_time_days", "spread"))).alias("c")).where(F.size("c") >= 3)
    spreads = F.transform("c", lambda x: x["spread"])
    third = F.greatest(F.lit(1), F.floor(F.size("c") / 3).cast("int"))
    ends = curves.select("init_date", "region_id", "variable", "bust_threshold", _mean(F.slice(spreads, F.lit(1), third)).alias("early"), _mean(F.slice(spreads, -third, third)).alias("late"))
    grown = ends.where(F.round(F.col("late"), PLACES) >= F.round(least * F.col("bust_threshold"), PLACES)).withColumn("gain", F.round((F.col("late") - F.col("early")) / F.col("bust_threshold"), PLACES))
    peaks = events.groupBy("init_date", "region_id").agg(F.max("p").alias("peak_p"), F.min(F.when(p >= high, lead)).alias("crossover_lead"))
    ranked = grown.join(peaks, ["init_date", "region_id"], "left")
    wanted = F.lit(True) if region is None else F.col("region_id") == F.lit(region)
    order = F.struct((~wanted).alias("a"), (-F.col("gain")).alias("b"), (-F.coalesce("peak_p", F.lit(0.0))).alias("c"), F.col("region_id").alias("d"), F.col("variable").alias("e"))
    subject = ranked.groupBy("init_date").agg(F.min_by(F.struct("region_id", "variable", "bust_threshold", "early", "late", "gain", "peak_p", "crossover_lead"), order).alias("s")).select("init_date", "s.*")
    cycles = events.groupBy("init_date").agg(F.avg("p").alias("mean_p"), F.countDistinct("region_id").alias("n_regions"), F.countDistinct(F.when(p >= high, F.col("region_id"))).alias("n_high_regions"), F.min(F.when(p >= high, lead)).alias("high_by_lead"))
    w = Window.orderBy("init_date")  # a row a cycle: a small table
    near = F.datediff("init_date", F.lag("init_date").over(w)) <= days
    told = cycles.withColumns({"prior_init_date": F.when(near, F.lag("init_date").over(w)), "prior_mean_p": F.when(near, F.lag("mean_p").over(w))})
    return subject.join(told, "init_date")


def traces(subjects: DataFrame, members: DataFrame, values: DataFrame) -> DataFrame:
    """The charts of ``subjects`` (init_date, region_id, variable): each member by lead, the control first, the mean and what was observed.

    ``members`` has the keys, member, is_control, lead_time_days, valid_date and forecast_value; rows without a member are
    left out. A chart is one row of bounded size: its members times its leads.
    """
    key = ["init_date", "region_id", "variable"]
    asked = subjects.select(*key)
    point = ["lead_time_days", "valid_date"]
    lines = members.where("member IS NOT NULL").join(asked, key).groupBy(*key, "member").agg(F.max("is_control").alias("is_control"), F.array_sort(F.collect_list(F.struct(*point, F.col("forecast_value").alias("value")))).alias("points"))
    charts = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((~F.col("is_control")).alias("_rest"), "member", "points"))).alias("m"))
    charts = charts.select(*key, F.transform("m", lambda x: F.struct((~x["_rest"]).alias("is_control"), x["member"].alias("member"), x["points"].alias("points"))).alias("members"))
    seen = F.when(F.col("observed_value").isNotNull(), F.struct(*point, F.col("observed_value").alias("value")))
    series = values.join(asked, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*point, F.col("predicted_value").alias("value")))).alias("mean"), F.array_sort(F.collect_list(seen)).alias("observed"))
    return asked.join(charts, key, "left").join(series, key, "left")
