"""Read models over scored events (KEYS, p, band, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alerts(scored: DataFrame, bands: list[str], limit: int) -> DataFrame:
    """The highest probabilities of some bands."""
    return scored.where(F.col("band").isin(bands)).orderBy(F.desc("p"), "region_id", "init_date", "lead_time_days").limit(max(1, limit))


def alerts_by_region(scored: DataFrame, bands: list[str]) -> DataFrame:
    """For each region its worst event and on how many it is alerted."""
    hot = scored.where(F.col("band").isin(bands))
    worst = F.max_by(F.struct("p", "init_date", "lead_time_days"), F.struct("p", "init_date", "lead_time_days"))
    return hot.groupBy("region_id").agg(worst.alias("w"), F.count(F.lit(1)).alias("n_alerts")).select("region_id", F.col("w.p").alias("p"), F.col("w.init_date").alias("init_date"), F.col("w.lead_time_days").alias("lead_time_days"), "n_alerts")


def national(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and largest probability, regions and high ones."""
    return scored.groupBy(*by).agg(F.avg("p").alias("mean_p"), F.min("p").alias("least_p"), F.max("p").alias("most_p"), F.countDistinct("region_id").alias("regions"), F.count(F.when(F.col("band") == "high", 1)).alias("n_high"))


def first_crossing(scored: DataFrame, cut: float) -> DataFrame:
    """The first lead at which each region and run reaches a probability."""
    return scored.groupBy("region_id", "init_date").agg(F.min(F.when(F.col("p") >= cut, F.col("lead_time_days"))).alias("first_lead"), F.max("p").alias("peak"))


def prior_run(scored: DataFrame, days: int = 7) -> DataFrame:
    """Mean probability of each run and that of the run before it, if it is not too old."""
    runs = scored.groupBy("region_id", "init_date").agg(F.avg("p").alias("mean_p"))
    w = Window.partitionBy("region_id").orderBy("init_date")
    near = F.datediff("init_date", F.lag("init_date").over(w)) <= days
    before = F.when(near, F.lag("mean_p").over(w))
    return runs.select("region_id", "init_date", "mean_p", before.alias("prior_p"), (F.col("mean_p") - before).alias("change"))


def lead_steps(scored: DataFrame) -> DataFrame:
    """The change of a region's probability from one lead of a run to the next."""
    w = Window.partitionBy("region_id", "init_date").orderBy("lead_time_days")
    return scored.select("region_id", "init_date", "lead_time_days", "p", (F.col("p") - F.lag("p").over(w)).alias("step"))


def run_summary(scored: DataFrame, far: int = 4) -> DataFrame:
    """Peak, growth from near to far leads and leads of each run."""
    lead = F.col("lead_time_days")
    growth = F.avg(F.when(lead >= far, F.col("p"))) - F.avg(F.when(lead < far, F.col("p")))
    return scored.groupBy("init_date").agg(F.max("p").alias("peak"), growth.alias("growth"), F.countDistinct("lead_time_days").alias("leads"), F.countDistinct("region_id").alias("regions"))


def worst_misses(scored: DataFrame, k: int) -> DataFrame:
    """Busts of the lowest and clear events of the highest probabilities."""
    keys = ["region_id", "init_date", "lead_time_days"]
    missed = scored.where("y = 1").orderBy("p", *keys).limit(k).withColumn("kind", F.lit("missed"))
    false = scored.where("y = 0").orderBy(F.desc("p"), *keys).limit(k).withColumn("kind", F.lit("false alarm"))
    return missed.unionByName(false).select(*keys, "p", "y", "kind")


def detail(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """Each region and run with its probability by lead and its series by variable, nested: as many points as the run has leads."""
    keys = ["region_id", "init_date"]
    curve = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lead_time_days", "valid_date", "p", "band"))).alias("curve"))
    series = rows.groupBy(*keys, "variable").agg(F.sort_array(F.collect_list(F.struct("lead_time_days", "valid_date", "fc_mean", "obs_mean"))).alias("points"))
    nested = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("variable", "points"))).alias("series"))
    return curve.join(nested, keys, "left")


def agreement(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Bias, mean absolute and root mean square difference and correlation of two products."""
    d = F.col(a) - F.col(b)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(a, b).alias("pearson"))


def against_threshold(agreed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds to an agreement by variable its mae in percent of the variable's bust threshold; null without one above 0."""
    share = F.when(F.col("bust_threshold") > 0, 100.0 * F.col("mae") / F.col("bust_threshold"))
    return agreed.join(F.broadcast(cuts), "variable", "left").withColumn("mae_pct_of_threshold", share)  # a row a variable


def per_variable(rows: DataFrame, member_p90: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each region, lead, variable and day: means over runs, confidence and threshold."""
    made = rows.groupBy("region_id", "lead_time_days", "variable", "valid_date").agg(
        F.avg("fc_mean").alias("predicted_value"), F.avg("obs_mean").alias("observed_value"), F.avg("pred_err").alias("predicted_error"), F.avg("spread").alias("spread"), F.max("n_rows").alias("members")
    )
    known = made.join(F.broadcast(member_p90), "variable", "left").join(F.broadcast(cuts), "variable", "left")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.try_divide(F.col("predicted_error"), F.col("member_p90"))))
    return known.withColumn("confidence", share).select("region_id", "lead_time_days", "variable", "valid_date", "predicted_value", "observed_value", "predicted_error", "spread", "members", "confidence", "bust_threshold")


def top_factors(rows: DataFrame, cuts: DataFrame, keys: list[str], k: int, fallback: DataFrame | None = None) -> DataFrame:
    """The names of the ``k`` variables whose predicted error is largest against its threshold (to 6 places), by name on ties.

    Events without any go to ``fallback`` (keys, factors), if it is given.
    """
    ratio = F.round(F.col("pred_err") / F.col("bust_threshold"), 6)
    known = rows.join(F.broadcast(cuts), "variable").where("bust_threshold > 0").withColumn("ratio", ratio).where("ratio IS NOT NULL")
    listed = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("least"), "variable"))).alias("f"))
    made = listed.select(*keys, F.array_join(F.transform(F.slice("f", 1, k), lambda x: x["variable"]), ",").alias("factors"))
    return made if fallback is None else made.unionByName(fallback.join(made, keys, "left_anti").select(*keys, "factors"))
