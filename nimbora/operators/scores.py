"""Verification of probabilities (p) against outcomes (y, 0 or 1), from counts for each distinct p.

Scores are first counted by distinct probability. What is ordered afterwards is dealt by ranges of it, so that as many
distinct values as there are rows are no one task's work.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.functions.normal import cdf, quantile
from nimbora.operators.ordered import by_ranges, running_sums, written
from nimbora.operators.quantiles import quantiles

CLIP = 1e-6


def histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positive and negative outcomes for each distinct p (np, nn)."""
    known = rows.where("p IS NOT NULL AND y IS NOT NULL")
    return known.groupBy(*(by or []), "p").agg(F.sum(F.col("y").cast("long")).alias("np"), F.sum((1 - F.col("y")).cast("long")).alias("nn"))


def roc_auc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class."""
    by = by or []
    below = running_sums(histogram(rows, by), [F.col("p")], {"below": "nn"}, by, inclusive=False)
    return below.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("np") * (F.col("below") + F.col("nn") / 2)), F.sum("np").cast("double") * F.sum("nn")).alias("auc"),
        F.sum("np").alias("n_pos"),
        F.sum("nn").alias("n_neg"),
    )


def average_precision(rows: DataFrame) -> DataFrame:
    """Area under the precision-recall steps."""
    h = histogram(rows).withColumn("both", F.col("np") + F.col("nn"))
    run = running_sums(h, [F.desc("p")], {"tp": "np", "called": "both"})
    return run.agg(F.try_divide(F.sum(F.col("np") * F.col("tp") / F.col("called")), F.sum("np")).alias("average_precision"))


def brier(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score and its skill against the base rate."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p")))
    made = rows.groupBy(*(by or [])).agg(F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier"), F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))
    reference = F.col("rate") * (1 - F.col("rate"))
    return made.withColumn("skill", F.when(reference > 0, 1 - F.col("brier") / reference))


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Mean probability and observed rate in equal bins; empty ones are left out."""
    edge = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return rows.groupBy(edge.alias("bin")).agg(F.avg("p").alias("predicted"), F.avg("y").alias("observed"), F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """Counts of hits, false alarms, misses and correct rejections at a cut."""
    yes, y = F.col("p") >= cut, F.col("y") == 1
    return rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", yes & y), ("fp", yes & ~y), ("fn", ~yes & y), ("tn", ~yes & ~y))])


def categorical(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """POD, FAR, POFD, CSI, frequency bias, precision, recall and F1 from the counts."""
    c = confusion(rows, cut)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn",
        F.try_divide(tp, tp + fn).alias("pod"),
        F.try_divide(fp, tp + fp).alias("far"),
        F.try_divide(fp, fp + tn).alias("pofd"),
        F.try_divide(tp, tp + fp + fn).alias("csi"),
        F.try_divide(tp + fp, tp + fn).alias("bias"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def sedi(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """Symmetric extremal dependence index."""
    c = confusion(rows, cut)

    def rate(hits: str, rest: str) -> Column:
        share = F.col(hits) / (F.col(hits) + F.col(rest))
        return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), share))

    made = c.where("tp + fn > 0 AND fp + tn > 0").select(rate("tp", "fn").alias("h"), rate("fp", "tn").alias("f"))
    lh, lf, lnh, lnf = F.ln("h"), F.ln("f"), F.ln(1 - F.col("h")), F.ln(1 - F.col("f"))
    return made.select("h", "f", ((lf - lh - lnf + lnh) / (lf + lh + lnf + lnh)).alias("sedi"))


def economic_value(rows: DataFrame, steps: int = 99) -> DataFrame:
    """Relative economic value for cost-loss ratios 1/(steps+1), ...: the best over all thresholds and never acting."""
    spark = rows.sparkSession
    called = running_sums(histogram(rows), [F.desc("p")], {"tp": "np", "fp": "nn"})
    totals = called.agg(F.sum("np").alias("pos"), F.sum("nn").alias("neg"))
    rates = called.crossJoin(F.broadcast(totals)).where("pos > 0 AND neg > 0").select((F.col("tp") / F.col("pos")).alias("hit"), (F.col("fp") / F.col("neg")).alias("fa"), (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("s"))
    alphas = spark.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("alpha"))
    a, s = F.col("alpha"), F.col("s")
    base = F.least(a, s)
    cost = a * (s * F.col("hit") + (1 - s) * F.col("fa")) + s * (1 - F.col("hit"))
    never = (base - s) / (base - a * s)
    value = F.max(F.greatest((base - cost) / (base - a * s), never))
    return rates.crossJoin(F.broadcast(alphas)).groupBy("alpha").agg(value.alias("value"))


def conformal_threshold(rows: DataFrame, alpha: float) -> DataFrame:
    """The one row (q, n): the k-th smallest nonconformity, k = min(ceil((n + 1)(1 - alpha)), n)."""
    scores = rows.select(F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("score"))
    run = running_sums(scores.groupBy("score").agg(F.count(F.lit(1)).alias("c")), [F.col("score")], {"upto": "c"})
    n = run.agg(F.sum("c").alias("n"))
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    return run.crossJoin(F.broadcast(n)).where(F.col("upto") >= k).agg(F.min("score").alias("q"), F.max("n").alias("n"))


def economic_value_at(curve: DataFrame, alpha: float) -> DataFrame:
    """The row of ``curve`` (alpha, value) whose cost-loss ratio is nearest to ``alpha``, the smaller one of two."""
    return curve.orderBy(F.abs(F.col("alpha") - alpha), "alpha").limit(1)


def economic_value_peak(curve: DataFrame) -> DataFrame:
    """The row of ``curve`` (alpha, value) of the highest value, the smallest ratio of several."""
    return curve.where("value IS NOT NULL").orderBy(F.desc("value"), "alpha").limit(1)


def conformal_sets(rows: DataFrame, threshold: DataFrame) -> DataFrame:
    """Counts of prediction sets: both, only 1, only 0 or none, and how many hold the outcome."""
    inside = rows.crossJoin(F.broadcast(threshold.select("q"))).select("y", (F.col("p") <= F.col("q")).alias("zero"), ((1 - F.col("p")) <= F.col("q")).alias("one"))
    kind = F.when(F.col("zero") & F.col("one"), "both").when(F.col("one"), "one").when(F.col("zero"), "zero").otherwise("none")
    held = F.when(F.col("y") == 1, F.col("one")).otherwise(F.col("zero"))
    return inside.groupBy(kind.alias("set")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(held, 1)).alias("covered"))


def binormal(rows: DataFrame) -> DataFrame:
    """Binormal area: the normal distribution function of the distance of the classes' probit means."""
    z = quantile(F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p"))))
    m = rows.select("y", z.alias("z")).agg(*[f(F.when(F.col("y") == k, F.col("z"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mu", F.avg), ("var", F.var_samp), ("n", F.count))])
    distance = F.try_divide(F.col("mu1") - F.col("mu0"), F.sqrt(F.col("var1") + F.col("var0")))
    return m.withColumn("binormal_auc", F.when((F.col("n0") >= 2) & (F.col("n1") >= 2), cdf(distance)))


#: Corners of a range that are looked at together with those of all other ranges, at most.
CORNERS = 64


def _chain(points: list[tuple[int, int]]) -> list[int]:
    """Places of the points, in order of x, that lie on their lower convex hull."""
    kept: list[int] = []
    for k, (x, y) in enumerate(points):
        while len(kept) > 1:
            (x0, y0), (x1, y1) = points[kept[-2]], points[kept[-1]]
            if (y1 - y0) * (x - x1) <= (y - y1) * (x1 - x0):
                break
            kept.pop()
        kept.append(k)
    return kept


def _corners(dealt: DataFrame) -> DataFrame:
    """The corners of each range's own hull, over the running numbers of outcomes (x) and of positive ones (y)."""
    import pandas as pd

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", ignore_index=True)
        x, y = [0, *(pdf["np"] + pdf["nn"]).cumsum().tolist()], [0, *pdf["np"].cumsum().tolist()]
        kept = [k for k in _chain(list(zip(x, y))) if k]
        return pd.DataFrame({"_range": pdf["_range"].iloc[0], "x": [x[k] for k in kept], "y": [y[k] for k in kept]})

    return dealt.groupBy("_range").applyInPandas(within, "_range int, x long, y long")


def _below(bridge: list[tuple[int, int]]):
    """Keeps the corners that do not lie above the hull ``bridge``."""
    xs = [x for x, _ in bridge]

    def rows(frames):
        for pdf in frames:
            kept = []
            for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist()):
                k = min(max(bisect.bisect_left(xs, x), 1), len(bridge) - 1)
                (x0, y0), (x1, y1) = bridge[k - 1], bridge[k]
                kept.append((y - y0) * (x1 - x0) <= (y1 - y0) * (x - x0))
            yield pdf[kept]

    return rows


def pooled_adjacent(rows: DataFrame) -> DataFrame:
    """Isotonic fit of the outcome on p: p, fitted, np, nn, one row a distinct p.

    Pooling neighbours that are out of order is the lower convex hull of the running counts. Ranges of p are pooled side
    by side, which leaves each with the corners of its own hull. Then, in rounds, up to CORNERS corners of every range, its
    two first and two last among them, are put together: what lies above the hull of these lies above the whole one and
    goes. A round that drops none of the corners it looked at finds all neighbours in order. Between rounds no task holds
    more than a range, and the driver a few corners of each.
    """
    import pandas as pd

    dealt = by_ranges(histogram(rows), [F.col("p")])
    totals = dealt.groupBy("_range").agg(F.sum(F.col("np") + F.col("nn")).alias("n"), F.sum("np").alias("pos"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("x0"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("y0"))
    starts = written(starts)
    corners = written(_corners(dealt).join(F.broadcast(starts), "_range").select("_range", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y")))
    inner = Window.partitionBy("_range")
    while True:
        ranked = corners.withColumn("k", F.row_number().over(inner.orderBy("x"))).withColumn("n", F.count(F.lit(1)).over(inner))
        step = F.ceil(F.col("n") / (CORNERS - 4))
        looked = ranked.where((F.col("k") <= 2) | (F.col("k") > F.col("n") - 2) | (F.col("k") % step == 0)).select("x", "y")
        points = [(0, 0), *sorted((r["x"], r["y"]) for r in looked.collect())]
        hull = [points[k] for k in _chain(points)]
        if len(hull) == len(points):
            break
        corners = written(corners.mapInPandas(_below(hull), corners.schema))

    # a row belongs to the next corner, which may be the first of a later range; a corner's slope is towards the one before
    edges = corners.groupBy("_range").agg(F.min(F.struct("x", "y")).alias("first"), F.max(F.struct("x", "y")).alias("last"))
    every = starts.select("_range", "x0", "y0").join(edges, "_range", "left")
    earlier, later = (Window.orderBy("_range").rowsBetween(*w) for w in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    borders = every.select("_range", "x0", F.coalesce(F.last("last", True).over(earlier), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))).alias("a"), F.first("first", True).over(later).alias("z"))
    borders = borders.select("_range", "x0", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("z.x").alias("zx"), F.col("z.y").alias("zy"))

    def fit(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("p", ignore_index=True)
        border, own = pdf.iloc[0], own.sort_values("x")
        x, y = [int(border["ax"]), *own["x"].tolist()], [int(border["ay"]), *own["y"].tolist()]
        if not pd.isna(border["zx"]):
            x.append(int(border["zx"]))
            y.append(int(border["zy"]))
        at = int(border["x0"]) + (pdf["np"] + pdf["nn"]).cumsum().to_numpy()
        slopes = np.array([(y[k] - y[k - 1]) / (x[k] - x[k - 1]) for k in range(1, len(x))])
        pdf["fitted"] = slopes[np.searchsorted(np.array(x[1:]), at)]
        return pdf[["p", "fitted", "np", "nn"]]

    placed = dealt.join(F.broadcast(borders), "_range")
    return placed.groupBy("_range").cogroup(corners.groupBy("_range")).applyInPandas(fit, "p double, fitted double, np long, nn long")


def brier_decomposition(rows: DataFrame) -> DataFrame:
    """Miscalibration, discrimination and uncertainty, by the isotonic fit; brier = mcb - dsc + unc."""
    f = pooled_adjacent(rows)
    n = F.col("np") + F.col("nn")

    def score(p: Column) -> Column:
        return F.sum(F.col("np") * (1 - p) * (1 - p) + F.col("nn") * p * p) / F.sum(n)

    made = f.agg(score(F.col("p")).alias("brier"), score(F.col("fitted")).alias("fit"), (F.sum("np") / F.sum(n)).alias("rate"))
    unc = F.col("rate") * (1 - F.col("rate"))
    return made.select("brier", (F.col("brier") - F.col("fit")).alias("mcb"), (unc - F.col("fit")).alias("dsc"), unc.alias("unc"))


def cycle_pairs(rows: DataFrame) -> DataFrame:
    """For each two cycles (i, j; places of init_date in order) the positive outcomes of i that stand above negative ones of j.

    Pairs of equal p count half, so c is in halves; pairs without any are left out. Ranges of p are counted side by side:
    what is below a range is known for each cycle, and only pairs within it are looked at.
    """
    import pandas as pd

    h = histogram(rows, ["init_date"])
    numbered = _cycles(h)
    dealt = by_ranges(h.join(F.broadcast(numbered), "init_date").select("k", "p", "np", "nn"), [F.col("p")])
    n = numbered.count()
    before = Window.partitionBy("k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("k", "_range").agg(F.sum("nn").alias("nn"))
    ranges = each.select("_range").distinct()
    full = ranges.join(each.select("k").distinct(), how="cross").join(each, ["k", "_range"], "left")  # a row for each range and cycle
    below = written(full.select("_range", "k", F.coalesce(F.sum("nn").over(before), F.lit(0)).alias("below")))

    def count(pdf: pd.DataFrame, under: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if pdf.empty:
            return pd.DataFrame({"i": [], "j": [], "c": []})
        negative = np.zeros(n, np.int64)
        negative[under["k"].to_numpy()] = under["below"].to_numpy()
        found: dict[int, np.ndarray] = {}
        for _, same in pdf.groupby("p", sort=True):
            here = np.zeros(n, np.int64)
            np.add.at(here, same["k"].to_numpy(), same["nn"].to_numpy())
            twice = 2 * negative + here
            for k, np_ in zip(same["k"].tolist(), same["np"].tolist()):
                if np_:
                    found[k] = found.get(k, 0) + np_ * twice
            negative += here
        made = [(k, j, c) for k, row in found.items() for j, c in enumerate(row.tolist()) if c]
        return pd.DataFrame(made, columns=["i", "j", "c"])

    counted = dealt.groupBy("_range").cogroup(below.groupBy("_range")).applyInPandas(count, "i int, j int, c long")
    return counted.groupBy("i", "j").agg(F.sum("c").alias("c"))


def _cycles(h: DataFrame) -> DataFrame:
    """init_date and k: the place of each cycle in order, from 0."""
    return h.select("init_date").distinct().select("init_date", (F.row_number().over(Window.orderBy("init_date")) - 1).alias("k"))  # one row a cycle


def draw_starts(draw, block, seed: int):
    """A number from 1 for each draw and block of it: two steps of a linear congruential generator."""
    first = (draw * 1_000_003 + block * 7_919 + seed * 104_729 + 1) % 2_147_483_647 * 48_271 % 2_147_483_647
    return (first + block) % 2_147_483_647 * 69_621 % 2_147_483_647


def _weights(n: int, draws: int, block: int, seed: int):
    """How often each of ``n`` cycles is in each draw: runs of ``block`` cycles, wrapped at the end, cut to ``n`` in all."""
    import numpy as np

    weights = np.zeros((draws, n), np.int64)
    draw = np.arange(draws, dtype=np.int64)
    for b in range(-(-n // block)):
        start = draw_starts(draw, b, seed) % n
        for j in range(min(block, n - b * block)):
            np.add.at(weights, (draw, (start + j) % n), 1)
    return weights


def bootstrap_areas(rows: DataFrame, draws: int = 1000, block: int = 3, seed: int = 7) -> DataFrame:
    """The ROC area of each draw (draw, auc) of runs of consecutive cycles (init_date), wrapped at the end.

    The area is bilinear in how often each cycle is drawn, so pairs of outcomes are counted once for each pair of cycles,
    and a draw is a quadratic form in that table. A block is a fifth of the cycles at most. The draws are the same each time.
    """
    spark = rows.sparkSession
    pairs = written(cycle_pairs(rows))
    h = histogram(rows, ["init_date"])
    totals = h.groupBy("init_date").agg(F.sum("np").alias("np"), F.sum("nn").alias("nn"))
    sums = totals.join(F.broadcast(_cycles(h)), "init_date").select("k", "np", "nn").collect()  # one row a cycle
    n = len(sums)
    if not n:
        return spark.createDataFrame([], "draw long, auc double")
    length = max(1, min(block, n // 5))

    def forms(frames):
        import numpy as np
        import pandas as pd

        weights, total = _weights(n, draws, length, seed), np.zeros(draws, np.int64)
        for pdf in frames:
            for i, row in pdf.groupby("i"):
                total += weights[:, i] * (weights[:, row["j"].to_numpy()] @ row["c"].to_numpy())
        yield pd.DataFrame({"draw": np.arange(draws), "c": total})

    counted = pairs.repartition("i").mapInPandas(forms, "draw long, c long").groupBy("draw").agg(F.sum("c").alias("c"))

    import numpy as np

    weights, ordered = _weights(n, draws, length, seed), sorted((r["k"], r["np"], r["nn"]) for r in sums)
    outcomes = [(d, int(p), int(q)) for d, (p, q) in enumerate(zip(weights @ np.array([x[1] for x in ordered]), weights @ np.array([x[2] for x in ordered])))]
    drawn = spark.createDataFrame(outcomes, "draw long, p long, q long")
    both = F.col("p").cast("double") * F.col("q")
    return drawn.join(counted, "draw", "left").select("draw", F.try_divide(F.coalesce("c", F.lit(0)) / 2, both).alias("auc"))


def block_bootstrap(rows: DataFrame, draws: int = 1000, block: int = 3, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile interval of the ROC area over ``bootstrap_areas``: low, high, draws (those with both outcomes).

    With a single cycle every draw is that cycle, so the interval is a point.
    """
    tail = (1 - level) / 2
    return quantiles(bootstrap_areas(rows, draws, block, seed), F.col("auc"), {"low": tail, "high": 1 - tail}, count="draws")
