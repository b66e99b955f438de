"""Queries on verification statistics and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import baselines, events, scores
from nimbora.functions import normal
from nimbora.operators.ordered import written
from nimbora.operators.quantiles import quantiles
from nimbora.plans.forecast_queries import ALL, EVT, cuts, event_rows, paired
from nimbora.plans.registry import Registry
from nimbora.plans.views import ANGLE, EVENT, table, with_sql

R = Registry()


def lines(s: SparkSession, d: str) -> DataFrame:
    """Outcomes and probabilities with many ties: returned order lines and their discount."""
    return table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"), F.to_date("l_shipdate").alias("init_date"), "l_linestatus")


LINES = "lines AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_discount * 10 AS p, CAST(l_shipdate AS DATE) AS init_date, l_linestatus FROM lineitem)"


def event_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and event rows by variable, each written once for the steps that read them."""
    pairs = written(paired(s, d).select(*EVENT, "variable", "forecast_value", "observed_value", "abs_error"))
    return pairs, written(events.event_rows(pairs, ANGLE).select(*EVENT, "variable", "actual_err", "pred_err", "spread"))


def scored_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Events of ``event_tables`` with their label (y), a probability from their members' errors (p), and its band."""
    usual = cuts(rows).join(events.thresholds(pairs, "abs_error", 0.9, "member_p90"), "variable")  # a row for each variable
    x = F.max(F.col("pred_err") / F.col("member_p90"))
    both = rows.join(F.broadcast(usual), "variable").groupBy(*EVENT).agg(F.max(events.bust_ratio()).alias("ratio"), F.round(x / (1 + x), 4).alias("p"))
    made = both.where("ratio IS NOT NULL").select(*EVENT, (F.col("ratio") >= 1).cast("int").alias("y"), "p")
    return made.withColumn("band", events.band(F.col("p"), F.lit(0.3), F.lit(0.5)))


def scored(s: SparkSession, d: str) -> DataFrame:
    """Events with their label (y), a probability from their members' errors (p), and its band."""
    return scored_of(*event_tables(s, d))


SCORED = """scored AS (
  SELECT region_id, init_date, valid_date, lead_time_days, y_bust AS y, p, CASE WHEN p >= 0.5 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS band
  FROM labelled JOIN (SELECT region_id, init_date, valid_date, lead_time_days, round(max(pred_err / member_p90) / (1 + max(pred_err / member_p90)), 4) AS p
    FROM evt JOIN p90 USING (variable) GROUP BY ALL) USING (region_id, init_date, valid_date, lead_time_days))"""
S = (*ALL, SCORED)

AUC = """h AS (SELECT p, sum(y) AS np, sum(1 - y) AS nn FROM {t} GROUP BY p),
b AS (SELECT *, coalesce(sum(nn) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT CAST(sum(np * (below + nn / 2)) AS DOUBLE) / (sum(np) * sum(nn)) AS auc, CAST(sum(np) AS BIGINT) AS n_pos, CAST(sum(nn) AS BIGINT) AS n_neg FROM b"""
R.add("roc_auc_rank", lambda s, d: scores.roc_auc(lines(s, d)), with_sql(LINES, AUC.format(t="lines")), ("auc",))
R.add("roc_auc_events", lambda s, d: scores.roc_auc(scored(s, d)), with_sql(*S, AUC.format(t="scored")), ("auc",))
R.add(
    "pr_auc",
    lambda s, d: scores.average_precision(lines(s, d)),
    with_sql(LINES, "h AS (SELECT p, sum(y) AS np, count(*) AS c FROM lines GROUP BY p)", "r AS (SELECT np, sum(np) OVER (ORDER BY p DESC) AS tp, sum(c) OVER (ORDER BY p DESC) AS called FROM h)") + "SELECT CAST(sum(np * tp / called) / sum(np) AS DOUBLE) AS average_precision FROM r",
    ("average_precision",),
)
R.add(
    "brier_bss",
    lambda s, d: scores.brier(lines(s, d)),
    with_sql(LINES) + "SELECT avg((greatest(1e-6, least(1 - 1e-6, p)) - y) ** 2) AS brier, avg(y) AS rate, count(*) AS n, 1 - avg((greatest(1e-6, least(1 - 1e-6, p)) - y) ** 2) / (avg(y) * (1 - avg(y))) AS skill FROM lines",
    ("brier", "rate", "skill"),
)
R.add(
    "bss_per_lead",
    lambda s, d: baselines.skill_by(scored(s, d), ["lead_time_days"]),
    with_sql(*S) + "SELECT lead_time_days, avg((p - y) ** 2) AS brier, avg(y) AS rate, count(*) AS n, 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) AS skill FROM scored GROUP BY 1 HAVING count(*) >= 20 AND avg(y) * (1 - avg(y)) > 0",
    ("brier", "rate", "skill"),
)
R.add("reliability_bins", lambda s, d: scores.reliability(scored(s, d)), with_sql(*S) + "SELECT CAST(least(4, floor(p * 5)) AS INTEGER) AS bin, avg(p) AS predicted, avg(y) AS observed, count(*) AS n FROM scored GROUP BY 1", ("predicted", "observed"))
CONF = "c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM lines)"
R.add("confusion_metrics", lambda s, d: scores.confusion(lines(s, d)), with_sql(LINES, CONF) + "SELECT tp, fp, fn, tn FROM c")
R.add(
    "categorical_skill",
    lambda s, d: scores.categorical(lines(s, d)),
    with_sql(LINES, CONF) + "SELECT tp, fp, fn, tn, tp / (tp + fn) AS pod, fp / (tp + fp) AS far, fp / (fp + tn) AS pofd, tp / (tp + fp + fn) AS csi, (tp + fp) / (tp + fn) AS bias, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c",
    ("pod", "far", "pofd", "csi", "bias", "f1"),
)
R.add("sedi", lambda s, d: scores.sedi(lines(s, d)), with_sql(LINES, CONF, "r AS (SELECT greatest(1e-6, least(1 - 1e-6, tp / (tp + fn))) AS h, greatest(1e-6, least(1 - 1e-6, fp / (fp + tn))) AS f FROM c)") + "SELECT h, f, (ln(f) - ln(h) - ln(1 - f) + ln(1 - h)) / (ln(f) + ln(h) + ln(1 - f) + ln(1 - h)) AS sedi FROM r", ("h", "f", "sedi"))
REV = (
    "h AS (SELECT p, CAST(sum(y) AS DOUBLE) AS np, CAST(sum(1 - y) AS DOUBLE) AS nn FROM scored GROUP BY p)",
    "t AS (SELECT sum(np) AS pos, sum(nn) AS neg FROM h)",
    "r AS (SELECT sum(np) OVER (ORDER BY p DESC) / pos AS hit, sum(nn) OVER (ORDER BY p DESC) / neg AS fa, pos / (pos + neg) AS s FROM h, t)",
    "a AS (SELECT i / 100.0::DOUBLE AS alpha FROM range(1, 100) x(i))",
)
CURVE = "SELECT alpha, max(greatest((least(alpha, s) - (alpha * (s * hit + (1 - s) * fa) + s * (1 - hit))) / (least(alpha, s) - alpha * s), (least(alpha, s) - s) / (least(alpha, s) - alpha * s))) AS value FROM r, a GROUP BY alpha"
R.add("rev_curve", lambda s, d: scores.economic_value(scored(s, d)), with_sql(*S, *REV) + CURVE, ("alpha", "value"))


def _conformal_sets(s: SparkSession, d: str) -> DataFrame:
    rows = written(scored(s, d))
    return scores.conformal_sets(rows, scores.conformal_threshold(rows, 0.1))


Q = "n AS (SELECT CASE WHEN y = 1 THEN 1 - p ELSE p END AS score FROM scored)", "k AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM n)", "q AS (SELECT min(score) AS q, max(n) AS n FROM k WHERE r >= least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n))"
R.add("conformal_threshold", lambda s, d: scores.conformal_threshold(scored(s, d), 0.1), with_sql(*S, *Q) + "SELECT q, n FROM q", ("q",))
R.add(
    "conformal_sets",
    _conformal_sets,
    with_sql(*S, *Q, "i AS (SELECT y, p <= q AS zero, 1 - p <= q AS one FROM scored, q)") + "SELECT CASE WHEN zero AND one THEN 'both' WHEN one THEN 'one' WHEN zero THEN 'zero' ELSE 'none' END AS \"set\", count(*) AS n, count(*) FILTER (CASE WHEN y = 1 THEN one ELSE zero END) AS covered FROM i GROUP BY 1",
)
R.add(
    "risk_bands",
    lambda s, d: events.band_cuts(scored(s, d), "p"),
    with_sql(*S) + "SELECT CASE WHEN n < 20 OR m - l <= 1e-8 THEN 0.33 ELSE q50 END AS medium, CASE WHEN n < 20 OR m - l <= 1e-8 THEN 0.66 WHEN q80 <= q50 THEN least(1, q50 + 1e-3) ELSE q80 END AS high FROM (SELECT count(p) AS n, quantile_cont(p, 0.5) AS q50, quantile_cont(p, 0.8) AS q80, min(p) AS l, max(p) AS m FROM scored)",
    ("medium", "high"),
)
R.add("band_assign", lambda s, d: scored(s, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")), with_sql(*S) + "SELECT band, count(*) AS n, avg(y) AS rate FROM scored GROUP BY 1", ("rate",))
R.add("regression_metrics", lambda s, d: event_rows(s, d).groupBy("variable").agg(F.avg("actual_err").alias("mae"), F.sqrt(F.avg(F.col("actual_err") ** 2)).alias("rmse"), F.try_divide(F.var_pop("obs_mean") - F.avg(F.col("actual_err") ** 2), F.var_pop("obs_mean")).alias("r2"), F.count(F.lit(1)).alias("n")), with_sql(*EVT) + "SELECT variable, avg(actual_err) AS mae, sqrt(avg(actual_err ** 2)) AS rmse, 1 - avg(actual_err ** 2) / nullif(var_pop(obs_mean), 0) AS r2, count(*) AS n FROM evt GROUP BY 1", ("mae", "rmse", "r2"))


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = scored(s, d).drop("p", "band")
    return rows.where("dayofmonth(init_date) <= 15"), rows.where("dayofmonth(init_date) > 15")


R.add("baseline_climatology", lambda s, d: baselines.climatology(*_split(s, d)).groupBy("lead_time_days").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier")), with_sql(*S) + "SELECT lead_time_days, avg((t.p - y) ** 2) AS brier FROM scored, (SELECT avg(y) AS p FROM scored WHERE day(init_date) <= 15) t WHERE day(init_date) > 15 GROUP BY 1", ("brier",))


def _cells(s: SparkSession, d: str) -> DataFrame:
    train, rows = _split(s, d)
    made = baselines.cell_frequency(train, rows, ["region_id", "lead_time_days"], ["lead_time_days"], 12)
    return made.select(*EVENT, "y", "p")


R.add(
    "baseline_cell_backoff",
    _cells,
    with_sql(*S, "train AS (SELECT * FROM scored WHERE day(init_date) <= 15)", "f AS (SELECT region_id, lead_time_days, avg(y) AS a FROM train GROUP BY ALL HAVING count(*) >= 12)", "w AS (SELECT lead_time_days, avg(y) AS b FROM train GROUP BY 1)") + "SELECT region_id, init_date, valid_date, lead_time_days, y, coalesce(a, b, (SELECT avg(y) FROM train)) AS p FROM scored LEFT JOIN f USING (region_id, lead_time_days) LEFT JOIN w USING (lead_time_days) WHERE day(init_date) > 15",
    ("p",),
)
R.add(
    "baseline_emos_fit",
    lambda s, d: baselines.emos_fit(event_rows(s, d)),
    with_sql(*EVT, "f AS (SELECT variable, regr_slope(actual_err * sqrt(pi() / 2), spread) AS slope, regr_intercept(actual_err * sqrt(pi() / 2), spread) AS cut, avg(actual_err) AS mean, count(*) AS n FROM evt WHERE spread IS NOT NULL GROUP BY 1)") + "SELECT variable, greatest(cut, mean * sqrt(pi() / 2) * 1e-3, 1e-6) AS a, greatest(slope, 0.0) AS b, n FROM f WHERE n >= 50",
    ("a", "b"),
)


def _emos(s: SparkSession, d: str) -> DataFrame:
    rows = event_rows(s, d)
    return baselines.emos_probability(rows, baselines.emos_fit(rows), cuts(rows), EVENT)




def _poly(x: str, parts: list[float]) -> str:
    made = f"{parts[0]!r}::DOUBLE"
    for p in parts[1:]:
        made = f"({made} * {x} + ({p!r}::DOUBLE))"
    return made


def _erf(x: str) -> str:
    """The error function in SQL, by the same fixed values."""
    t = f"(1.0 / (1.0 + {normal.ERF_P!r}::DOUBLE * abs({x})))"
    return f"(sign({x}) * (1.0 - {_poly(t, normal.ERF[::-1])} * {t} * exp(-({x}) * ({x}))))"


def _quantile(p: str) -> str:
    tail, q = f"sqrt(-2.0 * ln(least({p}, 1.0 - {p})))", f"({p} - 0.5)"
    outer = f"({_poly(tail, normal.C)} / ({_poly(tail, normal.D)} * {tail} + 1.0))"
    inner = f"({_poly(f'({q} * {q})', normal.A)} * {q} / ({_poly(f'({q} * {q})', normal.B)} * {q} * {q} + 1.0))"
    return f"CASE WHEN {p} < {normal.LOW} THEN {outer} WHEN {p} > 1 - {normal.LOW} THEN -{outer} ELSE {inner} END"


EMOS_FIT = "f AS (SELECT variable, regr_slope(actual_err * sqrt(pi() / 2), spread) AS slope, regr_intercept(actual_err * sqrt(pi() / 2), spread) AS cut, avg(actual_err) AS mean, count(*) AS n FROM evt WHERE spread IS NOT NULL GROUP BY 1)"
R.add(
    "baseline_emos_probability",
    _emos,
    with_sql(*ALL, EMOS_FIT, "fit AS (SELECT variable, greatest(cut, mean * sqrt(pi() / 2) * 1e-3, 1e-6) AS a, greatest(slope, 0.0) AS b FROM f WHERE n >= 50)", "mid AS (SELECT variable, median(spread) AS mid FROM evt GROUP BY 1)", "sig AS (SELECT evt.*, bust_threshold / (greatest(a + b * coalesce(spread, mid), 1e-6) * sqrt(2)) AS x FROM evt JOIN fit USING (variable) JOIN thr USING (variable) JOIN mid USING (variable))")
    + f"SELECT region_id, init_date, valid_date, lead_time_days, 1 - exp(sum(ln(greatest({_erf('x')}, 1e-300)))) AS p FROM sig GROUP BY ALL",
    ("p",),
)


def _exponent(s: SparkSession, d: str) -> DataFrame:
    return baselines.emos_exponent(_emos(s, d).join(scored(s, d).select(*EVENT, "y"), EVENT)).select(F.round("gamma", 6).alias("gamma"), "brier")


R.add(
    "baseline_emos_exponent",
    _exponent,
    with_sql(*S, EMOS_FIT, "fit AS (SELECT variable, greatest(cut, mean * sqrt(pi() / 2) * 1e-3, 1e-6) AS a, greatest(slope, 0.0) AS b FROM f WHERE n >= 50)", "mid AS (SELECT variable, median(spread) AS mid FROM evt GROUP BY 1)", "sig AS (SELECT evt.*, bust_threshold / (greatest(a + b * coalesce(spread, mid), 1e-6) * sqrt(2)) AS x FROM evt JOIN fit USING (variable) JOIN thr USING (variable) JOIN mid USING (variable))", f"em AS (SELECT region_id, init_date, valid_date, lead_time_days, exp(sum(ln(greatest({_erf('x')}, 1e-300)))) AS none FROM sig GROUP BY ALL)", "g AS (SELECT 0.05::DOUBLE + 0.95::DOUBLE * k / 39 AS gamma FROM range(40) r(k))", "b AS (SELECT gamma, avg((1 - none ** gamma - y) ** 2) AS brier FROM em JOIN scored USING (region_id, init_date, valid_date, lead_time_days), g GROUP BY 1)")
    + "SELECT round(gamma, 6) AS gamma, brier FROM b ORDER BY round(brier, 9), gamma LIMIT 1",
    ("brier",),
)


def _season_cells(s: SparkSession, d: str) -> DataFrame:
    train, rows = _split(s, d)
    season = events.season_of(F.col("valid_date"))
    return baselines.cell_frequency(train.withColumn("season", season), rows.withColumn("season", season), ["region_id", "season"], ["season"], 30).select(*EVENT, "y", "p")


SEASONED = "seasoned AS (SELECT *, CASE WHEN month(valid_date) IN (12, 1, 2) THEN 'DJF' WHEN month(valid_date) IN (3, 4, 5) THEN 'MAM' WHEN month(valid_date) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'ON' END AS season FROM scored)"
R.add(
    "baseline_season_backoff",
    _season_cells,
    with_sql(*S, SEASONED, "train AS (SELECT * FROM seasoned WHERE day(init_date) <= 15)", "f AS (SELECT region_id, season, avg(y) AS a FROM train GROUP BY ALL HAVING count(*) >= 30)", "w AS (SELECT season, avg(y) AS b FROM train GROUP BY 1)") + "SELECT region_id, init_date, valid_date, lead_time_days, y, coalesce(a, b, (SELECT avg(y) FROM train)) AS p FROM seasoned LEFT JOIN f USING (region_id, season) LEFT JOIN w USING (season) WHERE day(init_date) > 15",
    ("p",),
)


def _analog(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return baselines.analog_votes(v, F.lit(True), 50)


R.add(
    "baseline_analog_knn",
    _analog,
    """WITH e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY i),
z AS (SELECT id, any_value(label) AS label, list((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY i) AS v FROM e JOIN st USING (i) GROUP BY id),
m AS (SELECT q.id AS query_id, z.id, z.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, z.v), z.id) AS r FROM z JOIN z q ON q.id <> z.id)
SELECT query_id, CAST(label AS BIGINT) AS label, count(*) / (SELECT CAST(least(50, count(*) - 1) AS DOUBLE) FROM z) AS share FROM m WHERE r <= 50 GROUP BY ALL""",
    ("share",),
)
CLIPPED = "greatest(1e-6, least(1 - 1e-6, p))"
R.add(
    "binormal_auc",
    lambda s, d: scores.binormal(scored(s, d)),
    with_sql(*S, f"clipped AS (SELECT y, {CLIPPED} AS p FROM scored)", f"z AS (SELECT y, {_quantile('p')} AS z FROM clipped)", "m AS (SELECT avg(z) FILTER (y = 0) AS mu0, var_samp(z) FILTER (y = 0) AS var0, count(z) FILTER (y = 0) AS n0, avg(z) FILTER (y = 1) AS mu1, var_samp(z) FILTER (y = 1) AS var1, count(z) FILTER (y = 1) AS n1 FROM z)", "x AS (SELECT *, (mu1 - mu0) / nullif(sqrt(var1 + var0), 0) / sqrt(2) AS x FROM m)")
    + f"SELECT mu0, var0, n0, mu1, var1, n1, CASE WHEN n0 >= 2 AND n1 >= 2 THEN 0.5 * (1.0 + {_erf('x')}) END AS binormal_auc FROM x",
    ("mu0", "var0", "mu1", "var1", "binormal_auc"),
)
#: The isotonic fit by its max-min formula.
FIT = (
    "h AS (SELECT p, sum(y) AS np, sum(1 - y) AS nn FROM scored GROUP BY p)",
    "c AS (SELECT *, row_number() OVER (ORDER BY p) AS k, sum(np) OVER (ORDER BY p) AS cp, sum(np + nn) OVER (ORDER BY p) AS cn FROM h)",
    "means AS (SELECT a.k AS i, b.k AS j, CAST(b.cp - a.cp + a.np AS DOUBLE) / CAST(b.cn - a.cn + a.np + a.nn AS DOUBLE) AS mean FROM c a JOIN c b ON a.k <= b.k)",
    "low AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS low FROM means)",
    "fit AS (SELECT p, fitted, np, nn FROM c JOIN (SELECT j AS k, max(low) AS fitted FROM low GROUP BY j) USING (k))",
)
R.add("pav_reliability", lambda s, d: scores.pooled_adjacent(scored(s, d)), with_sql(*S, *FIT) + "SELECT p, fitted, CAST(np AS BIGINT) AS np, CAST(nn AS BIGINT) AS nn FROM fit", ("fitted",))
R.add(
    "brier_decomposition",
    lambda s, d: scores.brier_decomposition(scored(s, d)),
    with_sql(*S, *FIT, "b AS (SELECT sum(np * (1 - p) * (1 - p) + nn * p * p) / sum(np + nn) AS brier, sum(np * (1 - fitted) * (1 - fitted) + nn * fitted * fitted) / sum(np + nn) AS fit, sum(np) / sum(np + nn) AS rate FROM fit)")
    + "SELECT brier, brier - fit AS mcb, rate * (1 - rate) - fit AS dsc, rate * (1 - rate) AS unc FROM b",
    ("brier", "mcb", "dsc", "unc"),
)
R.add(
    "block_bootstrap",
    lambda s, d: scores.block_bootstrap(scored(s, d)),
    with_sql(
        *S,
        "h AS (SELECT init_date, p, sum(y) AS np, sum(1 - y) AS nn FROM scored GROUP BY ALL)",
        "c AS (SELECT init_date, row_number() OVER (ORDER BY init_date) - 1 AS k FROM (SELECT DISTINCT init_date FROM h))",
        "n AS (SELECT count(*) AS n, greatest(1, least(3, count(*) // 5)) AS len FROM c)",
        "b AS (SELECT d, b, n, len, (((d * 1000003 + b * 7919 + 7 * 104729 + 1) % 2147483647 * 48271 % 2147483647) + b) % 2147483647 * 69621 % 2147483647 % n AS start FROM (SELECT n, len, unnest(range(CAST(ceil(n / len) AS BIGINT))) AS b FROM n), range(1000) r(d))",
        "t AS (SELECT d, (start + j) % n AS k, count(*) AS times FROM b, range(3) r(j) WHERE j < len AND b * len + j < n GROUP BY ALL)",
        "w AS (SELECT d, p, sum(np * times) AS np, sum(nn * times) AS nn FROM h JOIN c USING (init_date) JOIN t USING (k) GROUP BY ALL)",
        "u AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY d ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w)",
        "a AS (SELECT d, sum(np * (below + nn / 2)) / nullif(CAST(sum(np) AS DOUBLE) * sum(nn), 0) AS auc FROM u GROUP BY d)",
    )
    + "SELECT quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high, count(auc) AS draws FROM a",
    ("low", "high"),
)


def _curve(s: SparkSession, d: str) -> DataFrame:
    curve = written(scores.economic_value(scored(s, d)))
    near, top = scores.economic_value_at(curve, 0.2), scores.economic_value_peak(curve)
    return near.withColumn("kind", F.lit("at 0.2")).unionByName(top.withColumn("kind", F.lit("peak"))).select("kind", "alpha", F.round("value", 6).alias("value"))


R.add(
    "rev_lookup",
    _curve,
    with_sql(*S, *REV, f"curve AS ({CURVE})") + "(SELECT 'at 0.2' AS kind, alpha, round(value, 6) AS value FROM curve ORDER BY abs(alpha - 0.2), alpha LIMIT 1) UNION ALL (SELECT 'peak' AS kind, alpha, round(value, 6) AS value FROM curve ORDER BY value DESC, alpha LIMIT 1)",
)


def _loo(s: SparkSession, d: str) -> DataFrame:
    """Error of each cell's mean signed error, leaving the row's own week out."""
    from pyspark.sql import Window

    rows = event_rows(s, d).select("variable", F.weekofyear("valid_date").alias("week"), (F.col("fc_mean") - F.col("obs_mean")).alias("e"))
    cell, own = Window.partitionBy("variable"), Window.partitionBy("variable", "week")
    rest = F.try_divide(F.sum("e").over(cell) - F.sum("e").over(own), F.count("e").over(cell) - F.count("e").over(own))
    left = rows.select("variable", (F.col("e") - F.coalesce(rest, F.lit(0.0))).alias("r"))
    return left.groupBy("variable").agg(F.avg(F.col("r") * F.col("r")).alias("mse"), F.count(F.lit(1)).alias("n"))


R.add(
    "leave_one_out_mse",
    _loo,
    with_sql(*EVT, "r AS (SELECT variable, week(valid_date) AS week, fc_mean - obs_mean AS e FROM evt)", "l AS (SELECT variable, e - coalesce((sum(e) OVER c - sum(e) OVER o) / nullif(count(e) OVER c - count(e) OVER o, 0), 0) AS r FROM r WINDOW c AS (PARTITION BY variable), o AS (PARTITION BY variable, week))") + "SELECT variable, avg(r * r) AS mse, count(*) AS n FROM l GROUP BY 1",
    ("mse",),
)


def _degenerate(s: SparkSession, d: str) -> DataFrame:
    p, rows = F.col("p"), scored(s, d)
    shares = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((p >= 0.5).cast("double")).alias("high_share"), F.avg(((p > 0.99) | (p < 0.01)).cast("double")).alias("rail_share"))
    middle = quantiles(rows, p, {"low": 0.25, "high": 0.75}).select((F.col("high") - F.col("low")).alias("iqr"))
    return shares.crossJoin(F.broadcast(middle)).withColumn("usable", (F.col("n") >= 50) & (F.col("high_share") <= 0.6) & (F.col("rail_share") <= 0.1) & (F.col("iqr") > 0.02))


R.add("degeneracy_check", _degenerate, with_sql(*S, "a AS (SELECT count(*) AS n, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS high_share, avg(CASE WHEN p > 0.99 OR p < 0.01 THEN 1.0 ELSE 0.0 END) AS rail_share, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS iqr FROM scored)") + "SELECT *, n >= 50 AND high_share <= 0.6 AND rail_share <= 0.1 AND iqr > 0.02 AS usable FROM a", ("high_share", "rail_share", "iqr"))
