"""Queries on the store, ingest, grids and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.functions import moisture
from nimbora.functions.circular import separation, wrapped
from nimbora.operators import grids, ingest, store
from nimbora.operators.ordered import written
from nimbora.operators.quantiles import quantiles
from nimbora.plans.registry import Registry
from nimbora.plans.views import EVENT, FC, forecasts, table, with_sql

R = Registry()

R.add(
    "store_dedupe_latest",
    lambda s, d: store.latest(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice"),
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
)
R.add(
    "store_filter_projection",
    lambda s, d: store.read(table(s, d, "lineitem"), ["l_orderkey", "l_quantity"], {"l_returnflag": ["R", "A"]}, {"l_discount": (0.05, 0.07)}),
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_discount BETWEEN 0.05 AND 0.07",
)
R.add("store_distinct_cycles", lambda s, d: forecasts(s, d).select("init_date").distinct().orderBy(F.desc("init_date")).limit(10), with_sql(FC) + "SELECT DISTINCT init_date FROM fc ORDER BY init_date DESC LIMIT 10")
R.add("store_batch_spans", lambda s, d: forecasts(s, d).groupBy("member").agg(F.min("valid_date").alias("first_day"), F.max("valid_date").alias("last_day"), F.count(F.lit(1)).alias("n")), with_sql(FC) + "SELECT member, min(valid_date) AS first_day, max(valid_date) AS last_day, count(*) AS n FROM fc GROUP BY 1")


def _typed(s: SparkSession, d: str) -> DataFrame:
    return forecasts(s, d).withColumn("value_type", F.when(F.col("member") < 3, "forecast").otherwise("observed")).withColumn("status", F.when(F.col("member") == 4, "provisional"))


R.add("store_summary_counts", lambda s, d: store.summary(_typed(s, d), ["forecast", "observed"]), with_sql(FC) + "SELECT variable, count(*) FILTER (member < 3) AS n_forecast, count(*) FILTER (member >= 3) AS n_observed, count(DISTINCT region_id) AS regions, min(valid_date) AS first_day, max(valid_date) AS last_day FROM fc GROUP BY 1")
R.add("store_provisional_exclusion", lambda s, d: store.read(_typed(s, d), [*EVENT, "variable"], include_provisional=False).groupBy("variable").agg(F.count(F.lit(1)).alias("n")), with_sql(FC) + "SELECT variable, count(*) AS n FROM fc WHERE member <> 4 GROUP BY 1")
R.add(
    "key_coverage_antijoin",
    lambda s, d: store.missing_keys(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]),
    "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
R.add("sentinel_to_null", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(ingest.without_sentinels(F.floor(F.col("value")).cast("double"), [10.0, 99.0])).alias("n"), F.count(F.lit(1)).alias("n_rows")), "SELECT event_type, count(*) FILTER (floor(value) NOT IN (10, 99)) AS n, count(*) AS n_rows FROM events GROUP BY 1")
HEAD = "regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
R.add("header_normalize", lambda s, d: table(s, d, "part").select("p_partkey", ingest.plain_header(F.col("p_name")).alias("header")), f"SELECT p_partkey, {HEAD} AS header FROM part")
R.add(
    "jaccard_headers",
    lambda s, d: table(s, d, "part").select("p_partkey", ingest.token_overlap(ingest.plain_header(F.col("p_name")), ingest.plain_header(F.col("p_type"))).alias("overlap")),
    f"SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS overlap FROM (SELECT p_partkey, list_distinct(string_split({HEAD}, '_')) AS a, list_distinct(string_split({HEAD.replace('p_name', 'p_type')}, '_')) AS b FROM part)",
    ("overlap",),
)
R.add("numeric_fraction", lambda s, d: ingest.numeric_share(table(s, d, "events").select(F.expr("CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS string) END AS cell")), "cell"), "SELECT count(try_cast(cell AS DOUBLE)) / count(cell) AS numeric_share FROM (SELECT CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS cell FROM events)", ("numeric_share",))
R.add("json_property", lambda s, d: table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
R.add(
    "wide_to_long",
    lambda s, d: ingest.to_long(table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")), ["l_suppkey"], ["quantity", "discount", "tax"]),
    "UNPIVOT (SELECT l_suppkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1) ON quantity, discount, tax INTO NAME variable VALUE value",
    ("value",),
)
R.add("doy_to_date", lambda s, d: table(s, d, "orders").select("o_orderkey", ingest.day_of_year(F.year("o_orderdate"), F.dayofyear("o_orderdate")).alias("day")), "SELECT o_orderkey, CAST(make_date(year(o_orderdate), 1, 1) + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS DATE) AS day FROM orders")
R.add(
    "unit_convert",
    lambda s, d: table(s, d, "events").select("event_id", ingest.converted(F.col("value"), F.element_at(F.array(*[F.lit(u) for u in ("K", "F", "Pa", "m", "fraction", "C")]), (F.col("event_id") % 6 + 1).cast("int"))).alias("value")),
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN value - 273.15 WHEN 1 THEN (value - 32) * 5 / 9 WHEN 2 THEN value / 100 WHEN 3 THEN value * 1000 WHEN 4 THEN value * 100 ELSE value END AS value FROM events",
    ("value",),
)


def _dates(s: SparkSession, d: str) -> DataFrame:
    e = forecasts(s, d)
    holes = e.select("region_id", "member", "lead_time_days", "init_date", "valid_date", F.when(F.col("member") != 0, F.col("init_date")).alias("i"), F.when(F.col("member") != 1, F.col("valid_date")).alias("v"), F.when(F.col("member") != 2, F.col("lead_time_days")).alias("l"))
    init, valid, lead = ingest.dates(F.col("i"), F.col("v"), F.col("l"))
    return holes.select("region_id", init.alias("init_date"), valid.alias("valid_date"), lead.alias("lead_time_days"))


R.add(
    "time_reconcile",
    _dates,
    with_sql(FC, "holes AS (SELECT region_id, CASE WHEN member <> 0 THEN init_date END AS i, CASE WHEN member <> 1 THEN valid_date END AS v, CASE WHEN member <> 2 THEN lead_time_days END AS l FROM fc)")
    + "SELECT region_id, CAST(coalesce(i, v - l) AS DATE) AS init_date, CAST(coalesce(v, i + l) AS DATE) AS valid_date, CAST(coalesce(l, datediff('day', i, v)) AS INTEGER) AS lead_time_days FROM holes",
)
R.add("region_resolve_exact", lambda s, d: ingest.resolve(table(s, d, "nation").select(F.upper(F.concat(F.lit(" "), "n_name")).alias("label")), table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("region_id")), "label"), "SELECT upper(' ' || n_name) AS label, n_nationkey AS region_id FROM nation")
CELLS = "SELECT l_suppkey, l_quantity AS w, nullif(l_discount, 0.05) AS x, l_tax * 4000 AS a FROM lineitem"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("w"), F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("x"), (F.col("l_tax") * 4000).alias("a"))


R.add("weighted_area_mean", lambda s, d: grids.weighted_mean(_cells(s, d), ["l_suppkey"], "x", "w"), f"SELECT l_suppkey, sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) AS mean, count(x) AS n FROM ({CELLS}) GROUP BY 1", ("mean",))
R.add("weighted_circular_mean", lambda s, d: grids.weighted_direction(_cells(s, d), ["l_suppkey"], "a", "w"), f"SELECT l_suppkey, ((degrees(atan2(sum(w * sin(radians(a))) / sum(w), sum(w * cos(radians(a))) / sum(w))) % 360) + 360) % 360 AS direction FROM ({CELLS}) GROUP BY 1", ("direction",))
R.add("complete_day_filter", lambda s, d: grids.complete_days(forecasts(s, d), ["region_id", "valid_date"], 16).groupBy("region_id").agg(F.count(F.lit(1)).alias("n")), with_sql(FC) + "SELECT region_id, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY region_id, valid_date) AS c FROM fc) WHERE c >= 16 GROUP BY 1")
R.add("daily_reduce", lambda s, d: grids.daily(table(s, d, "events").withColumn("day", F.to_date("ts")), ["day", "event_type"], "value"), "SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS mean, CASE WHEN count(value) = count(*) THEN sum(value) END AS total, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY ALL", ("mean", "total"), 6)
R.add(
    "grid_quantise",
    lambda s, d: grids.quantised(table(s, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "code", "restored"),
    "SELECT event_id, CAST(round_even((value - m) / st, 0) AS INTEGER) AS code, CAST(round_even((value - m) / st, 0) AS INTEGER) * st + m AS restored FROM (SELECT *, greatest(0.01, (max(value) OVER w - min(value) OVER w) / 65534) AS st, min(value) OVER w + (max(value) OVER w - min(value) OVER w) / 2 AS m FROM events WINDOW w AS (PARTITION BY event_type))",
    ("restored",),
)
R.add(
    "range_coalesce",
    lambda s, d: grids.merged_ranges(table(s, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), 5).alias("b")), ["l_suppkey"], "a", "b"),
    """WITH r AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + 5 AS b FROM lineitem),
f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY a, b) AS island FROM f)
SELECT l_suppkey, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY l_suppkey, island""",
)
HOURS = "greatest(0.0, (least(epoch(o_orderdate) + 86400, epoch(o_orderdate) + 97200) - greatest(epoch(o_orderdate), epoch(o_orderdate) + 10800)) / 3600)"
R.add("window_overlap_hours", lambda s, d: table(s, d, "orders").select("o_orderkey", grids.overlap_hours(F.col("o_orderdate").cast("timestamp"), F.expr("o_orderdate + interval 24 hours").cast("timestamp"), F.expr("o_orderdate + interval 3 hours").cast("timestamp"), F.expr("o_orderdate + interval 27 hours").cast("timestamp")).alias("hours")), f"SELECT o_orderkey, {HOURS} AS hours FROM orders", ("hours",))


def _humidity(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", (260 + F.col("value") / 12).alias("t"), (95000 + F.col("value") * 10).alias("p"), (F.col("event_id") % 100 + 1.0).alias("rh"), (F.col("value") - 200).alias("u"), (F.col("event_id") % 50 - 25.5).alias("v"))
    q = moisture.humidity_from_relative(F.col("rh"), F.col("t"), F.col("p"))
    return e.select("event_id", (q * 1000).alias("q"), moisture.relative_humidity(q, F.col("t"), F.col("p")).alias("rh"), moisture.wind_speed(F.col("u"), F.col("v")).alias("speed"), moisture.wind_from(F.col("u"), F.col("v")).alias("direction"))


R.add(
    "humidity_wind",
    _humidity,
    """WITH e AS (SELECT event_id, 260 + value / 12 AS t, 95000 + value * 10 AS p, event_id % 100 + 1.0::DOUBLE AS rh, value - 200 AS u, event_id % 50 - 25.5::DOUBLE AS v FROM events),
s AS (SELECT *, 611.2 * exp(17.67 * (t - 273.15) / (t - 29.65)) AS es FROM e), q AS (SELECT *, 0.622 * (rh / 100 * es) / (p - 0.378 * (rh / 100 * es)) AS qq FROM s)
SELECT event_id, qq * 1000 AS q, greatest(0.0, least(100.0, 100 * (qq * p / (0.622 + 0.378 * qq)) / es)) AS rh, sqrt(u * u + v * v) AS speed, ((270 - degrees(atan2(v, u))) % 360 + 360) % 360 AS direction FROM q""",
    ("q", "rh", "speed", "direction"),
)
R.add(
    "circular_difference",
    lambda s, d: table(s, d, "events").select("event_id", separation(F.col("value"), F.col("event_id") * 7.0).alias("apart"), wrapped(F.col("value") - F.col("event_id") * 7.0).alias("turn")),
    "SELECT event_id, least(abs(value - event_id * 7.0::DOUBLE) % 360, 360 - abs(value - event_id * 7.0::DOUBLE) % 360) AS apart, (((value - event_id * 7.0::DOUBLE + 180) % 360) + 360) % 360 - 180 AS turn FROM events",
    ("apart", "turn"),
)
R.add("cycle_completeness", lambda s, d: forecasts(s, d).groupBy("init_date").agg(F.countDistinct("variable", "member").alias("have"), F.countDistinct("lead_time_days").alias("leads")).withColumn("complete", (F.col("have") == 25) & (F.col("leads") == 10)), with_sql(FC) + "SELECT init_date, count(DISTINCT (variable, member)) AS have, count(DISTINCT lead_time_days) AS leads, count(DISTINCT (variable, member)) = 25 AND count(DISTINCT lead_time_days) = 10 AS complete FROM fc GROUP BY 1")


def _rank(s: SparkSession, d: str) -> DataFrame:
    """Rank correlation of order value with that of the customer's order before, by market segment."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = table(s, d, "orders").withColumn("before", F.lag("o_totalprice").over(w)).where("before IS NOT NULL").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))

    def rank(c: str):
        by = Window.partitionBy("c_mktsegment")
        return F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("c_mktsegment", c)) - 1) / 2

    ranked = pairs.select("c_mktsegment", rank("o_totalprice").alias("a"), rank("before").alias("b"))
    return ranked.groupBy("c_mktsegment").agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n")).where("n >= 30")


R.add(
    "lag_rank_correlation",
    _rank,
    """WITH p AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
q AS (SELECT * FROM p JOIN customer ON o_custkey = c_custkey WHERE before IS NOT NULL),
r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY c_mktsegment, o_totalprice) - 1) / 2 AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY before) + (count(*) OVER (PARTITION BY c_mktsegment, before) - 1) / 2 AS b FROM q)
SELECT c_mktsegment, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 30""",
    ("rho",),
)


def _site_bias(s: SparkSession, d: str) -> DataFrame:
    sites = written(quantiles(table(s, d, "lineitem"), F.col("l_extendedprice"), {"m": 0.5}, ["l_suppkey"]))
    return sites.crossJoin(F.broadcast(quantiles(sites, F.col("m"), {"mm": 0.5}))).where("m > 1.05 * mm").select("l_suppkey", "m")


R.add("site_bias_pairs", _site_bias, "WITH s AS (SELECT l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey, m FROM s WHERE m > 1.05 * (SELECT median(m) FROM s)", ("m",), 4)
R.add(
    "stratified_sample_hash",
    lambda s, d: store.stratified_sample(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"], 25).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"),
    "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber)), l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 25",
)


def _rings(s: SparkSession, d: str) -> DataFrame:
    """Lozenges by the nations' numbers, and which customers' points lie in which; bounds first, then the even-odd rule."""
    n = table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 400.0 - 800).alias("cx"))
    ring = F.array(*[F.struct((F.col("cx") + dx).alias("x"), F.lit(y).alias("y")) for dx, y in ((191.37, 10.0), (0.0, 20.0), (-191.37, 10.0), (0.0, 0.0))])
    rings = n.select("n_nationkey", "cx", ring.alias("ring"))
    points = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 30 + 0.5).alias("y"))
    near = points.join(F.broadcast(rings), (F.col("x") >= F.col("cx") - 191.37) & (F.col("x") <= F.col("cx") + 191.37))  # a row for each of 25 nations
    return near.where(grids.inside(F.col("x"), F.col("y"), F.col("ring"))).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max(grids.ring_area(F.col("ring"))).alias("area"))


R.add("point_in_polygon", _rings, "SELECT n_nationkey, count(*) AS n, max(3827.4::DOUBLE) AS area FROM customer JOIN nation ON abs(c_acctbal - (n_nationkey * 400.0 - 800)) / 191.37 + abs(c_custkey % 30 + 0.5 - 10) / 10 < 1 GROUP BY 1", ("area",), 6)
