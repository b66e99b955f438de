"""Queries on quantiles by rank, footers, snapshots, covers, look-ups of regions, neighbours and released cycles."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import baselines, buckets, ingest, regions, soil, store
from nimbora.operators.ordered import shared_folder, written
from nimbora.operators.quantiles import quantiles
from nimbora.plans.forecast_queries import EVT, event_rows
from nimbora.plans.registry import Registry
from nimbora.plans.score_queries import S, scored
from nimbora.plans.source_queries import _store
from nimbora.plans.views import EVENT, FC, VARIABLES, forecasts, table, with_sql
from nimbora.sources import canonical_store, scored_cycles, uploads
from nimbora.streaming import release

R = Registry()


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/nimbora-{uuid.uuid4().hex}"


R.add(
    "quantiles_by_group",
    lambda s, d: quantiles(table(s, d, "lineitem"), F.col("l_extendedprice"), {"q10": 0.1, "q50": 0.5, "q90": 0.9}, ["l_returnflag", "l_linestatus"], "n"),
    "SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.9) AS q90, count(*) AS n FROM lineitem GROUP BY ALL",
    ("q10", "q50", "q90"),
    4,
)


def _quoted(s: SparkSession, d: str) -> DataFrame:
    """Customers as a file with line ends and delimiters in quotes, and rows that look like the header."""
    path = _folder(s)
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit('"'), "c_name", F.lit('\n""of"", '), "c_mktsegment", F.lit('\n"'))).when(k % 11 == 0, F.lit("name")).otherwise(F.col("c_name"))
    line = F.concat_ws(",", F.when(k % 11 == 0, "key").otherwise(k.cast("string")), name, F.col("c_nationkey"))
    head = s.range(1).select(F.lit("key,name,nation").alias("value")).coalesce(1)
    head.write.text(f"{path}/a")
    table(s, d, "customer").select(line.alias("value")).coalesce(1).write.text(f"{path}/b")
    # one file: the header and what follows it
    s.read.option("wholetext", True).text(f"{path}/a").union(s.read.option("wholetext", True).text(f"{path}/b")).coalesce(1).select(F.regexp_replace("value", "\n$", "").alias("value")).write.text(f"{path}/c")
    return uploads.read_upload(s, f"{path}/c", "customers.csv")


R.add(
    "upload_quoted_breaks",
    _quoted,
    """SELECT CASE WHEN c_custkey % 11 = 0 THEN 'key' ELSE CAST(c_custkey AS VARCHAR) END AS "key", CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '"of", ' || c_mktsegment || chr(10) WHEN c_custkey % 11 = 0 THEN 'name' ELSE c_name END AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""",
)
R.add("store_cycles_by_footers", lambda s, d: canonical_store.cycles(s, _store(s, d)), with_sql(FC) + "SELECT DISTINCT init_date FROM fc")


def _spans(s: SparkSession, d: str) -> DataFrame:
    path = _store(s, d)
    signature = canonical_store.signature(s, path)
    return canonical_store.batch_spans(s, path).select("batch_id", "first_day", "last_day", "rows", F.lit(signature == canonical_store.signature(s, path)).alias("same_signature"))


R.add(
    "store_spans_by_footers",
    _spans,
    with_sql(FC, "g AS (SELECT region_id, variable, valid_date, init_date, lead_time_days, member FROM fc GROUP BY ALL)", "rows_ AS (SELECT 'a' AS batch_id, valid_date, 1 AS n FROM g UNION ALL SELECT 'b', valid_date, CASE WHEN member = 4 THEN 2 ELSE 1 END FROM g WHERE member IN (0, 2, 4))")
    + "SELECT batch_id, min(valid_date) AS first_day, max(valid_date) AS last_day, CAST(sum(n) AS BIGINT) AS rows, true AS same_signature FROM rows_ GROUP BY 1",
)


def _scored_cycle(s: SparkSession, d: str) -> DataFrame:
    """Scored events by run, written, replaced, pruned and read back."""
    path, day = _folder(s), dt.date(2024, 1, 1)
    rows, parts = written(scored(s, d).select(*EVENT, "p", "y")), event_rows(s, d).select(*EVENT, "variable", "actual_err")
    scored_cycles.write_scored_cycle(path, "old", day, rows.limit(1), parts.limit(1))
    scored_cycles.write_scored_cycle(path, "new", day, rows.limit(1), parts.limit(1))
    scored_cycles.write_scored_cycle(path, "new", day, rows, parts)
    dropped = scored_cycles.prune_scored_cycles(s, path, "new", [day])
    found = scored_cycles.read_scored_cycle(s, path, "new", day)
    counts = found["per_variable"].groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n_variables"))
    return found["events"].join(counts, EVENT).groupBy("init_date").agg(F.count(F.lit(1)).alias("n"), F.sum("n_variables").alias("n_variables"), F.sum("y").cast("long").alias("busts")).withColumn("dropped", F.lit(",".join(dropped)))


R.add(
    "scored_cycle_store",
    _scored_cycle,
    with_sql(*S) + "SELECT init_date, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_variables, CAST(sum(y) AS BIGINT) AS busts, 'old__20240101' AS dropped FROM scored JOIN (SELECT region_id, init_date, valid_date, lead_time_days, count(*) AS k FROM evt GROUP BY ALL) USING (region_id, init_date, valid_date, lead_time_days) GROUP BY 1",
)


def _cover(s: SparkSession, d: str) -> DataFrame:
    """The buckets that tile a day, for each order: its lines are buckets of three to twelve hours."""
    start = (F.col("l_partkey") + F.col("l_linenumber")) % 8 * 3
    rows = table(s, d, "lineitem").select("l_orderkey", start.cast("int").alias("start_hour"), (start + (F.col("l_suppkey") % 4 + 1) * 3).cast("int").alias("end_hour"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("bucket_id"))
    merged = rows.withColumn("l_orderkey", F.col("l_orderkey") % 500)
    return buckets.exact_cover(merged.withColumnRenamed("l_orderkey", "day"), ["day"], F.lit(0), F.lit(24))


R.add(
    "bucket_cover",
    _cover,
    """WITH RECURSIVE b AS (SELECT l_orderkey % 500 AS day, CAST((l_partkey + l_linenumber) % 8 * 3 AS INTEGER) AS a, CAST((l_partkey + l_linenumber) % 8 * 3 + (l_suppkey % 4 + 1) * 3 AS INTEGER) AS z, CAST(l_partkey * 10 + l_linenumber AS BIGINT) AS id FROM lineitem),
n AS (SELECT day, a, z, id FROM (SELECT *, row_number() OVER (PARTITION BY day, a ORDER BY z DESC, id) AS k FROM b WHERE z <= 24) WHERE k = 1),
w(day, place, a, z, id) AS (SELECT day, 0, a, z, id FROM n WHERE a = 0 UNION ALL SELECT w.day, w.place + 1, n.a, n.z, n.id FROM w JOIN n ON n.day = w.day AND n.a = w.z)
SELECT day, place, a AS start_hour, z AS end_hour, id AS bucket_id FROM w WHERE day IN (SELECT day FROM w WHERE z = 24)""",
)

#: An L for each nation, three degrees apart, and where it is told apart in SQL: two boxes.
L_SHAPE = ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0))


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nation = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    rings = nation.select(k.cast("string").alias("region_id"), F.array(*[F.struct((k % 5 * 3.0 + a).alias("x"), (F.floor(k / 5) * 3.0 + b).alias("y")) for a, b in L_SHAPE]).alias("ring"))
    registry = nation.select(k.cast("string").alias("region_id"), F.col("n_name").alias("name"), F.col("r_name").alias("state"))
    states = table(s, d, "region").select(F.concat(F.lit("S"), "r_regionkey").alias("region_id"), F.col("r_name").alias("name"))
    c = F.col("c_custkey")
    named = table(s, d, "customer").join(nation, F.col("c_nationkey") == k)
    rows = named.select(
        c.alias("row_id"),
        F.when(c % 7 == 0, F.upper("n_name")).when(c % 7 == 1, k.cast("string")).when(c % 7 == 2, F.lower("r_name")).when(c % 7 == 3, F.lit("nowhere")).alias("name"),
        F.when(c % 14 == 0, "AFRICA").alias("state"),
        F.when(c % 3 != 0, (c * 37 % 1000) / 55.0 - 1.003).alias("x"),
        (c * 61 % 1000 / 55.0 - 1.007).alias("y"),
    )
    return rows, registry, states, rings


R.add(
    "region_lookup_chain",
    lambda s, d: regions.look_up(*_asked(s, d)).select("row_id", "region_id", "method"),
    """WITH n AS (SELECT n_nationkey AS k, n_name, r_name, n_regionkey, n_nationkey % 5 * 3.0::DOUBLE AS bx, n_nationkey // 5 * 3.0::DOUBLE AS by_ FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey AS row_id, k, r_name, n_name, n_regionkey, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 37 % 1000) / 55.0::DOUBLE - 1.003::DOUBLE END AS x, (c_custkey * 61 % 1000) / 55.0::DOUBLE - 1.007::DOUBLE AS y FROM customer JOIN n ON c_nationkey = k),
a AS (SELECT row_id, n.k AS r, sqrt(greatest(bx - x, 0, x - bx - 2) ** 2 + greatest(by_ - y, 0, y - by_ - 1) ** 2) AS d1, sqrt(greatest(bx - x, 0, x - bx - 1) ** 2 + greatest(by_ - y, 0, y - by_ - 2) ** 2) AS d2 FROM c, n WHERE x IS NOT NULL),
g AS (SELECT row_id, r, least(d1, d2) AS apart, row_number() OVER (PARTITION BY row_id ORDER BY least(d1, d2), CAST(r AS VARCHAR)) AS o FROM a),
p AS (SELECT row_id, CAST(r AS VARCHAR) AS r, apart FROM g WHERE o = 1 AND apart <= 1.5),
w AS (SELECT c.row_id, CASE WHEN c.row_id % 7 = 1 THEN CAST(k AS VARCHAR) END AS by_id, CASE WHEN c.row_id % 7 = 0 AND (c.row_id % 14 <> 0 OR r_name = 'AFRICA') THEN CAST(k AS VARCHAR) END AS by_name, p.r, p.apart, CASE WHEN c.row_id % 7 = 2 THEN 'S' || n_regionkey END AS by_state FROM c LEFT JOIN p ON p.row_id = c.row_id)
SELECT row_id, coalesce(by_id, by_name, r, by_state) AS region_id, CASE WHEN by_id IS NOT NULL THEN 'region_id' WHEN by_name IS NOT NULL THEN 'name' WHEN apart = 0 THEN 'point_in_polygon' WHEN r IS NOT NULL THEN 'nearest_polygon' WHEN by_state IS NOT NULL THEN 'state_name' END AS method FROM w""",
)


def _features(s: SparkSession, d: str) -> DataFrame:
    """Events as points: lead, mean and largest spread, and how many variables are known; numbered by their keys."""
    rows = event_rows(s, d).groupBy(*EVENT).agg(F.coalesce(F.avg("spread"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("most"), F.count(F.lit(1)).alias("k"))
    made = rows.join(scored(s, d).select(*EVENT, "y"), EVENT)
    day = F.datediff("valid_date", F.lit("2020-01-01").cast("date"))
    return made.select(((F.col("region_id") * 100_000 + day) * 11 + F.col("lead_time_days")).cast("long").alias("id"), F.array(F.col("lead_time_days").cast("double"), F.round("mean", 6), F.round("most", 6), F.col("k").cast("double")).alias("v"), F.col("y").alias("label"))


R.add(
    "baseline_analog_events",
    lambda s, d: baselines.analog_probability(_features(s, d), F.col("id") % 20 == 0, 50)[0],
    with_sql(*S, "f AS (SELECT region_id, init_date, valid_date, lead_time_days, coalesce(avg(spread), 0) AS a, coalesce(max(spread), 0) AS b, count(*) AS c FROM evt GROUP BY ALL)", "v AS (SELECT (region_id * 100000 + datediff('day', DATE '2020-01-01', valid_date)) * 11 + lead_time_days AS id, lead_time_days::DOUBLE AS l, round(a, 6) AS a, round(b, 6) AS b, c::DOUBLE AS c, y FROM f JOIN scored USING (region_id, init_date, valid_date, lead_time_days))", "m AS (SELECT avg(l) AS ml, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(l) AS sl, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM v)", "z AS (SELECT id, y, (l - ml) / coalesce(nullif(sl, 0), 1) AS l, (a - ma) / coalesce(nullif(sa, 0), 1) AS a, (b - mb) / coalesce(nullif(sb, 0), 1) AS b, (c - mc) / coalesce(nullif(sc, 0), 1) AS c FROM v, m)", "r AS (SELECT q.id AS query_id, z.y, row_number() OVER (PARTITION BY q.id ORDER BY round((q.l - z.l) ** 2 + (q.a - z.a) ** 2 + (q.b - z.b) ** 2 + (q.c - z.c) ** 2, 9), z.id) AS k FROM z JOIN z q ON q.id <> z.id WHERE q.id % 20 = 0)")
    + "SELECT CAST(query_id AS BIGINT) AS query_id, avg(y) AS p FROM r WHERE k <= 50 GROUP BY 1",
    ("p",),
)
R.add("analog_pairs_opened", lambda s, d: baselines.analog_probability(_features(s, d), F.col("id") % 20 == 0, 50)[1])


def _released(s: SparkSession, d: str) -> DataFrame:
    """Runs whose leads have all come, by a stream over two lots of files with a restart between them."""
    base, schema = _folder(s), "cycle string, step int, variable string"
    rows = forecasts(s, d).select(F.col("init_date").cast("string").alias("cycle"), F.col("lead_time_days").alias("step"), "variable", "member")
    for k in (0, 1):
        rows.where(F.col("member") % 2 == k).drop("member").write.mode("append").parquet(f"{base}/in")
        release.run(s, f"{base}/in", schema, f"{base}/out", f"{base}/state", list(range(1, 11)), VARIABLES).awaitTermination()
    return s.read.schema(release.RELEASED).parquet(f"{base}/out")


R.add("cycles_released", _released, with_sql(FC) + "SELECT CAST(init_date AS VARCHAR) AS cycle, 'whole' AS status, 50 AS parts FROM (SELECT DISTINCT init_date, lead_time_days, variable FROM fc) GROUP BY init_date HAVING count(*) = 50")
R.add(
    "key_coverage_missing",
    lambda s, d: store.missing_keys(forecasts(s, d).where("variable = 'click'"), forecasts(s, d).where("variable = 'view'"), ["region_id", "valid_date", "lead_time_days"]),
    with_sql(FC) + "SELECT DISTINCT region_id, valid_date, lead_time_days FROM fc c WHERE variable = 'click' AND NOT EXISTS (SELECT 1 FROM fc v WHERE v.variable = 'view' AND v.region_id = c.region_id AND v.valid_date = c.valid_date AND v.lead_time_days = c.lead_time_days)",
)


def _gate(s: SparkSession, d: str) -> DataFrame:
    """Which variables a column of numbers may stand for, by the share of a sample in their ranges."""
    cells = table(s, d, "lineitem").select("l_shipmode" if "l_shipmode" in table(s, d, "lineitem").columns else "l_returnflag", F.col("l_quantity").cast("string").alias("q"), F.col("l_extendedprice").cast("string").alias("p"), F.when(F.col("l_linenumber") == 1, "x").otherwise(F.col("l_discount").cast("string")).alias("r"))
    return ingest.range_scores(cells, ["q", "p", "r"], {"humidity": (0.0, 100.0), "pressure": (500.0, 110_000.0), "fraction": (0.0, 0.05)}, 0.6)


R.add(
    "range_score_gate",
    _gate,
    """WITH c AS (SELECT 'q' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'p', l_extendedprice FROM lineitem UNION ALL SELECT 'r', l_discount FROM lineitem WHERE l_linenumber <> 1),
v AS (SELECT * FROM (VALUES ('humidity', 0.0, 100.0), ('pressure', 500.0, 110000.0), ('fraction', 0.0, 0.05)) t(variable, lo, hi))
SELECT "column", variable, avg(CASE WHEN x BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN x BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) >= 0.6 AS plausible FROM c, v GROUP BY ALL""",
    ("share",),
)


def _soil_mask(s: SparkSession, d: str) -> DataFrame:
    """Regions excluded for soil: cells are suppliers, saturated in most cycles where they are always dear."""
    line = table(s, d, "lineitem")
    fields = line.select(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("init_date"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 50).alias("value"))
    cells = table(s, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("region_id"), (F.col("s_suppkey") % 3 + 1).cast("double").alias("weight"), (F.col("s_suppkey") % 10 / 9).alias("land"))
    return soil.excluded_regions(soil.sea_cells(fields, 0.4, 0.65), cells, 0.5)


R.add(
    "soil_land_mask",
    _soil_mask,
    """WITH f AS (SELECT l_suppkey AS cell, avg(CASE WHEN l_quantity / 50 >= 0.4 THEN 1.0 ELSE 0.0 END) >= 0.65 AS sea FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1),
c AS (SELECT s_nationkey AS region_id, (s_suppkey % 3 + 1)::DOUBLE AS w, s_suppkey % 10 / 9 < 0.5 AS water, coalesce(sea, false) AS sea FROM supplier LEFT JOIN f ON cell = s_suppkey)
SELECT region_id, sum(CASE WHEN sea THEN w ELSE 0 END) / sum(w) AS sea_share, sum(CASE WHEN water THEN w ELSE 0 END) / sum(w) AS water_share, sum(CASE WHEN sea THEN w ELSE 0 END) / sum(w) > 0.5 AS excluded FROM c GROUP BY 1""",
    ("sea_share", "water_share"),
)
