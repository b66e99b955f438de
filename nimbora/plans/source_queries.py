"""Queries on uploads and the canonical store: tables are written as a user's files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators.ordered import shared_folder
from nimbora.plans.registry import Registry
from nimbora.plans.views import FC, forecasts, table, with_sql
from nimbora.sources import canonical, canonical_store, uploads

R = Registry()


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/nimbora-{uuid.uuid4().hex}"


def _delimited(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 == 0, "-999").otherwise(F.col("c_nationkey").cast("string")).alias(" c_nationkey "), F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit("").alias("nothing"))
    rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return uploads.read_upload(s, path, "customers.txt")


R.add(
    "upload_delimited",
    _delimited,
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
)


def _monthly(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    month = F.element_at(F.array(*map(F.lit, uploads.MONTHS)), F.month("o_orderdate"))
    counts = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("PARAMETER"), F.year("o_orderdate").alias("YEAR"))
    wide = counts.agg(*[F.count(F.when(month == m, 1)).alias(m) for m in uploads.MONTHS])
    wide.withColumns({m: F.when(F.col(m) > 0, F.col(m).cast("string")).otherwise("-999") for m in uploads.MONTHS}).write.option("header", True).csv(path)
    return uploads.read_upload(s, path, "monthly.csv")


R.add(
    "upload_monthly",
    _monthly,
    """WITH y AS (SELECT DISTINCT o_orderpriority AS "PARAMETER", year(o_orderdate) AS yy FROM orders), m AS (SELECT * FROM y, range(1, 13) r(mm)),
c AS (SELECT o_orderpriority AS pp, year(o_orderdate) AS yy, month(o_orderdate) AS mm, count(*) AS n FROM orders GROUP BY ALL)
SELECT "PARAMETER", CAST(m.yy AS VARCHAR) AS "YEAR", CAST(n AS DOUBLE) AS value, make_date(m.yy, m.mm, 1) AS valid_date FROM m LEFT JOIN c ON pp = "PARAMETER" AND c.yy = m.yy AND c.mm = m.mm""",
)


def _daily(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    rows = table(s, d, "orders").select(F.year("o_orderdate").alias("YEAR"), F.dayofyear("o_orderdate").alias("DOY"), F.col("o_orderkey").alias("KEY"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return uploads.read_upload(s, path, "daily.tsv")


R.add("upload_daily", _daily, """SELECT CAST(year(o_orderdate) AS VARCHAR) AS "YEAR", CAST(dayofyear(o_orderdate) AS VARCHAR) AS "DOY", CAST(o_orderkey AS VARCHAR) AS "KEY", CAST(o_orderdate AS DATE) AS valid_date FROM orders""")


def _records(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    nations = table(s, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 1, "NA").otherwise(F.col("n_regionkey").cast("string")).alias("n_regionkey"))
    nations.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("records")))).write.text(path)
    return uploads.read_upload(s, path, "nations.json")


R.add("upload_json", _records, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey <> 1 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
R.add(
    "sentinel_counts",
    lambda s, d: uploads.sentinel_counts(table(s, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, "-9999").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("name"))),
    "SELECT 'segment' AS \"column\", count(*) FILTER (c_custkey % 7 = 0) AS n FROM customer UNION ALL SELECT 'name', count(*) FILTER (c_custkey % 5 = 0) FROM customer",
)


def _index(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "orders").select(F.concat_ws("  ", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit("0"), (F.col("o_orderkey") % 97 / 8).cast("string"), (F.col("o_orderkey") % 89 / -16).cast("string")).alias("value"))
    return uploads.index_readings(lines)


R.add("index_readings", _index, "SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey % 89 / -16 AS first, -(o_orderkey % 97 / 8) AS second, sqrt((o_orderkey % 89 / -16) ** 2 + (o_orderkey % 97 / 8) ** 2) AS amplitude FROM orders", ("first", "second", "amplitude"))
R.add(
    "header_words",
    lambda s, d: table(s, d, "part").select("p_partkey", canonical.spaced_header(F.concat("p_name", F.lit("(km/h) maxSpeed [x]"), "p_type")).alias("words"), canonical.header_fingerprint(F.array("p_type", "p_name")).alias("print")),
    r"""WITH h AS (SELECT p_partkey, p_name || '(km/h) maxSpeed [x]' || p_type AS a, p_type AS b, p_name AS c FROM part),
w AS (SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'), '[(\[{].*?[)\]}]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS words, k
  FROM (SELECT p_partkey, a AS x, 0 AS k FROM h UNION ALL SELECT p_partkey, b, 1 FROM h UNION ALL SELECT p_partkey, c, 2 FROM h))
SELECT p_partkey, max(CASE WHEN k = 0 THEN words END) AS words, sha256(list_aggregate(list_sort(list(words) FILTER (k > 0)), 'string_agg', '|')) AS print FROM w GROUP BY 1""",
)

#: How rows name their kind, and labels their variable, in the queries below.
KINDS = {"forecast": ["forecast", "fcst", "model"], "observed": ["observed", "obs", "actual"]}
NAMES = {"wind": ["wind speed", "ws"], "rain": ["rain", "total precipitation"], "pressure": ["surface pressure"]}


def _wide_upload(s: SparkSession, d: str) -> DataFrame:
    e, kinds = table(s, d, "events"), F.array(*[F.lit(x) for x in ("Forecast (GFS)", "OBS", None, "climate")])
    return e.select(
        (F.col("user_id") % 25).cast("string").alias("Station"), F.when(F.col("event_id") % 11 != 0, F.to_date("ts").cast("string")).alias("date"), F.when(F.col("event_id") % 3 == 0, F.date_sub(F.to_date("ts"), 2).cast("string")).alias("run"),
        ((F.col("event_id") % 14) * 12).cast("string").alias("hours"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("kind"), F.when(F.col("event_id") % 6 == 0, "n.d.").otherwise(F.col("value").cast("string")).alias("Wind (km/h)"), (F.col("value") * 100).cast("string").alias("p.sfc"),
        F.element_at(F.array(*[F.lit(x) for x in ("Wind Speed", "total rain", "surfacePressure", "other")]), (F.col("event_id") % 4 + 1).cast("int")).alias("label"),
    )


LAYOUT = canonical.Layout([canonical.Measured("Wind (km/h)", "wind", "observed", "kmh_to_ms"), canonical.Measured("p.sfc", "pressure", None, "Pa_to_hPa")], region="Station", valid_date="date", init_date="run", lead="hours", value_type="kind")
OUT = "variable, value_type, value, source_column, region, init_date, valid_date, lead_time_days, skipped"
UPLOAD = """up AS (SELECT CAST(user_id % 25 AS VARCHAR) AS region, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END AS v0, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) - 2 END AS i0, (event_id % 14) * 12 AS h,
  CASE event_id % 4 WHEN 0 THEN 'forecast' WHEN 1 THEN 'observed' END AS k, event_id % 4 AS q, CASE WHEN event_id % 6 <> 0 THEN value END AS wind, value * 100 AS p FROM events),
led AS (SELECT *, CAST(round_even(CASE WHEN h >= 24 THEN h / 24 ELSE h END, 0) AS INTEGER) AS l0 FROM up),
timed AS (SELECT *, coalesce(v0, i0 + l0) AS valid, coalesce(i0, v0 - l0) AS init FROM led),
cells AS (SELECT *, {cells})"""
FINAL = """SELECT variable, value_type, value, source_column, region, CASE WHEN value_type = 'forecast' THEN CAST(init AS DATE) END AS init_date, CAST(valid AS DATE) AS valid_date, CASE WHEN value_type = 'forecast' AND l0 BETWEEN 1 AND 10 THEN l0 END AS lead_time_days,
  CASE WHEN valid IS NULL THEN 'no valid_date' WHEN variable IS NULL THEN 'no variable' WHEN value_type IS NULL THEN 'no value_type' END AS skipped FROM cells WHERE value IS NOT NULL"""
R.add(
    "canonical_wide",
    lambda s, d: canonical.canonical_rows(_wide_upload(s, d), LAYOUT, KINDS).select(*OUT.split(", ")),
    "WITH " + UPLOAD.replace("cells AS (SELECT *, {cells})", "cells AS (SELECT *, 'wind' AS variable, coalesce(k, 'observed') AS value_type, wind / 3.6 AS value, 'Wind (km/h)' AS source_column FROM timed UNION ALL SELECT *, 'pressure', k, p / 100, 'p.sfc' FROM timed)") + FINAL,
    ("value",),
)
R.add(
    "canonical_long",
    lambda s, d: canonical.canonical_rows(_wide_upload(s, d), canonical.Layout([canonical.Measured("p.sfc", "", "observed")], region="Station", valid_date="date", init_date="run", lead="hours", value_type="kind", variable_name="label"), KINDS, NAMES).select(*OUT.split(", ")),
    "WITH " + UPLOAD.replace("cells AS (SELECT *, {cells})", "cells AS (SELECT *, CASE q WHEN 0 THEN 'wind' WHEN 1 THEN 'rain' WHEN 2 THEN 'pressure' END AS variable, coalesce(k, 'observed') AS value_type, p AS value, 'p.sfc' AS source_column FROM timed)") + FINAL,
    ("value",),
)


def _store(s: SparkSession, d: str) -> str:
    """A store of two batches: all forecasts as provisional rows, and those of even members again, later and final, some twice."""
    path = _folder(s)
    rows = forecasts(s, d).groupBy("region_id", "variable", "valid_date", "init_date", "lead_time_days", "member").agg(F.max("forecast_value").alias("value"))
    made = rows.select("variable", F.lit("forecast").alias("value_type"), "value", F.when(F.col("region_id") != 3, F.col("region_id").cast("string")).alias("region_id"), F.lit(1.5).alias("lat"), F.col("region_id").cast("double").alias("lon"), "valid_date", "init_date", "lead_time_days", F.col("member").cast("string").alias("ensemble_member_id"), F.concat_ws("|", "region_id", "variable", "valid_date", "init_date", "member").alias("record_id"))
    first = made.withColumns({"verification_status": F.lit("provisional"), "ingested_at": F.lit("2024-02-01 00:00:00")})
    even = made.where("ensemble_member_id IN ('0', '2', '4')").withColumns({"value": F.col("value") + 1, "ingested_at": F.lit("2024-01-01 00:00:00")})
    again = even.where("ensemble_member_id = '4'").withColumns({"value": F.col("value") + 1, "ingested_at": F.lit("2024-03-01 00:00:00")})
    canonical_store.append_batch(path, "a", first)
    canonical_store.append_batch(path, "b", first)
    canonical_store.append_batch(path, "b", even.unionByName(again))
    return path


STORED = """s AS (SELECT CASE WHEN region_id <> 3 THEN CAST(region_id AS VARCHAR) END AS region_id, variable, valid_date, init_date, CAST(member AS VARCHAR) AS member, max(forecast_value) + CASE WHEN member = 4 THEN 2 WHEN member IN (0, 2) THEN 1 ELSE 0 END AS value,
  CASE WHEN member IN (0, 2, 4) THEN 'b' ELSE 'a' END AS batch_id FROM fc GROUP BY fc.region_id, variable, valid_date, init_date, lead_time_days, fc.member)"""
R.add("canonical_store_read", lambda s, d: canonical_store.read_store(s, _store(s, d)).select("region_id", "variable", "valid_date", "init_date", F.col("ensemble_member_id").alias("member"), "value", "batch_id"), with_sql(FC, STORED) + "SELECT region_id, variable, valid_date, init_date, member, value, batch_id FROM s", ("value",))


def _compacted(s: SparkSession, d: str) -> DataFrame:
    path = _store(s, d)
    found = canonical_store.compact(s, path)
    spans = canonical_store.batch_spans(s, path)
    return spans.select("batch_id", "first_day", "last_day", "rows", *[F.lit(found[k]).cast("long").alias(k) for k in ("rows_before", "rows_after", "removed")])


R.add(
    "canonical_store_compact",
    _compacted,
    with_sql(FC, STORED, "t AS (SELECT count(*) AS after, count(*) + count(*) FILTER (batch_id = 'b') + count(*) FILTER (member = '4') AS before FROM s)") + "SELECT batch_id, min(valid_date) AS first_day, max(valid_date) AS last_day, count(*) AS rows, before AS rows_before, after AS rows_after, before - after AS removed FROM s, t GROUP BY ALL",
)
R.add(
    "forecast_history",
    lambda s, d: canonical_store.history(forecasts(s, d).withColumn("value_type", F.lit("forecast")), "2024-01-10").groupBy("region_id", "variable", "valid_date", "init_date").agg(F.avg("forecast_value").alias("fc_mean")),
    with_sql(FC) + "SELECT region_id, variable, valid_date, init_date, avg(forecast_value) AS fc_mean FROM fc WHERE init_date >= DATE '2024-01-01' AND init_date < DATE '2024-01-10' AND valid_date >= DATE '2024-01-10' GROUP BY ALL",
    ("fc_mean",),
)
R.add("safe_csv_text", lambda s, d: table(s, d, "customer").select("c_custkey", canonical_store.safe_text(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "", "x")]), (F.col("c_custkey") % 6 + 1).cast("int")), "c_name")).alias("text")), "SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN '''' ELSE '' END || CASE c_custkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN '' ELSE 'x' END || c_name AS text FROM customer")
