"""Readers, canonical rows and the store on small files."""

import json

import pytest
from pyspark.sql import functions as F

from nimbora.sources import canonical, canonical_store, records, uploads


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_climate_header_is_skipped_and_days_are_dated(spark, tmp_path):
    path = put(tmp_path, "power.csv", "-BEGIN HEADER-\nNASA, something\n-END HEADER-\n\nYEAR,DOY,T2M ,EMPTY\n2023,1,5.5,\n2023,32,-999,\n2024,60,NA,\n,5,1,\n")
    out = uploads.read_upload(spark, path)
    assert out.columns == ["YEAR", "DOY", "T2M", "valid_date"]
    assert [(r["YEAR"], r["T2M"], str(r["valid_date"])) for r in out.collect()] == [("2023", "5.5", "2023-01-01"), ("2023", None, "2023-02-01"), ("2024", None, "2024-02-29"), (None, "1", "None")]


def test_months_become_rows(spark, tmp_path):
    months = ",".join(uploads.MONTHS)
    path = put(tmp_path, "monthly.csv", f"PARAMETER,YEAR,{months}\nT2M,2020,{','.join(map(str, range(12)))}\nRH,2021,{','.join(['-999'] * 12)}\n")
    out = rows(uploads.read_upload(spark, path).orderBy("PARAMETER", "valid_date"))
    assert len(out) == 24 and out[0][:3] == ("RH", "2021", None) and out[12][:3] == ("T2M", "2020", 0.0) and str(out[23][3]) == "2020-12-01" and out[23][2] == 11.0


@pytest.mark.parametrize(("name", "text", "want"), [("a.tsv", "a\tb\n1\tx,y\n", [("1", "x,y")]), ("a.txt", "a;b\n1;2\n3;4\n", [("1", "2"), ("3", "4")]), ("a.csv", 'a,b\n1,"x, ""y"""\n', [("1", 'x, "y"')]), ("a.csv", "a|b\n1|2\n", [("1", "2")])])
def test_delimiters(spark, tmp_path, name, text, want):
    assert rows(uploads.read_upload(spark, put(tmp_path, name, text))) == want


def test_json_records(spark, tmp_path):
    flat = [{"a ": 1, "b": "x"}, {"a ": -999, "b": None}]
    for text in (json.dumps(flat), json.dumps({"rows": flat}), json.dumps({"results": flat}, indent=1)):
        assert rows(uploads.read_upload(spark, put(tmp_path, "a.json", text))) == [("1", "x"), (None, None)]
    for refused in ({"type": "FeatureCollection", "features": []}, [{"a": {"b": 1}}], [{"a": [1, 2]}], {"type": "Feature", "a": 1}):
        with pytest.raises(uploads.UnreadableUpload):
            uploads.read_upload(spark, put(tmp_path, "b.json", json.dumps(refused))).collect()
    with pytest.raises(uploads.UnreadableUpload):
        uploads.read_upload(spark, put(tmp_path, "c.csv", "\n\n"))


def test_parquet_loses_empty_columns(spark, tmp_path):
    spark.createDataFrame([(1, None, "-999")], "a int, b string, c string").write.parquet(f"{tmp_path}/t.parquet")
    assert rows(uploads.read_upload(spark, f"{tmp_path}/t.parquet")) == [(1, "-999")]


def test_headers(spark):
    names = ["windSpeed(km/h)", "  Wind_Speed [m] ", "T2M", ""]
    out = rows(spark.createDataFrame([(n,) for n in names], "n string").select(canonical.spaced_header(F.col("n"))))
    assert [r[0] for r in out] == ["wind speed", "wind speed", "t2m", ""]
    same = spark.createDataFrame([(["B", "aX"], ["a x", "b"])], "p array<string>, q array<string>").select(canonical.header_fingerprint(F.col("p")) == canonical.header_fingerprint(F.col("q")))
    assert rows(same) == [(True,)]


def test_canonical_rows_of_odd_values(spark):
    layout = canonical.Layout([canonical.Measured("v", "t", None, "K_to_C")], valid_date="d", init_date="i", lead="l", value_type="k")
    data = [("300", "2024-01-03", None, "48", "fcst"), ("300", None, "2024-01-01", "36", "Forecast"), ("300", None, None, "5", "obs"), ("x", "2024-01-03", None, None, "obs"), ("300", "not a day", "2024-01-01", None, "obs"), ("300", "2024-01-03", None, None, "climate"), ("300", "2024-01-20", "2024-01-01", None, "model")]
    out = canonical.canonical_rows(spark.createDataFrame(data, "v string, d string, i string, l string, k string"), layout, {"forecast": ["forecast", "fcst", "model"], "observed": ["obs", "observed"]})
    got = [(r["value_type"], str(r["init_date"]), str(r["valid_date"]), r["lead_time_days"], r["skipped"]) for r in out.collect()]
    assert got == [
        ("forecast", "2024-01-01", "2024-01-03", 2, None),
        ("forecast", "2024-01-01", "2024-01-03", 2, None),
        ("observed", "None", "None", None, "no valid_date"),
        ("observed", "None", "None", None, "no valid_date"),
        (None, "None", "2024-01-03", None, "no value_type"),
        ("forecast", "2024-01-01", "2024-01-20", None, None),
    ]
    assert abs(out.first()["value"] - 26.85) < 1e-9


def made(spark, data):
    return spark.createDataFrame(data, "region_id string, variable string, value string, valid_date string, verification_status string, ingested_at string, record_id string, extra int")


def test_store_batches(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    assert canonical_store.read_store(spark, store).count() == 0 and canonical_store.read_store(spark, store).columns[0] == "record_id"
    one = made(spark, [("r", "t", "1", "2024-01-01", "provisional", "2024-02-01", "a", 1), (None, "t", "2", "bad", None, None, "b", 1)])
    assert canonical_store.append_batch(store, "x", one) == 2 and canonical_store.append_batch(store, "none", one.limit(0)) == 0
    assert canonical_store.append_batch(store, "y", made(spark, [("r", "t", "5", "2024-01-01", "final", "2024-01-01", "c", 1)])) == 1
    assert canonical_store.batch_ids(spark, store) == ["x", "y"]
    got = {(r["record_id"], r["value"], r["batch_id"], r["valid_date"] is None) for r in canonical_store.read_store(spark, store).collect()}
    assert got == {("c", 5.0, "y", False), ("b", 2.0, "x", True)}  # final before later provisional; a bad date is null
    assert canonical_store.append_batch(store, "y", made(spark, [("r", "t", "7", "2024-01-01", "final", "2024-01-01", "d", 1)])) == 1  # in place of the first
    canonical_store.refuse_excluded(spark, store, {"z"})
    with pytest.raises(ValueError):
        canonical_store.refuse_excluded(spark, store, {"y", "z"})
    assert canonical_store.compact(spark, store) == {"rows_before": 3, "rows_after": 2, "removed": 1, "batches": 2}
    assert canonical_store.append_batch(store, "w", made(spark, [("r", "t", "9", "2024-01-01", "final", "2025-01-01", "e", 1)])) == 1
    assert canonical_store.compact(spark, store)["batches"] == 2 and canonical_store.batch_ids(spark, store) == ["w", "x"]  # a batch with nothing left goes
    spans = canonical_store.batch_spans(spark, store)
    assert {r["batch_id"]: r["rows"] for r in spans.collect()} == {"w": 1, "x": 1} and all(r["bytes"] > 0 for r in spans.collect())
    assert {r["batch_id"] for r in canonical_store.reaching_year(spans, 2023).collect()} == {"w", "x"}  # near enough; no known days
    assert {r["batch_id"] for r in canonical_store.reaching_year(spans, 2030).collect()} == {"x"}


def test_a_failed_append_leaves_the_batch(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    good = made(spark, [("r", "t", "1", "2024-01-01", None, None, "a", 1)])
    canonical_store.append_batch(store, "x", good)
    with pytest.raises(Exception):  # noqa: B017
        canonical_store.append_batch(store, "x", good.withColumn("value", F.raise_error(F.lit("stop"))))
    assert [r["value"] for r in canonical_store.read_store(spark, store).collect()] == [1.0]


def test_csv_is_safe_and_quoted(spark, tmp_path):
    data = spark.createDataFrame([("=1+1", 'a "b", c', 2), ("plain", None, 3)], "x string, `y,z` string, n int")
    canonical_store.write_csv(data, f"file://{tmp_path}/out")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split("\r\n")[0] == 'x,"y,z",n' and "\"'=1+1\"" not in text.split("\r\n")[0]
    assert set(text.split("\r\n")[1:]) == {'\'=1+1,"a ""b"", c",2', "plain,,3", ""}


def test_has_cycle(spark):
    rows = spark.createDataFrame([("forecast", "2024-01-01")] * 3 + [("observed", "2024-01-02")], "value_type string, init_date string").withColumn("init_date", F.col("init_date").cast("date"))
    assert canonical_store.has_cycle(rows, "2024-01-01", 3) and not canonical_store.has_cycle(rows, "2024-01-01", 4) and not canonical_store.has_cycle(rows, "2024-01-02", 1)


QUOTED = [
    ('a,b\n1,"x\ny"\n2,z\n', [("1", "x\ny"), ("2", "z")]),
    ("a,b\n1,2\na,b\n3,4\n", [("1", "2"), ("a", "b"), ("3", "4")]),
    ('a,b\r\n1,"x, ""y"",\r\n\r\nz"\r\n\r\n5,6\r\n', [("1", 'x, "y",\r\n\r\nz'), ("5", "6")]),
    ('"a\nb",c\n1,5" pipe\n2,3" pipe\n"q",""\n', [("1", '5" pipe'), ("2", '3" pipe'), ("q", None)]),
    ('a,b\n"1\n""2""\n3","4\n5"\n6,"7"\n', [('1\n"2"\n3', "4\n5"), ("6", "7")]),
]


@pytest.mark.parametrize(("text", "want"), QUOTED)
@pytest.mark.parametrize("block", ["128m", "5"])
def test_quotes_over_lines(spark, tmp_path, text, want, block):
    """Also with blocks of 5 bytes, so that records run over several of them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = uploads.read_upload(spark, put(tmp_path, "a.csv", text)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_a_field_that_is_not_closed_is_refused(spark, tmp_path):
    with pytest.raises(uploads.UnreadableUpload):
        uploads.read_upload(spark, put(tmp_path, "a.csv", 'a,b\n1,"x\n2,3\n'))


def test_states_against_the_csv_module():
    """Where a line ends, against a reader that is fed the lines one by one."""
    import csv
    import random

    rng = random.Random(4)
    for _ in range(2000):
        lines = ["".join(rng.choice('ab,"" ') for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 5))]
        state, starts = False, []
        for line in lines:
            if not state:
                starts.append(line)
            state = records.ends_inside(line, ",", state)
        fed = iter([f"{x}\n" for x in lines])
        count = sum(1 for _ in csv.reader(fed))
        assert state or count == len(starts)
