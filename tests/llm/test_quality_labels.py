"""The verdict against the labels, and a target counted over every trusted document."""

import pytest
from pyspark.sql import functions as F

from nimbora.llm import quality

DATA = "/root/testdata/sf0.01"


def test_all_trusted_documents_count(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.format_string("w%d", F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.fit_ratios(docs, labels, 8) == pytest.approx([0.0] * 8, abs=1e-12)


def test_error_rates_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("_top")).where("q = _top")
    rows = quality.judge_quality(docs.select("doc_id", "text"), labels).where("NOT base_failed").join(one, "doc_id").select("q", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["q"] == 1], [r["kept"] for r in rows if r["q"] == 0]
    assert len(good) > 100 and len(bad) > 10
    assert good.count(False) <= 0.02 * len(good)
    assert bad.count(True) <= 0.05 * len(bad)
