"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper-case ASCII letters and their lower-case forms, by position.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where none is set on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


#: Rows, and bytes, that go to a Python worker at once (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches at BATCH_ROWS and BATCH_BYTES or less, so that a task's memory does not grow
    with its rows. The settings stay in the session; smaller ones are left as they are."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = int(spark.conf.get(name).rstrip("b"))
        if not 0 < found <= most:
            spark.conf.set(name, str(most))


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage so that a lost executor costs a re-read instead of a recomputation, and lets several later
    steps read one result. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/nimbora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text column, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fenced(df: DataFrame, passed: list[Column], computed: list[Column]) -> DataFrame:
    """Selects both lists of columns, the second behind a generator.

    A filter on a computed column would otherwise be moved below the projections that compute it, with their
    expressions put into each other and evaluated many times.
    """
    return df.select(*passed, F.inline(F.array(F.struct(*computed))))


#: A value is hot when more than one row in HOT has it, so there are fewer than HOT such values.
HOT = 1_000


def joined_with_hot(rows: DataFrame, found: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``found``, which has one row for each value of ``key`` and the number of its rows in ``weight``.

    The hot values (more than ``total`` / HOT rows each, ``total`` being the sum of all weights) are fewer than HOT, so
    they are broadcast and their rows stay where they are; the rest is shuffled, where no value has more rows than that.
    """
    hot = F.col(weight) > total / HOT
    few = found.where(hot)
    many = found.where(~hot)
    met_hot = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return met_hot.unionByName(rest.join(many.hint("merge"), key))


#: Buckets that numbering deals all rows into, at the least, and rows of a bucket where that would be too few.
BUCKETS, BUCKET_ROWS = 4_096, 100_000


def with_row_number(df: DataFrame) -> DataFrame:
    """Writes ``df`` with a number in ``_row`` that tells its rows apart, and reads it back."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()))


def numbered(df: DataFrame, key: str, sizes: dict) -> DataFrame:
    """Adds ``rank_in_key``: 0, 1, 2, ... without gaps within each value of ``key``, in no stated order.

    ``df`` comes from ``with_row_number``; ``sizes`` gives the rows of each value, of which there must be few. A plain
    window over a hot key would put all its rows into one task, so each key's rows are dealt, by a hash of their number,
    into as many buckets as its share of all rows asks for. Each bucket is numbered by itself and starts where the key's
    earlier buckets end. Rows alike in everything else are dealt like others.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    per_bucket = max(1, min(BUCKET_ROWS, sum(sizes.values()) // BUCKETS))
    shares = spark.createDataFrame([(k, max(1, -(-n // per_bucket))) for k, n in sizes.items()], f"{key} {kind}, _buckets long")
    dealt = df.join(F.broadcast(shares), key).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets"))).drop("_buckets")
    filled = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select(key, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(key, "_bucket").orderBy("_row")
    placed = dealt.withColumn("_place", F.row_number().over(inner) - 1)
    return (
        placed.join(starts, [key, "_bucket"])
        .withColumn("rank_in_key", (F.col("_place") + F.col("_start")).cast("long"))
        .drop("_place", "_start", "_bucket", "_row")
    )
