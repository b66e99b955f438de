"""Running sums over a whole table's order, without a task that holds it all.

Rows are dealt by ranges of the order and written once. Each range is summed by itself; the sums of the ranges before it,
one row a range, are added.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where none is set on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame) -> DataFrame:
    """``df`` as written Parquet: read by several steps, and not computed again when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/nimbora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, and bytes, that go to a Python worker at once (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches at BATCH_ROWS and BATCH_BYTES or less; smaller settings are left as they are."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = int(spark.conf.get(name).rstrip("b"))
        if not 0 < found <= most:
            spark.conf.set(name, str(most))


def by_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` written in ranges of ``order``, with the range's number in ``_range``."""
    return written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], by: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Adds the running sum of each column of ``sums`` (name of the sum to column) in ``order``, within each of ``by``.

    With ``inclusive`` the row itself counts. ``order`` must tell the rows of a group apart; sums of nothing are 0.
    """
    by = by or []
    dealt = by_ranges(rows, [*map(F.col, by), *order])
    # a row for each range and group that it holds part of: few, as a range holds neighbours in order
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_of_{s}") for s, c in sums.items()])
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_of_{s}").over(before), F.lit(0)).alias(f"_at_{s}") for s in sums])
    inner = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{s}") for s, c in sums.items()])
    # groups meet null-safely, so that null is a group like others
    named = starts.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "_range"]})
    same = F.col("_range") == F.col("_of__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    made = own.join(F.broadcast(named) if not by else named, same).drop(*[f"_of_{c}" for c in [*by, "_range"]])
    return made.withColumns({s: F.col(f"_in_{s}") + F.col(f"_at_{s}") for s in sums}).drop("_range", *[f"_{k}_{s}" for k in ("in", "at") for s in sums])
