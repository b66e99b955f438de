"""Records of delimited files whose quoted fields may run over line ends.

Whether a line begins inside a quoted field depends on all lines before it. A line is a function of two states (inside or
outside a quoted field): it keeps the state, swaps it, or sets it. Such functions put together are again of this kind, so
each block of a file is summed up by one row, the blocks are put in order, and within a block the state before each line
is a running value. Lines that begin inside a field are joined to the record that began before them, across blocks too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbora.operators.ordered import written


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or at the start of one, ends inside one.

    A quote opens a field only as its first character; two quotes inside a field stand for one.
    """
    at = 0
    if not inside and line[:1] == '"':
        inside, at = True, 1
    while True:
        if inside:
            found = line.find('"', at)
            if found < 0:
                return True
            if line[found + 1 : found + 2] == '"':
                at = found + 2
                continue
            inside, at = False, found + 1
        found = line.find(separator, at)
        if found < 0:
            return False
        at = found + 1
        if line[at : at + 1] == '"':
            inside, at = True, at + 1


def _ends(separator: str):
    @F.arrow_udf("struct<outside:boolean,inside:boolean>")
    def ends(lines: pa.Array) -> pa.Array:
        texts = lines.to_pylist()
        states = [pa.array([ends_inside(t, separator, start) for t in texts], pa.bool_()) for start in (False, True)]
        return pa.StructArray.from_arrays(states, ["outside", "inside"])

    return ends


def file_lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The lines of one or more files, written: file, block, at (order within a block), value, and where the line ends if
    it begins outside (outside) or inside (inside) a quoted field.

    Lines end with a line feed; a carriage return before it stays with the value. Only lines with a quote are looked into.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    quoted = F.contains("value", F.lit('"'))
    looked = lines.withColumn("_ends", F.when(quoted, _ends(separator)(F.when(quoted, F.col("value")).otherwise(""))))
    return written(looked.select("file", "block", "at", "value", F.coalesce("_ends.outside", F.lit(False)).alias("outside"), F.coalesce("_ends.inside", F.lit(True)).alias("inside")))


def _states(rows: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
    """Adds ``state``: whether a row begins inside, given each row's function (outside, inside) and the group's ``start``."""
    w = Window.partitionBy(*by).orderBy(order)
    swapped = rows.withColumn("_swaps", F.sum((F.col("outside") & ~F.col("inside")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    sets = F.col("outside") == F.col("inside")
    # what a row sets, less the swaps up to there: with the swaps up to a later row it is the state there
    kept = F.when(sets, F.col("outside") != F.col("_swaps"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.last(kept, True).over(before), start)
    return swapped.withColumn("state", base != F.coalesce(F.lag("_swaps").over(w), F.lit(False))).drop("_swaps")


def records(lines: DataFrame) -> DataFrame:
    """Whole records of ``file_lines``: file, block, at (those of its first line), value. Raises if a file ends inside a field."""
    within = Window.partitionBy("file", "block").orderBy("at")
    # each block as one function of the state before it: the state after it, from either
    tried = [_states(lines, ["file", "block"], "at", F.lit(s)).select("file", "block", "at", F.when(F.col("state"), F.col("inside")).otherwise(F.col("outside")).alias("end")) for s in (False, True)]
    ends = [t.groupBy("file", "block").agg(F.max_by("end", "at").alias(name)) for t, name in zip(tried, ("outside", "inside"), strict=True)]
    blocks = written(ends[0].join(ends[1], ["file", "block"]))
    begun = written(_states(blocks, ["file"], "block", F.lit(False)))  # one row a block
    open_ = begun.groupBy("file").agg(F.max_by(F.when(F.col("state"), F.col("inside")).otherwise(F.col("outside")), "block").alias("open")).where("open").select("file").limit(1).collect()
    if open_:
        raise ValueError(f"a quoted field is not closed: {open_[0][0]}")
    told = _states(lines.join(begun.select("file", "block", F.col("state").alias("_start")), ["file", "block"]), ["file", "block"], "at", F.col("_start"))
    told = written(told.withColumn("first", F.last(F.when(~F.col("state"), F.struct("block", "at")), True).over(within)))
    # lines at a block's head may belong to a record of an earlier block: the last one that began there
    last = told.groupBy("file", "block").agg(F.max("first").alias("last"))
    carried = last.select("file", "block", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    placed = told.join(carried, ["file", "block"]).withColumn("first", F.coalesce("first", "_carried"))
    alone = ~F.col("state") & ~F.col("outside")
    one = placed.where(alone).select("file", "block", "at", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    several = placed.where(~alone).groupBy("file", "first").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))
    return one.unionByName(several.select("file", F.col("first.block").alias("block"), F.col("first.at").alias("at"), "value")).withColumn("value", F.regexp_replace("value", "\r$", ""))
