"""A cycle is released once, when all of its parts have come, by state that a stream keeps for each cycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RELEASED = "cycle string, status string, parts int"
STATE = "seen array<int>, told string"


def _part_number(steps: list[int], variables: list[str]) -> dict[tuple[int, str], int]:
    return {(s, v): k for k, (s, v) in enumerate((s, v) for s in steps for v in variables)}


def released(arrivals: DataFrame, steps: list[int], variables: list[str], patience_ms: int) -> DataFrame:
    """``arrivals`` (a stream of cycle, step, variable) made a stream of cycle, status, parts.

    A cycle is ``whole`` once each of ``variables`` has come for each of ``steps``, in any order and any number of batches;
    that is said once, and what comes later or again changes nothing. If a cycle gets nothing new for ``patience_ms`` it is said
    once to be ``missing`` parts; should these come after all, it is still released. Parts that are not asked for are
    left out. The state of a cycle holds a number for each part that has come, and no more once it is whole.
    """
    number = _part_number(steps, variables)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told = (set(state.get[0]), state.get[1]) if state.exists else (set(), "")
        out = None
        if state.hasTimedOut:
            if not told:
                told, out = "missing", "missing"
            state.update((sorted(seen), told))
        else:
            before = len(seen)
            if told != "whole":
                for pdf in frames:
                    seen.update(k for k in map(number.get, zip(pdf["step"].tolist(), pdf["variable"].tolist())) if k is not None)
                if len(seen) == len(number):
                    told, out, seen = "whole", "whole", set()
            state.update((sorted(seen), told))
            if told == "" or len(seen) > before:
                state.setTimeoutDuration(patience_ms)
        if out is not None:
            yield pd.DataFrame({"cycle": [key[0]], "status": [out], "parts": [len(number) if out == "whole" else len(seen)]})

    lean = arrivals.select(F.col("cycle").cast("string").alias("cycle"), F.col("step").cast("int").alias("step"), "variable").where("cycle IS NOT NULL AND step IS NOT NULL AND variable IS NOT NULL")
    return lean.groupBy("cycle").applyInPandasWithState(update, RELEASED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, steps: list[int], variables: list[str], patience_ms: int = 6 * 3_600_000, files: int = 1_000) -> StreamingQuery:
    """Takes in all files that have come since the last run and appends what is released to ``target``; restarts go on from ``checkpoint``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    writer = released(stream, steps, variables, patience_ms).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    # a query with timers would go on with empty batches for ever; timers that are due fire with the next files instead
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)
