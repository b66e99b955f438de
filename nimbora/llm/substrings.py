"""Substring dedup by sliding sentence spans.

A text is cut into sentences. A run is two or more consecutive sentences that together have enough words; a run whose
words occur again, anywhere in the table, keeps its first occurrence, by doc_id and place, and every sentence covered by
another occurrence is removed.

It is enough to hash the shortest runs, forward and backward from each sentence. Take a sentence of a longer repeated
run: either the shortest run forward from it ends within the longer one, or, with too few words left, the shortest run
backward from the longer one's end reaches back over it. That shortest run occurs wherever the longer one does, so it is
repeated too, and not at its first occurrence where the longer one is not. Tests compare with hashing every run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import bounded_batches, joined_with_hot, materialise

#: Sentences and words that a run must have.
SENTENCES, WORDS = 2, 25

#: A sentence: from a character that is no space to closing punctuation before a space, or to the line's end.
SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s|$)|(?=\n)|$)")


def sentence_starts(text: str) -> list[int]:
    """Where the sentences begin."""
    return [m.start() for m in SENTENCE.finditer(text)]


def runs(text: str, words: int = WORDS) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of sentences, and (hash, first, last) of each shortest run of sentences with enough words."""
    plain = [s.split() for s in SENTENCE.findall(text.lower())]
    sizes = [len(s) for s in plain]
    joined = [" ".join(s) for s in plain]
    found: set[tuple[int, int]] = set()
    last, total = -1, 0
    for first in range(len(sizes)):  # forward: the least last for each first
        while (total < words or last - first + 1 < SENTENCES) and last + 1 < len(sizes):
            last += 1
            total += sizes[last]
        if total < words or last - first + 1 < SENTENCES:
            break
        found.add((first, last))
        total -= sizes[first]
    first, total = len(sizes), 0
    for last in range(len(sizes) - 1, -1, -1):  # backward: the greatest first for each last
        while (total < words or last - first + 1 < SENTENCES) and first > 0:
            first -= 1
            total += sizes[first]
        if total < words or last - first + 1 < SENTENCES:
            break
        found.add((first, last))
        total -= sizes[last]
    return len(sizes), [(xxhash.xxh64_intdigest("\n".join(joined[a : b + 1]).encode()), a, b) for a, b in sorted(found)]


def _run_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            number, hashes, firsts, lasts, ends = [], [], [], [], [0]
            for text in batch.column("text"):
                n, own = runs(text.as_py() or "", words)
                number.append(n)
                hashes += [r[0] for r in own]
                firsts += [r[1] for r in own]
                lasts += [r[2] for r in own]
                ends.append(len(hashes))
            spans = pa.StructArray.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["hash", "first", "last"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(number, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["doc_id", "n_sentences", "spans"])

    return rows


def without(text: str, removed: list[int]) -> str:
    """The text without the sentences of these numbers, each with the space after it."""
    starts = sentence_starts(text)
    gone = set(removed)
    ends = [*starts[1:], len(text)]
    kept = [text[: starts[0]]] + [text[a:b] for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if i not in gone]
    return "".join(kept).rstrip()


def drop_repeated_spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Removes from ``text`` of each row of ``docs`` (doc_id, text, ...) what other places said first.

    Adds ``removed`` (sorted numbers of the removed sentences, counted from 0; empty where none) and replaces ``text``.
    Untouched texts stay as they are, to the character. Runs are told apart by 64-bit hashes of their lower-cased words.

    Null and empty texts have no sentences and stay. Rows with a null doc_id stay and do not count as occurrences. Rows
    that repeat a doc_id and text are judged alike, as one occurrence. Within a document later places of a run go
    too. A text all of whose sentences go becomes empty. An empty table gives an empty result. A column named removed
    is replaced, others stay. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    clear = docs.drop("removed", "_removed")
    texts = clear.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = materialise(texts.mapInArrow(_run_rows(words), "doc_id long, n_sentences long, spans array<struct<hash:bigint,first:int,last:int>>"))
    places = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.hash", "s.first", "s.last")
    at = F.struct("doc_id", "first")
    repeated = materialise(places.groupBy("hash").agg(F.min(at).alias("home"), F.max(at).alias("far"), F.count(F.lit(1)).alias("n")).where("home <> far").select("hash", "home", "n"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    later = joined_with_hot(places, repeated, "hash", "n", total).where(at != F.col("home"))
    spans_gone = later.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    numbers = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["first"], s["last"]))))
    gone = materialise(spans_gone.select("doc_id", F.sort_array(numbers).alias("_removed")))
    # always a shuffle: the removed sentences grow with the input
    joined = clear.where(F.col("doc_id").isNotNull()).join(gone.hint("shuffle_merge"), "doc_id", "left")
    # rows without an id would meet in one task
    joined = joined.unionByName(clear.where(F.col("doc_id").isNull()).withColumn("_removed", F.lit(None).cast("array<int>")))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        return pa.array([None if t is None else without(t, r) for t, r in zip(texts.to_pylist(), removed.to_pylist(), strict=True)], pa.string())

    touched = F.col("_removed").isNotNull()
    changed = cut(F.when(touched, F.col("text")), F.col("_removed"))
    text = F.when(touched, changed).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in clear.columns], F.coalesce("_removed", F.array().cast("array<int>")).alias("removed"))
