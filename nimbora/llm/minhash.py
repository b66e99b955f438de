"""MinHash near-duplicates by one-permutation hashing.

A document's set holds the hashes of its distinct runs of four words. One permutation of the hashes deals them into
BINS bins and keeps the least of each; an empty bin takes the value of the first filled bin in an order of its own
(optimal densification), so equal bins are as likely as the sets are similar, in sets of few elements too. ROWS bins
make a band, and documents that agree on a band meet in its bucket. Two documents at the threshold agree on a band with
a chance of 0.8 ** 4 = 0.41, and on none of the 64 bands with one of about 2 in 10 ** 15.

A bucket offers stars: its documents are paired with its first and its last one, so pairs are as many as members. What
links on the full sets is contracted to components. Only documents of a bucket that are still in different components
are then compared with each other, block by block; if there are more than CROWD of them in a bucket, because they share
a passage, they go through the parity-sketch join, which leaves out what is frequent and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm import jaccard
from nimbora.llm.common import HOT, bounded_batches, materialise
from nimbora.llm.graphs import components

#: Words of a shingle.
SHINGLE = 4

#: Bins of a signature, a power of two, and bins of a band.
BINS, ROWS = 256, 4

#: Documents of a bucket that are compared with each other; larger buckets go through the parity-sketch join.
CROWD = 4_096


def _orders() -> np.ndarray:
    """For each bin, an order of all bins, by a hash of both."""
    pairs = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    return np.argsort(jaccard._mixed(jaccard._mixed(pairs + np.uint64(0x9E3779B97F4A7C15))), axis=1)


ORDERS = _orders()
TAGS = jaccard._mixed(np.arange(1, BINS // ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def signature(elements: np.ndarray) -> np.ndarray:
    """The least value of each bin, empty bins filled from others; ``elements`` holds one element at least."""
    values = np.sort(jaccard._mixed(elements + np.uint64(0x632BE59BD9B4E019)))
    bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    least = np.zeros(BINS, np.uint64)
    least[bins[first]] = values[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        orders = ORDERS[empty]
        least[empty] = least[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    return least


def band_keys(elements: np.ndarray) -> np.ndarray:
    """One bucket for each band of a set's signature."""
    values = signature(elements).reshape(-1, ROWS)
    key = TAGS.copy()
    for k in range(ROWS):
        key = jaccard._mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[bytes] = set()  # copies within a task are signed once, as far as they are remembered
    for batch in batches:
        n, high, low, ends, keys = [], [], [], [0], []
        for text in batch.column("text"):
            elements = jaccard.shingle_set(text.as_py(), SHINGLE)
            digest, upper, lower = jaccard.copy_digest(elements)
            n.append(len(elements))
            high.append(upper)
            low.append(lower)
            if len(elements) and digest not in met:
                if len(met) == jaccard.REMEMBERED:
                    met.clear()
                met.add(digest)
                keys.append(band_keys(elements))
                ends.append(ends[-1] + len(keys[-1]))
            else:
                ends.append(ends[-1])
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["doc_id", "n_shingles", "high", "low", "buckets"],
        )


def _crowds(texts: DataFrame, members: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stands in for the buckets ``crowds`` (part, rep, low, high): the links of their stars, and parts of parity
    sketches for the documents of those buckets that the stars leave in different components."""
    sets = jaccard.sets_of(texts, crowds.select(F.col("rep").alias("id")), SHINGLE)
    links = jaccard.star_links(crowds, sets)
    found = components(links)
    placed = crowds.join(found, crowds["rep"] == found["id"], "left").select("part", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = materialise(placed.groupBy("part").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("part"))
    left = materialise(crowds.join(mixed, "part", "left_semi").select(F.col("rep").alias("doc_id")).distinct())
    sketched = jaccard.sketched_documents(texts.join(left, "doc_id", "left_semi"), None, SHINGLE)
    classes = left.select("doc_id", F.col("doc_id").alias("rep")).join(members.select("doc_id", "n_shingles").distinct(), "doc_id")
    return links, jaccard.shared_parts(sketched, classes.select("doc_id", "n_shingles", "rep"))


def _met(named: DataFrame, ends: DataFrame) -> DataFrame:
    """Each document (rep) of ``named`` with those of its buckets that ``ends`` has: part, rep, low, high, members.

    Fewer than HOT buckets have more than one in HOT of all rows; they are told apart within a document's list, and
    their rows stay where they are. The rest is shuffled, where no bucket has more rows than that.
    """
    total = ends.agg(F.sum("members")).first()[0] or 0
    hot = ends.where(F.col("members") > total / HOT)
    dealt = named.crossJoin(F.broadcast(hot.agg(F.collect_list("part").alias("_hot"))))
    few = dealt.select("rep", F.explode(F.array_intersect("buckets", "_hot")).alias("part")).join(F.broadcast(hot), "part")
    many = dealt.select("rep", F.explode(F.array_except("buckets", "_hot")).alias("part")).join(ends.hint("merge"), "part")
    return few.unionByName(many)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """n_shingles and component_id of each row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Two documents link when the Jaccard similarity of their sets of four-word shingles is 0.8 or more; every link is
    confirmed on the full sets (64-bit hashes of shingles). component_id is the smallest doc_id that links reach, and
    kept says whether a document is it.

    Null, empty and blank texts have no shingles and link with nothing, not even each other. Rows that repeat a doc_id
    count as linked with each other if they have words. A similarity of exactly 0.8 links. Rows with a null doc_id are
    left out. An empty table gives an empty result. Other columns are not read. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, high long, low long, buckets array<bigint>"
    signed = materialise(texts.mapInArrow(_bucket_rows, schema))
    members = jaccard.copies_classed(signed)
    named = materialise(signed.where(F.size("buckets") > 0).join(members.select("doc_id", "rep").distinct(), "doc_id").select("rep", "buckets"))
    ends = materialise(named.select("rep", F.explode("buckets").alias("part")).groupBy("part").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high"))
    met = materialise(_met(named, ends).distinct())
    shared = met.where(F.col("members") <= CROWD).select("part", "rep", "low", "high")
    crowds = met.where(F.col("members") > CROWD).select("part", "rep", "low", "high")
    links = None
    if not crowds.isEmpty():
        links, parts = _crowds(texts, members, crowds)
        shared = materialise(shared.union(parts))
    found = jaccard.confirmed(texts, members, shared, SHINGLE, links)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
