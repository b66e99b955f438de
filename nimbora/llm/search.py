"""Exact top-k search by inner product with a pivot-distance index.

With one more component, sqrt(M - |x|^2) for the largest squared norm M, every vector lies on a sphere, and the largest
inner products with a query are the smallest distances from it. Vectors are keyed by their nearest pivot and, in rings
of equal width, by their distance from it; each ring is cut into blocks of bounded size, sorted by that distance. A
query that knows k vectors within distance R needs, of a pivot at distance d, only the annulus from d - R to d + R: by
the triangle inequality nothing outside it is nearer than R. R comes first from the sample that the pivots were chosen
from, then from the annuli of the query's own pivot, and then the annuli of all other pivots are opened. Pivots grow
with the square root of the vectors, up to a bound; queries meet blocks, not rings, so a full ring is many tasks' work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.common import bounded_batches, materialise

#: Neighbours of a query, pivots at least and at most, and vectors that they are chosen from (a documented bound).
TOP, PIVOTS, MOST_PIVOTS, SAMPLE = 10, 16, 256, 2_048

#: Rings of a pivot, vectors of a block and queries of a block.
RINGS, BLOCK, QUERIES = 8, 2_048, 64

#: Guards the bounds against rounding.
MARGIN = 1e-6


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v (whole components) of the vectors that take part."""
    proper = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(proper)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows, filled up with zeros to ``width``."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    rows = np.zeros((len(sizes), width), np.int64)
    rows[np.arange(width) < sizes[:, None]] = flat
    return rows


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; in doubles where these hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


@dataclass
class Index:
    """What every task needs to know: a bounded number of pivots, rings and sample vectors."""

    width: int
    square: float
    pivots: np.ndarray
    ring: float
    sample_ids: np.ndarray
    sample: np.ndarray

    def distances(self, rows: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances from the pivots; queries are not lifted."""
        own = (rows.astype(float) ** 2).sum(axis=1)
        top = np.sqrt(np.maximum(self.square - own, 0.0)) if lifted else np.zeros(len(rows))
        points = np.column_stack([rows.astype(float), top])
        squares = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0.0))

    def radius(self, rows: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The distance at which a vector's product with each query is ``kth``."""
        own = (rows.astype(float) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(self.square + own - 2.0 * kth, 0.0)) * (1 + MARGIN) + MARGIN


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Points far from each other: from the first on, always the farthest from those chosen."""
    chosen = [0] if len(points) else []
    far = ((points - points[0]) ** 2).sum(axis=1) if len(points) else np.empty(0)
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def fit_index(vectors: DataFrame, pivots: int | None = None, sample: int = SAMPLE) -> Index | None:
    """Pivots and rings from the vectors of the smallest hashed ids, and the largest norm over all vectors.

    Without ``pivots``, their number is the square root of the number of full blocks, within the bounds above.
    """
    whole = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    if whole["width"] is None:
        return None
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    pivots = pivots or max(PIVOTS, min(MOST_PIVOTS, math.isqrt(whole["n"] // BLOCK)))
    width = max(whole["width"], 1)
    rows = matrix(picked.column("v").combine_chunks(), width)
    top = np.sqrt(np.maximum(whole["square"] - (rows.astype(float) ** 2).sum(axis=1), 0.0))
    points = np.column_stack([rows.astype(float), top])
    index = Index(width, whole["square"], choose_pivots(points, pivots), 1.0, picked.column("vec_id").to_numpy(), rows)
    reach = index.distances(rows, True).min(axis=1).max()
    index.ring = max(float(reach) / RINGS, 1e-9)
    return index


def _keys(index: Index):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = index.distances(matrix(batch.column("v"), index.width), True)
                pivot = away.argmin(axis=1)
                near = away.min(axis=1)
                # what lies farther out than the sample reached is in the last ring
                ring = np.minimum(near // index.ring, RINGS).astype(np.int32)
                cell = pivot.astype(np.int32) * (RINGS + 1) + ring
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "copies")), pa.array(cell), pa.array(near)], names=["vec_id", "v", "copies", "cell", "away"])

    return rows


def _visits(index: Index, cells: dict[int, tuple[float, float]], top: int, own_pivot: bool):
    """For each query the cells to open, at the pivot it is nearest to or at all others."""
    names = np.array(sorted(cells), np.int64)
    low, high = np.array([cells[c][0] for c in names]), np.array([cells[c][1] for c in names])
    of = names // (RINGS + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("query_id").to_numpy()
            v = matrix(batch.column("v"), index.width)
            scores = products(v, index.sample)
            scores = np.where(index.sample_ids == ids[:, None], np.iinfo(np.int64).min // 4, scores)
            known = np.sort(scores, axis=1)[:, -top] if scores.shape[1] > top else np.full(len(ids), np.iinfo(np.int64).min // 4)
            if not own_pivot:
                known = np.maximum(known, batch.column("kth").to_numpy())
            away = index.distances(v, False)
            reach = index.radius(v, known)
            home = away.argmin(axis=1)
            d = away[:, of]
            opened = (d - reach[:, None] <= high) & (d + reach[:, None] >= low) & ((of == home[:, None]) == own_pivot)
            lists = [names[o] for o in opened]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("v"), pa.array(known), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists)))],
                names=["query_id", "v", "known", "cells"],
            )

    return rows


def _compare(index: Index, top: int):
    """The best vectors of each (block of vectors, block of queries), as far as they may be among the best of all."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_v, out_s, out_c = ([np.empty(0, np.int64)] for _ in range(4))
            for i in range(batch.num_rows):
                items, asked = batch.column("items")[i].values, batch.column("asked")[i].values
                away = items.field("away").to_numpy()
                ids, copies, v = items.field("vec_id").to_numpy(), items.field("copies").to_numpy(), matrix(items.field("v"), index.width)
                query, q = asked.field("query_id").to_numpy(), matrix(asked.field("v"), index.width)
                known = asked.field("known").to_numpy()
                pivot = batch.column("cell")[i].as_py() // (RINGS + 1)
                d, reach = index.distances(q, False)[:, pivot], index.radius(q, known)
                first, last = np.searchsorted(away, d - reach), np.searchsorted(away, d + reach, side="right")
                for j in range(len(query)):
                    a, b = first[j], last[j]
                    if a >= b:
                        continue
                    score = products(q[j : j + 1], v[a:b])[0]
                    good = np.flatnonzero((score >= known[j]) & (ids[a:b] != query[j]))
                    good = good[np.lexsort((ids[a:b][good], -score[good]))[:top]]
                    out_q.append(np.full(len(good), query[j]))
                    out_v.append(ids[a:b][good])
                    out_s.append(score[good])
                    out_c.append(copies[a:b][good])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s, out_c)], names=["query_id", "vec_id", "score", "copies"])

    return rows


def top_neighbours(vectors: DataFrame, queries: DataFrame, top: int = TOP, pivots: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """The ``top`` vectors of ``vectors`` with the largest inner products for each of ``queries`` (both vec_id, embedding).

    Returns query_id, rank (from 1), vec_id, score; fewer rows where there are fewer vectors. Components become
    floor(1024 * x). A vector is no neighbour of the query with its own id. Ties go to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part, as queries or neighbours; shorter
    vectors count as filled up with zeros. Every row of ``vectors`` is a neighbour by itself: rows that repeat an id and
    vector take a rank each, and so do different vectors of one id. A query id is asked once; if its rows have several
    vectors, with the least of them, component by component. Empty tables give an empty result. Other columns are not
    read. Products must stay below 2**63.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    bounded_batches(vectors.sparkSession)
    # rows alike are one entry with a number of copies; in the sample each would raise the first bound
    taken = materialise(quantised(vectors).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")))
    index = fit_index(taken, pivots, sample)
    if index is None:
        return taken.sparkSession.createDataFrame([], schema)
    # of equal vectors only the first ids can be among the best, one more than asked for as a query skips itself
    among_equals = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    useful = taken.withColumn("_n", among_equals).where(F.col("_n") <= top + 1).drop("_n")
    keyed = materialise(useful.mapInArrow(_keys(index), "vec_id long, v array<bigint>, copies long, cell int, away double"))
    found = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    cells = {r["cell"]: (r["low"], r["high"]) for r in found}
    spark = taken.sparkSession
    shares = F.broadcast(spark.createDataFrame([(r["cell"], -(-r["n"] // BLOCK)) for r in found], "cell int, _blocks int"))  # a row for each ring
    dealt = keyed.join(shares, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int"))
    blocks = materialise(dealt.groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("away", "vec_id", "v", "copies"))).alias("items")))

    asked = materialise(quantised(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")))
    parts = max(1, -(-asked.count() // QUERIES))

    def search(wanted: DataFrame, own_pivot: bool) -> DataFrame:
        visits = wanted.mapInArrow(_visits(index, cells, top, own_pivot), "query_id long, v array<bigint>, known long, cells array<bigint>")
        each = visits.select("query_id", "v", "known", F.explode(F.col("cells").cast("array<int>")).alias("cell")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        grouped = each.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "v", "known")).alias("asked"))
        spread = grouped.join(shares, "cell").select("cell", "asked", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
        met = spread.join(blocks, ["cell", "block"]).select("cell", "items", "asked")
        return met.mapInArrow(_compare(index, top), "query_id long, vec_id long, score long, copies long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = materialise(search(asked, True))
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == top)
    kth = ranked.select("query_id", F.col("score").alias("kth"))
    bounded = materialise(asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-(2**62)))))
    both = near.unionByName(search(bounded, False))
    first = both.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top)
    rows = first.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top)))).alias("_copy"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
