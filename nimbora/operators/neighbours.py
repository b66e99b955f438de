"""Exact nearest neighbours with pruning: leaf boxes of a k-d tree over standardised features.

The tree's splits come from a bounded sample of the rows, so the tree is small; every row is put into its leaf, and the
boxes are those of all rows. A query first looks into its own leaf, which bounds the distance of its k-th neighbour, and
then only into the leaves whose boxes are nearer than that bound. Leaves are cut into blocks of bounded size.

Where boxes prune little (many components) and all rows ask, ``nearest_of_all`` compares every pair instead: blocks of
queries meet blocks of rows in a product that is read from files, and a task keeps the best of the rows that it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.operators.ordered import bounded_batches, written

#: Rows that the splits are found on, rows of a leaf as far as the sample tells, and leaves at most.
SAMPLE, LEAF, LEAVES = 20_000, 1_024, 2_048

#: Rows of a block of a leaf, and queries that meet it at a time.
BLOCK, ASKED = 2_048, 64

#: Visits of leaves that a task gives out at a time (one query's more at most).
VISITS = 20_000

#: Bytes of rows that a task of ``nearest_of_all`` compares its queries with (about), and blocks of queries of a task.
KNOWN_BYTES, ASKED_BLOCKS = 64 << 20, 2

#: Numbers of a piece in which distances are made.
PIECE = 1 << 22

#: Places to which squared distances are rounded, so that ties do not hang on the order of a sum.
PLACES = 9

FOUND = "query_id long, id long, label long, d double"

#: A block of rows: their ids and labels, and their components one row after the other.
ROWS = "ids array<long>, labels array<long>, v array<double>"


def _splits(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column, bound, left, right) of a tree that halves the widest column; children below 0 are leaves -1 - number."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal count
        widths = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(sample.shape[1])
        column = int(widths.argmax()) if len(widths) else 0
        if wanted < 2 or len(rows) < 2 or widths[column] == 0:
            count += 1
            return -count
        bound = float(np.median(rows[:, column]))
        low = rows[:, column] <= bound
        if low.all():
            bound = float(rows[rows[:, column] < bound][:, column].max())
            low = rows[:, column] <= bound
        at = len(nodes)
        nodes.append((column, bound, 0, 0))
        left, right = grow(rows[low], wanted // 2), grow(rows[~low], wanted - wanted // 2)
        nodes[at] = (column, bound, left, right)
        return at

    grow(sample, leaves)
    return nodes


def _leaf_of(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64) if nodes else np.full(len(x), -1, np.int64)
    table = np.array(nodes, dtype=float).reshape(-1, 4)
    while len(active := np.flatnonzero(at >= 0)):
        node = table[at[active]]
        left = x[active, node[:, 0].astype(int)] <= node[:, 1]
        at[active] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
    return -1 - at


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _near(known: np.ndarray, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the rows of ``known`` that may be among its ``k`` + 1 nearest: inner products tell distances but for
    their rounding, and what lies beyond that of the last one is left out. What is not a number stays in."""
    own, all_ = (queries**2).sum(axis=1), (known**2).sum(axis=1)
    about = own[:, None] + all_ - 2 * (queries @ known.T)
    if about.shape[1] <= k + 1:
        yield from (np.arange(len(known)) for _ in queries)
        return
    last = np.partition(about, k, axis=1)[:, k]
    apart = 1e-12 * known.shape[1] * (own + all_.max()) + 4 * 10.0**-PLACES
    for row, most in zip(about, last + apart, strict=True):
        yield np.flatnonzero(~(row > most))


def _nearest(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, asked = batch.column("items")[i].values, batch.column("asked")[i].values
                ids, labels = items.field("id").to_numpy(), items.field("label").to_numpy()
                known, queries = _matrix(items.field("v"), len(ids)), _matrix(asked.field("v"), len(asked))
                found = []
                for query, q, rows_ in zip(asked.field("id").to_numpy(), queries, _near(known, queries, k), strict=True):
                    far = np.round(((known[rows_] - q) ** 2).sum(axis=1), PLACES)
                    far[ids[rows_] == query] = np.inf
                    near = np.lexsort((ids[rows_], far))[:k]
                    near = near[np.isfinite(far[near])]
                    found.append((np.full(len(near), query), ids[rows_[near]], labels[rows_[near]], far[near]))
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "label", "d"])

    return rows


def _visits(low: np.ndarray, high: np.ndarray, leaf: np.ndarray):
    """The leaves (by row of ``leaf``) that a query must look into besides its own: those with a box nearer than its bound.

    They are given out VISITS at a time or so: they are as many as queries times leaves.
    """

    def pairs(ids: list[np.ndarray], leaves: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (ids, leaves)], names=["id", "leaf"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, bound = _matrix(batch.column("v"), batch.num_rows), batch.column("leaf").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False)
            ids, leaves, held = [], [], 0
            for query, q, mine, most in zip(batch.column("id").to_numpy(), x, own, bound, strict=True):
                apart = np.maximum(np.maximum(low - q, q - high), 0.0)
                # a box at the very bound may hold a row of a smaller id
                near = leaf[((apart**2).sum(axis=1) <= most * (1 + 1e-12) + 10.0**-PLACES) & (leaf != mine)]
                ids.append(np.full(len(near), query))
                leaves.append(near)
                held += len(near)
                if held >= VISITS:
                    yield pairs(ids, leaves)
                    ids, leaves, held = [], [], 0
            if ids:
                yield pairs(ids, leaves)

    return rows


def _met(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each leaf for the queries ``asked`` (id, v, leaf) that look into it."""
    sizes = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("long").alias("parts"))
    dealt = asked.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # a row a leaf
    grouped = dealt.groupBy("leaf", "part").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    return grouped.join(blocks, "leaf").select("items", "asked").mapInArrow(_nearest(k), FOUND)


def nearest_rows(scaled: DataFrame, queries: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest other rows of each row of ``scaled`` (id, v, label) where ``queries`` holds: query_id, id, label, d, r.

    ``v`` is standardised and whole; d is the squared distance, rounded to PLACES; ties go to the smaller id, r counts from 1. The second table is one row:
    opened (pairs that were compared) and pairs (all there are).
    """
    spark = scaled.sparkSession
    bounded_batches(spark)
    n = scaled.count()
    sample = scaled.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    nodes = _splits(np.array([np.array(v) for v in sample]), max(1, min(LEAVES, n // LEAF)))

    @F.arrow_udf("long")
    def leaf_of(v: pa.Array) -> pa.Array:
        return pa.array(_leaf_of(nodes, _matrix(v, len(v))), pa.int64())

    placed = written(scaled.withColumn("leaf", leaf_of("v")))
    width = len(sample.iloc[0])
    ends = [f(F.element_at("v", i + 1)).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect()  # a row a leaf, LEAVES at most
    low, high = (np.array([[r[f"{name}{i}"] for i in range(width)] for r in boxes]) for name in ("low", "high"))
    leaf = np.array([r["leaf"] for r in boxes])
    parts = spark.createDataFrame([(int(r["leaf"]), int(r["n"]), -(-r["n"] // BLOCK)) for r in boxes], "leaf long, members long, parts long")
    dealt = placed.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = written(dealt.groupBy("leaf", "part").agg(F.collect_list(F.struct("id", "v", "label")).alias("items")).select("leaf", "items"))

    asked = written(placed.where(queries).select("id", "v", "leaf"))
    ranked = Window.partitionBy("query_id").orderBy("d", "id")
    first = written(_met(asked, blocks, k).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).drop("r"))
    bounds = first.groupBy("query_id").agg(F.max("d").alias("bound"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= k)
    bounded = asked.join(bounds, asked["id"] == bounds["query_id"], "left").select("id", "v", "leaf", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more = written(bounded.mapInArrow(_visits(low, high, leaf), "id long, leaf long"))
    second = _met(more.join(asked.select("id", "v"), "id"), blocks, k)
    best = first.union(second).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k)
    looked = asked.select("leaf").union(more.select("leaf")).join(F.broadcast(parts), "leaf").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("opened"))
    return best, looked.withColumn("pairs", F.lit(n * asked.count()).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, label) put together in blocks (ROWS) of BLOCK rows at least, but for the last one of a task."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels, v = (pa.concat_arrays([b.column(c) for b in held]) for c in ("id", "label", "v"))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels, v.flatten())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield block(held)
            held, rows = [], 0
    if rows:
        yield block(held)


class _Best:
    """The ``k`` nearest rows so far of each query of a block, by distance and id; what is missing is infinitely far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.own = (v**2).sum(axis=1)
        self.d, self.near, self.labels = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, known: np.ndarray) -> None:
        """Takes in a block of rows, ASKED queries at a time."""
        all_ = (known**2).sum(axis=1)
        for at in range(0, len(self.ids), ASKED):
            part = slice(at, at + ASKED)
            row, col = self._candidates(part, ids, known, all_)
            far = self._distances(self.v[part], known, row, col)
            kept = np.isfinite(far) & (ids[col] != self.ids[part][row])
            if kept.any():
                self._put(part, row[kept], far[kept], ids[col[kept]], labels[col[kept]])

    def _candidates(self, part: slice, ids: np.ndarray, known: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the nearest: inner products tell distances but for their rounding. What is not a number stays in."""
        own, most = self.own[part], self.d[part, -1]
        about = own[:, None] + all_ - 2 * (self.v[part] @ known.T)
        if len(ids) > self.k and not np.isfinite(most).all():
            others = np.where(ids == self.ids[part][:, None], np.inf, about)
            most = np.fmin(most, np.partition(others, self.k - 1, axis=1)[:, self.k - 1])
        apart = 1e-12 * known.shape[1] * (own + all_.max()) + 4 * 10.0**-PLACES
        return np.nonzero(~(about > (most + apart)[:, None]))

    @staticmethod
    def _distances(queries: np.ndarray, known: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        step = max(1, PIECE // max(1, known.shape[1]))
        made = [((known[col[i : i + step]] - queries[row[i : i + step]]) ** 2).sum(axis=1) for i in range(0, len(row), step)]
        return np.round(np.concatenate(made), PLACES) if made else np.zeros(0)

    def _put(self, part: slice, row: np.ndarray, far: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        n = len(self.ids[part])
        rows = np.concatenate([np.repeat(np.arange(n), self.k), row])
        d, near, named = (np.concatenate([mine[part].ravel(), more]) for mine, more in ((self.d, far), (self.near, ids), (self.labels, labels)))
        order, counts = np.lexsort((near, d, rows)), np.bincount(rows, minlength=n)
        first = order[(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]  # a row has k entries at least
        self.d[part], self.near[part], self.labels[part] = d[first], near[first], named[first]

    def found(self) -> pa.RecordBatch:
        known = np.isfinite(self.d)
        columns = np.broadcast_to(self.ids[:, None], known.shape)[known], self.near[known], self.labels[known], self.d[known]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "label", "d"])


def _best_of_pairs(k: int):
    """The ``k`` best rows for each query over the pairs of blocks of a task, in which one block of queries comes many times in a row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, known_ids, labels, known = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("asked_ids", "asked_v", "ids", "labels", "v"))
                queries = v.reshape(len(ids), -1)
                if best is None or not (np.array_equal(best.ids, ids) and np.array_equal(best.v, queries)):
                    if best is not None:
                        yield best.found()
                    best = _Best(ids, queries, k)
                best.meet(known_ids, labels, known.reshape(len(known_ids), -1))
        if best is not None:
            yield best.found()

    return rows


def nearest_of_all(scaled: DataFrame, queries: Column, k: int) -> DataFrame:
    """What ``nearest_rows`` finds, by comparing every pair: query_id, id, label, d, r. Rows are told apart by id.

    The product of blocks is not shuffled: a task reads ASKED_BLOCKS blocks of queries and KNOWN_BYTES of rows, and gives
    out ``k`` rows a query at most.
    """
    bounded_batches(scaled.sparkSession)
    rows = scaled.select("id", "v", "label")
    known, asked = written(rows.mapInArrow(_blocks, ROWS)), written(rows.where(queries).mapInArrow(_blocks, ROWS))
    size = known.agg(F.sum(F.size("ids") * 16 + F.size("v") * 8)).first()[0] or 0
    dealt = asked.select(F.col("ids").alias("asked_ids"), F.col("v").alias("asked_v")).repartition(max(1, -(-asked.count() // ASKED_BLOCKS)))
    pairs = dealt.hint("shuffle_replicate_nl").crossJoin(known.coalesce(max(1, -(-size // KNOWN_BYTES))))
    ranked = Window.partitionBy("query_id").orderBy("d", "id")
    return pairs.mapInArrow(_best_of_pairs(k), FOUND).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k)
