"""Alignment of two tokenizers' tokens over the same bytes, and how many documents hold each aligned pair.

Tokenizer A encodes a space and the text by a byte-level vocabulary, tokenizer B the text by a piece vocabulary that adds
the space itself. Where both spell the same bytes, their tokens are the two sides of a graph whose edges are the pairs
that overlap. A union-find over that graph yields its connected components: the smallest groups that both tokenizers
cut alike. The members of a component expand to the links, and the corpus counts each linked pair of ids by documents.

Documents are encoded in chunks (one Arrow batch or less). A chunk gives a row for each of its documents, and one for each
distinct pair with the number of its documents that hold it. So pairs are added up before they are shuffled, and the corpus-wide
counts come back once for each chunk rather than once for each document. No row holds a whole chunk: writers and readers of
Parquet, sorts and joins buffer rows by their number.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import bounded_batches, materialise
from nimbora.llm.packing import byte_level_encoder

#: Ids of A and of B stand in one number.
SHIFT = 32

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, ids_a array<int>, ids_b array<int>, groups_a array<int>, groups_b array<int>"


class SharedBytes:
    """Both tokenizers of one task, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = byte_level_encoder(path_a)
        self.bytes_a = self.a.token_bytes
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # an id in decimal with what follows it: another token of its side, the other side, another group
        self.spelt = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.span = len(self.spelt) // 3

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if there is no text or they do not spell the same bytes."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        whole = (" " + text).encode()
        a = self.a.encode(" " + text, special=False).astype(np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
            return none, none
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return none, none
        return a, np.array(b, np.int64)


@functools.lru_cache(maxsize=2)
def _shared_bytes(path_a: str, path_b: str) -> SharedBytes:
    return SharedBytes(path_a, path_b)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens overlap, given where the tokens of both sides end over the same bytes: places in A and in B, in order.

    Between two neighbouring ends lies one token of each side, and two tokens share such a stretch at most once.
    """
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 with edges a[i]-b[i]: for each node the smallest of its component.

    All edges are worked on at once: every root is hooked to the least root that it meets, then all paths are halved
    until each node points at its root.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            return parent
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _groups(n_a: int, n_b: int, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered from 0 in order, and the first token of A of each group."""
    root = united(n_a + n_b, at_a, at_b + n_a)
    firsts, number = np.unique(root, return_inverse=True)  # a component's least node is a token of A, and A comes first
    return number[:n_a], number[n_a:], firsts


def _spelt_groups(tables: SharedBytes, ids: np.ndarray, side: np.ndarray, group: np.ndarray) -> list[str]:
    """Each token with the mark that follows it; tokens stand by group, A before B."""
    last = np.ones(len(ids), bool)
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    mark = np.where(last, np.where(side == 0, 1, 2), 0)
    return list(map(tables.spelt.__getitem__, (mark * tables.span + ids).tolist()))


def _aligned(tables: SharedBytes, texts: list[str | None]) -> dict:
    """The alignment of a chunk's texts: arrays over texts, tokens and links."""
    both = [tables.encode(t) for t in texts]
    n_a, n_b = (np.array([len(p[k]) for p in both], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([p[k] for p in both]) if both else np.empty(0, np.int64) for k in (0, 1))
    # all texts lie one after another; each is spelt by both sides to its last byte, so no link crosses a border
    at_a, at_b = overlaps(np.cumsum(tables.length_a[ids_a]), np.cumsum(tables.length_b[ids_b]))
    group_a, group_b, firsts = _groups(len(ids_a), len(ids_b), at_a, at_b)
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    return {
        "n_a": n_a, "n_b": n_b, "ids_a": ids_a, "ids_b": ids_b, "group_a": group_a, "group_b": group_b,
        "n_groups": np.bincount(doc_a[firsts], minlength=len(texts)),
        "n_links": np.bincount(doc_a[at_a], minlength=len(texts)),
        "link_doc": doc_a[at_a], "pair": (ids_a[at_a] << SHIFT) | ids_b[at_b],
    }


def _spelt(tables: SharedBytes, made: dict) -> list[str]:
    """The groups of each text as ``a1,a2|b1;a3|b2``."""
    group = np.concatenate([made["group_a"], made["group_b"]])
    side = np.repeat([0, 1], [len(made["ids_a"]), len(made["ids_b"])])
    order = np.argsort(group * 2 + side, kind="stable")
    pieces = _spelt_groups(tables, np.concatenate([made["ids_a"], made["ids_b"]])[order], side[order], group[order])
    ends = np.cumsum(made["n_a"] + made["n_b"]).tolist()
    return ["".join(pieces[x:y])[:-1] for x, y in zip([0, *ends], ends)]


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _document_rows(path_a: str, path_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shared_bytes(path_a, path_b)
        for batch in batches:
            made = _aligned(tables, batch.column("text").to_pylist())
            n_a, n_b, doc = made["n_a"], made["n_b"], np.arange(batch.num_rows)
            base = np.concatenate([[0], np.cumsum(made["n_groups"])])[:-1]
            own_a, own_b = made["group_a"] - base[np.repeat(doc, n_a)], made["group_b"] - base[np.repeat(doc, n_b)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(made[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(_spelt(tables, made), pa.string()),
                    _lists(n_a, made["ids_a"], pa.int32()), _lists(n_b, made["ids_b"], pa.int32()), _lists(n_a, own_a, pa.int32()), _lists(n_b, own_b, pa.int32()),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "ids_a", "ids_b", "groups_a", "groups_b"],
            )

    return rows


#: A row is a document (with its distinct pairs, by their places among the chunk's, and how often each occurs) or a pair of
#: a chunk (with the number of its documents that hold it); the columns of the other kind are null.
CHUNK = "chunk long, doc struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>, places array<int>, times array<int>, place int, pair long, held int"

#: Bytes of text that are aligned at once (one text may be longer).
CHUNK_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _chunk_rows(path_a: str, path_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shared_bytes(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(part for whole in batches for part in _slices(whole)):
            made = _aligned(tables, batch.column("text").to_pylist())
            digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in _spelt(tables, made)]
            pairs, place = np.unique(made["pair"], return_inverse=True)
            # the distinct pairs of each document, by their places among the chunk's, and how often each occurs there
            held, times = np.unique(made["link_doc"] * max(len(pairs), 1) + place, return_counts=True)
            places = held % max(len(pairs), 1)
            n_pairs = np.bincount(held // max(len(pairs), 1), minlength=batch.num_rows)
            columns = [batch.column("doc_id"), *(pa.array(made[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digests, pa.string())]
            doc = pa.StructArray.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            found = [doc, _lists(n_pairs, places, pa.int32()), _lists(n_pairs, times, pa.int32())]
            of_pairs = [pa.array(np.arange(len(pairs)), pa.int32()), pa.array(pairs, pa.int64()), pa.array(np.bincount(places, minlength=len(pairs)), pa.int32())]
            names = ["chunk", "doc", "places", "times", "place", "pair", "held"]
            for n, own in ((len(doc), [*found, *(pa.nulls(len(doc), c.type) for c in of_pairs)]), (len(pairs), [*(pa.nulls(len(pairs), c.type) for c in found), *of_pairs])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, first + k), pa.int64()), *own], names=names)

    return rows


SUMMED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Puts the corpus-wide counts of a chunk's pairs (``known``) to the links of its documents (``docs``)."""
    places, times = (docs.column(c).combine_chunks() for c in ("places", "times"))
    ends = np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))
    places, times = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    at = known.column("place").to_numpy()
    fields = {c: pc.struct_field(docs.column("doc"), c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    for name, column in (("n_best", "best"), ("count_sum", "docs")):
        value = np.zeros(len(at), np.int64)
        value[at] = known.column(column).to_numpy()
        run = np.concatenate([[0], np.cumsum(times * value[places])])
        fields[name] = pa.array(run[ends] - run[np.concatenate([[0], ends])[:-1]], pa.int64())
    names = [c.split()[0] for c in SUMMED.split(", ")]
    return pa.table([fields[c] for c in names], names=names)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The tokens of both tokenizers for each row of ``docs`` (doc_id, text, ...), and the group of each.

    Returns doc_id, n_a, n_b, n_groups, n_links, groups (as ``a1,a2|b1;a3|b2,b3``: decimal ids, A before B), ids_a and
    ids_b (token ids), groups_a and groups_b (the group of each token, from 0 in order).

    Texts that are null or empty, or that the tokenizers do not spell alike byte by byte, have no tokens, groups or
    links. Rows with a null doc_id and repeated rows are aligned each by itself. An empty table gives an empty result.
    Other columns are not read. Texts of any length are encoded whole, special tokens in them as plain text.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_document_rows(path_a, path_b), DOCUMENT)


def _counted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair, held) added up: pair, docs (documents that hold it), best (no pair of its A id has more)."""
    counts = materialise(pairs.groupBy("pair").agg(F.sum("held").cast("long").alias("docs")).withColumn("a", F.shiftright("pair", SHIFT)))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # one row for each id of A at most
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _pair_rows(chunks: DataFrame) -> DataFrame:
    return chunks.where("pair IS NOT NULL").select("chunk", "place", "pair", "held")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of the chunks of ``aligned_chunks``: id_a, id_b, docs (documents that hold the pair linked), best."""
    return _counted(_pair_rows(aligned)).select(F.shiftright("pair", SHIFT).cast("int").alias("id_a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("id_b"), "docs", "best")


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of ``docs`` (doc_id, text, ...), written: a row for each document and for each pair of a chunk of them."""
    bounded_batches(docs.sparkSession)
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunk_rows(path_a, path_b), CHUNK))


def count_alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How well each row of ``docs`` (doc_id, text, ...) agrees with the corpus on which ids go together.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair of ids is held by as many documents as any pair
    of the same A id), count_sum (over the links, the documents that hold the pair) and groups_sha256 (lower-case hex of
    ``groups``; '' without tokens). A pair's count is the number of rows of ``docs`` that hold it linked.

    Null, empty and differently spelt texts have zeros; they, repeated rows, rows with a null doc_id, empty tables, other
    columns and long texts are treated as in ``align_documents``.
    """
    chunks = aligned_chunks(docs, path_a, path_b)
    rows = _pair_rows(chunks)
    known = rows.join(_counted(rows), "pair").select(F.col("chunk").alias("of_chunk"), "place", "docs", F.col("best").cast("long").alias("best"))
    own = chunks.where("doc IS NOT NULL").select("chunk", "doc", "places", "times")
    return own.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_summed, SUMMED)
