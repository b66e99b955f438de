"""Best-fit packing of token sequences, with the large items matched first.

Every document is encoded, closed with an end token and cut into pieces of at most the capacity (the first piece takes
what is left over). Only the number of pieces of each length decides the packing, so it is planned on that histogram
(at most as many rows as the capacity): pieces above a third of the capacity share a sequence with at most one other
such piece, the largest first with the largest that fits; smaller pieces, the largest first, go where they leave the
least room. The plan says how many sequences have each content. Pieces are numbered within their length, and a piece's
number leads to its sequence and place.
"""

from __future__ import annotations

import functools
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import bounded_batches, numbered, with_row_number

#: Tokens of a sequence.
CAPACITY = 1024

#: The id that closes each document.
END = 2


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by a rule: printable Latin-1 characters stand for
    themselves, the other bytes take the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space of so many characters is cut out before the pattern sees it, which would go back over it step by step.
LONG_SPACE = 1_000


class ByteLevelEncoder:
    """An encoder for a byte-level vocabulary file.

    The vocabulary's ids rise in the order of its merges, so the ids serve as merge ranks. ``token_bytes`` has the bytes
    of every id.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level vocabularies split texts
        self._words = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._whole = tiktoken.Encoding("one word", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._special = tuple(special)
        self._long_space = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)
        spelt = {i: token for token, i in ranks.items()} | {i: token.encode() for token, i in special.items()}
        self.token_bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]

    def encode(self, text: str, special: bool):
        """The ids of a text of any length as a numpy array; special tokens in it are found only if asked for."""
        import numpy as np

        known = {"allowed_special": "all"} if special else {"disallowed_special": ()}
        if len(text) < LONG_SPACE:
            return self._words.encode_to_numpy(text, **known)
        parts, at = [], 0
        for found in self._long_space.finditer(text):
            # the pattern makes one word of white space but its last character, which goes with what follows; before
            # the text's end or a special token, which stand alone, the word is all of it
            end = found.end() - 1
            if found.end() == len(text) or special and text.startswith(self._special, found.end()):
                end += 1
            parts += [self._words.encode_to_numpy(text[at : found.start()], **known), self._whole.encode_to_numpy(text[found.start() : end])]
            at = end
        return np.concatenate([*parts, self._words.encode_to_numpy(text[at:], **known)])


@functools.lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """The encoder of a vocabulary file, made once for each Python worker."""
    return ByteLevelEncoder(path)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: what is left over first, then full ones."""
    full = (n - 1) // capacity
    return [n - full * capacity, *[capacity] * full]


def _piece_udf(path: str, capacity: int, end: int, keep_ids: bool):
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int32()), pa.field("ids_crc32", pa.int64())]
    schema = "array<struct<piece:int,start:bigint,length:int,ids_crc32:bigint" + (",ids:array<int>" if keep_ids else "") + ">>"

    @F.arrow_udf(schema)
    def pieces(texts: pa.Array) -> pa.Array:
        import numpy as np

        encoder = byte_level_encoder(path)
        close = np.array([end], dtype="<u4")
        ends, piece, start, length, crc, kept = [0], [], [], [], [], []
        for text in texts:
            ids = np.concatenate([encoder.encode(text.as_py() or "", special=True), close]).astype("<u4")
            at = 0
            for k, n in enumerate(piece_lengths(len(ids), capacity)):
                part = ids[at : at + n]
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(part.tobytes()))
                if keep_ids:
                    kept.append(part.astype("int32"))
                at += n
            ends.append(len(piece))
        columns = [pa.array(c, f.type) for c, f in zip((piece, start, length, crc), fields, strict=True)]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept) if kept else [], pa.int32())))
        names = [f.name for f in fields] + ["ids"] * keep_ids
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return pieces


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    cut = _piece_udf(tokenizer, capacity, end, keep_ids)
    return docs.select("doc_id", F.explode(cut(F.coalesce("text", F.lit(""))))
        .alias("p")).select("doc_id", "p.*")


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The packing of ``histogram[length]`` pieces of each length.

    Returns rows (length, first, last, each, sequence, offset): pieces numbered first to last of that length go, ``each``
    to a sequence, to sequences from ``sequence`` on, the first of them at ``offset`` there. Their number does not grow
    with the pieces, only with the number of distinct lengths.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    bins: dict[tuple, int] = {}  # content as ((length, each), ...) -> number of sequences
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, a in enumerate(large):
        for b in large[i:]:
            if not left[a]:
                break
            if a + b > capacity or not left[b]:
                continue
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                bins[((a, 2),) if a == b else ((a, 1), (b, 1))] = pairs
                left[a] -= pairs
                left[b] -= pairs
        if left[a]:
            bins[((a, 1),)] = left[a]
            left[a] = 0
    gaps: dict[int, list[tuple]] = {}
    for content in bins:
        gaps.setdefault(capacity - sum(n * k for n, k in content), []).append(content)

    def put(content: tuple, number: int) -> None:
        if number:
            if content not in bins:
                gaps.setdefault(capacity - sum(n * k for n, k in content), []).append(content)
            bins[content] = bins.get(content, 0) + number

    for size in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[size]
        for gap in sorted(g for g in gaps if g >= size):
            if not count:
                break
            for content in list(gaps[gap]):
                number = bins[content]
                each = gap // size
                filled = min(number, count // each)
                some = count - filled * each if filled < number else 0
                touched = filled + bool(some)
                if not touched:
                    break
                if number == touched:
                    del bins[content]
                    gaps[gap].remove(content)
                else:
                    bins[content] = number - touched
                put((*content, (size, each)), filled)
                put((*content, (size, some)), int(bool(some)))
                count -= filled * each + some
                if not count:
                    break
        each = capacity // size
        put(((size, each),), count // each)
        if count % each:
            put(((size, count % each),), 1)
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for content, number in bins.items():
        offset = 0
        for length, each in content:
            rows.append((length, used[length], used[length] + number * each - 1, each, sequence, offset))
            used[length] += number * each
            offset += length * each
        sequence += number
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to each row of ``pieces`` (length, ...)."""
    spark = pieces.sparkSession
    numbers = with_row_number(pieces.withColumn("length", F.col("length").cast("int")))
    counts = {r["length"]: r["n"] for r in numbers.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan: dict[int, list[tuple]] = {}
    for length, *line in plan_sequences(counts, capacity):
        plan.setdefault(length, []).append(tuple(line))
    # a row for each length, with the few lines of its plan
    lines = spark.createDataFrame(list(plan.items()), "length int, _lines array<struct<first:long,last:long,each:long,sequence:long,offset:long>>")
    ranked = numbered(numbers, "length", counts).join(F.broadcast(lines), "length")
    rank = F.col("rank_in_key")
    placed = ranked.withColumn("_line", F.filter("_lines", lambda x: rank.between(x["first"], x["last"]))[0])
    local = rank - F.col("_line.first")
    return (
        placed.withColumn("sequence_id", F.col("_line.sequence") + F.floor(local / F.col("_line.each")).cast("long"))
        .withColumn("offset", F.col("_line.offset") + (local % F.col("_line.each")) * F.col("length"))
        .drop("_lines", "_line", "rank_in_key")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Packs all rows of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``keep_ids``,
    the token ids themselves. Within a sequence pieces lie one after another from offset 0.

    Null and empty texts are one piece holding the end token alone. Repeated rows each give their own pieces; which of
    two rows alike takes which place is left open. An empty table gives an empty result. Other columns of ``docs`` are
    not read. Texts of any length are encoded whole.
    """
    bounded_batches(docs.sparkSession)
    packed = pack_pieces(cut_pieces(docs.select("doc_id", "text"), tokenizer, capacity, end, keep_ids), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
