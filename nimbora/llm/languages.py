"""Language identification with bit-sliced Bloom filters of byte n-grams.

Training counts the n-grams (windows of four bytes of the lower-cased text) of each language over all training rows. A
language's filter takes the n-grams that are not rare in it and about as frequent there as anywhere. The filters share
their slots: slot s holds one bit for each language, so the AND of an n-gram's slots is the set of all languages that
may contain it. A text's n-grams are counted for each language by those bits, corrected for the filter's false
positives, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.common import bounded_batches, materialise

#: Bytes of an n-gram; one fits a 32-bit number exactly.
GRAM = 4

#: Bits of a slot's number, and slots of an n-gram.
SLOT_BITS, PROBES = 20, 3

#: A filter takes n-grams with at least this share of the language's n-grams (so at most 1 / SHARE of them) ...
SHARE = 2e-6

#: ... whose share is at least this part of the largest share in any language.
PART = 0.3

#: Of a language's training rows one in LOWEST may score lower than what certainty is measured by, and the part of that
#: which a certain text has to reach.
LOWEST, LEAST_PART = 100, 0.6

#: Bytes that are worked on at a time.
CHUNK = 2_000_000

LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def padded(text: str) -> bytes:
    """The bytes whose windows are a text's n-grams."""
    return b"  " + text.lower().encode() + b"  "


def grams(data: bytes) -> np.ndarray:
    """All windows of four bytes as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def slots(gram: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram, by double hashing."""
    h = gram * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    step = (gram * np.uint32(0xC2B2AE3D) >> np.uint32(7)) | np.uint32(1)
    return [(h + np.uint32(i) * step) & np.uint32((1 << SLOT_BITS) - 1) for i in range(PROBES)]


def bundles(texts: list[bytes]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """The padded texts joined to at most CHUNK bytes: numbers of the texts, the bytes, and where each text starts.

    A longer text comes by itself, in parts that overlap so that each of its windows lies in one of them.
    """
    numbers: list[int] = []
    room = 0
    for i, data in enumerate(texts):
        if len(data) > CHUNK:
            for k in range(0, len(data) - GRAM + 1, CHUNK):
                yield [i], data[k : k + CHUNK + GRAM - 1], np.zeros(1, np.int64)
            continue
        if numbers and room + len(data) > CHUNK:
            yield numbers, b"".join(texts[n] for n in numbers), np.cumsum([0, *(len(texts[n]) for n in numbers)])[:-1]
            numbers, room = [], 0
        numbers.append(i)
        room += len(data)
    if numbers:
        yield numbers, b"".join(texts[n] for n in numbers), np.cumsum([0, *(len(texts[n]) for n in numbers)])[:-1]


def across(starts: np.ndarray) -> np.ndarray:
    """The windows that lie over the border of two joined texts; they belong to none."""
    return (starts[1:, None] - np.arange(1, GRAM)).ravel()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            by_lang.setdefault(lang, []).append(padded(text.as_py()))
        for lang, texts in by_lang.items():
            for _, data, starts in bundles(texts):
                values, n = np.unique(np.delete(grams(data), across(starts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)


def _slot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("slot", pa.int64()), ("word", pa.int32()), ("bits", pa.int64())])
    for batch in batches:
        gram = batch.column("gram").to_numpy().astype(np.uint32)
        number = batch.column("number").to_numpy()
        bits = (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)
        for slot in slots(gram):
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array((number // 64).astype(np.int32)), pa.array(bits)], schema=schema)


@dataclass
class Model:
    """The languages in order, the slots' bits, each filter's false positive rate, and the language to fall back on."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    usual: int

    def counts(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Hits of each language, for the texts that start at ``starts`` in ``data``."""
        found = None
        for slot in slots(grams(data)):
            hit = self.table[slot]
            found = hit if found is None else found & hit
        found[across(starts)] = 0
        hits = np.empty((len(starts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits[:, k] = np.add.reduceat(bit, starts)
        return hits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        """Language and score of each text, the share of its n-grams known to that language, and the margin over the next."""
        hits, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        lettered = [i for i, text in enumerate(texts) if text is not None and LETTER.search(text)]
        data = [padded(texts[i]) for i in lettered]
        sizes[lettered] = [len(d) - GRAM + 1 for d in data]
        for numbers, joined, starts in bundles(data):
            hits[[lettered[n] for n in numbers]] += self.counts(joined, starts)
        real = np.maximum(0.0, (hits - sizes[:, None] * self.false_rate) / (1.0 - self.false_rate))
        best, total = real.argmax(axis=1), real.sum(axis=1)
        largest = real[np.arange(len(texts)), best]
        second = np.sort(real, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(texts))
        known = largest / np.maximum(sizes, 1)
        margin = (largest - second) / np.where(largest > 0, largest, 1)
        names, scores = [], []
        for i, k in enumerate(best):
            if not sizes[i]:
                names.append("und")
                scores.append(0.0)
            elif not total[i]:
                names.append(self.languages[self.usual])
                scores.append(0.0)
            else:
                names.append(self.languages[k])
                scores.append(float(real[i, k] / total[i]))
        return names, scores, known, margin


def fit_languages(docs: DataFrame) -> Model:
    """Learns the filters from text and lang of ``docs``; rows where either is null teach nothing.

    Counts cover all rows. To the driver come the languages and the filters' slots, whose number is fixed.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = materialise(known.mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    width = max(1, -(-len(languages) // 64))
    slot_table = np.zeros((1 << SLOT_BITS, width), np.uint64)
    if languages:
        names = docs.sparkSession.createDataFrame([(x, i, totals[x]) for i, x in enumerate(languages)], "lang string, number int, total long")
        shares = counts.join(F.broadcast(names), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= SHARE)
        best = F.max("share").over(Window.partitionBy("gram"))
        chosen = shares.withColumn("best", best).where(F.col("share") >= PART * F.col("best")).select("gram", "number")
        bits = chosen.mapInArrow(_slot_bits, "slot bigint, word int, bits bigint").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
        slot_table[bits.column("slot").to_numpy(), bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    filled = np.array([float(((slot_table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))])
    usual = max(range(len(languages)), key=lambda k: (totals[languages[k]], -k), default=0)
    return Model(languages, slot_table, filled**PROBES, usual)


def _judged(docs: DataFrame, model: Model, added: list[str]) -> DataFrame:
    """Adds those of lang_pred, score, known and margin that ``added`` names."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of slots and a bit for each language

    @F.arrow_udf("struct<lang_pred:string,score:double,known:double,margin:double>")
    def judge(texts: pa.Array) -> pa.Array:
        names, scores, known, margin = shared.value.predict(texts.to_pylist())
        columns = [pa.array(names, pa.string()), *[pa.array(x, pa.float64()) for x in (scores, known, margin)]]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "known", "margin"])

    clear = docs.drop(*added, "_judged")
    judged = clear.withColumn("_judged", judge("text"))
    return judged.select(*[F.col(f"`{c}`") for c in clear.columns], *[f"_judged.{c}" for c in added])


def identify_languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to each row of ``docs`` (text, ...), learnt from ``training`` (text, lang).

    ``score`` is the language's share of all corrected counts. Texts that are null, empty or without a letter are
    ``und`` with score 0, as is everything if nothing could be learnt. A text none of whose n-grams is known gets the
    language with most training n-grams and score 0. Ties go to the language first in order. A text's neighbours in a
    batch have no part in its counts, so repeated rows are judged alike. An empty table gives an empty result, and texts of any length are read whole. Columns that bear an added
    name are replaced, others stay.
    """
    return _judged(docs, fit_languages(training), ["lang_pred", "score"])


def certain_languages(docs: DataFrame, training: DataFrame, part: float = LEAST_PART) -> DataFrame:
    """The rows of ``docs`` (text, ...) whose language is certain, learnt from ``training`` (text, lang).

    Certain is what reaches, in the share of n-grams known to its language and in the margin over the next language
    (as a part of the largest count), ``part`` of what all but one in LOWEST of that language's own training rows reach.
    Both measures are near 0 by chance: false positives are taken off, and equal counts have no margin. All training
    rows are scored; to the driver come their counts by language and thousandth. Texts without a letter, and languages
    that no training row of theirs was given, are never certain.

    Null and empty texts have no letter. Repeated rows are judged alike, and each teaches. Without any training row, or any
    row of ``docs``, the result is empty. Texts are read whole; columns of ``docs`` are given back as they are.
    """
    model = fit_languages(training)
    own = _judged(training, model, ["lang_pred", "known", "margin"]).where("lang = lang_pred").select("lang_pred", F.posexplode(F.array("known", "margin")))
    counted: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in own.groupBy("lang_pred", "pos", F.floor(1000 * F.col("col")).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():
        counted.setdefault((r["lang_pred"], r["pos"]), []).append((r["at"], r["n"]))
    least = {}
    for key, rows in counted.items():
        below, room = 0, sum(n for _, n in rows) // LOWEST
        for at, n in sorted(rows):
            below += n
            if below > room:
                least[key] = part * at / 1000
                break
    limits = [(x, least[x, 0], least[x, 1]) for x in model.languages if (x, 0) in least]
    bounds = docs.sparkSession.createDataFrame(limits, "lang_pred string, _known double, _margin double")  # a row for each language
    judged = _judged(docs, model, ["lang_pred", "known", "margin"]).join(F.broadcast(bounds), "lang_pred")
    return judged.where("known > _known AND margin > _margin").drop("lang_pred", "known", "margin", "_known", "_margin")
