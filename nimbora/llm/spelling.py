"""Spelling variants of words: words one edit apart, and the form that each is a variant of.

One inserted, deleted or replaced code point leaves a half of a word intact. Words are therefore sorted into blocks, as
in a dictionary and in one of reversed words: a block holds the words that share a first half (the edit lies behind it)
or a last half (the edit lies before it). A block with more than BLOCK words is subdivided in the same way: of what lies
between its shared head and tail, again one half is intact. So blocks shrink until they are small, or until a single
code point is left open, where an alphabet bounds them. Within a block, words are verified against each other.

A pair of words whose shorter one has m code points is looked for in frame m. Each word is in frame m of its own length and in
that of one less, as the longer one of a pair. A block is told by its frame, by how many code points of head and tail
are fixed, and by those; the first blocks are the two dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import LOWER, UPPER, bounded_batches, joined_with_hot, materialise, whole_text

#: What a word is made of.
RUN = r"[A-Za-zÀ-ÿ]+"

#: Least code points and least occurrences of a word, and how many times as frequent a form is.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5

#: One in so many occurrences loses a code point.
DAMAGED = 199

#: Words of a block that are verified against each other without subdividing it.
BLOCK = 64


def occurrences(docs: DataFrame) -> DataFrame:
    """Every run of letters of ``docs`` (doc_id, text), as it is counted: one column, word.

    Where DAMAGED divides the checksum of ``<doc_id>:<run>``, the run has lost one code point.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    sums = runs.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    return sums.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(docs: DataFrame) -> DataFrame:
    """The words of ``docs``: word, n (long)."""
    counted = occurrences(docs).where(F.length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def _placed(words: DataFrame, blocks: Column) -> DataFrame:
    """``words`` (word, n, ...) put into ``blocks``, an array of (m, head, tail)."""
    put = words.select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.m", "b.head", "b.tail")
    shared = F.substring("word", 1, F.col("head")), F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return put.withColumn("block", F.xxhash64("m", "head", "tail", *shared))


def _halved(m: Column, head: Column, tail: Column) -> list[Column]:
    """The two blocks of which one holds every pair of a block: the next half of its open middle is intact, or the rest."""
    half = F.floor((m - head - tail) / 2).cast("int")
    return [
        F.struct(m.alias("m"), (head + half).alias("head"), tail.alias("tail")),
        F.struct(m.alias("m"), head.alias("head"), (m - head - half).alias("tail")),
    ]


def is_one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes the one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


NEAR = "word string, n long, near string, near_n long"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's words, those that are one edit apart, in both directions.

    A pair belongs to the frame of its shorter word, so two words of more than the frame's length are not compared.
    """
    for batch in batches:
        found: list[tuple[str, int, str, int]] = []
        for m, items in zip(batch.column("m").to_pylist(), batch.column("items").to_pylist()):
            words = sorted(((w["word"], w["n"]) for w in items), key=lambda w: len(w[0]))
            for i, (a, n) in enumerate(words):
                if len(a) > m:
                    break
                for b, k in words[i + 1 :]:
                    if is_one_edit(a, b):
                        found += [(a, n, b, k), (b, k, a, n)]
        columns = list(zip(*found)) if found else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of ``words`` (word, n) that are one edit apart, each in both directions: word, n, near, near_n."""
    length = F.length("word")
    frames = F.array(length, length - 1)
    none = F.lit(0)
    first = F.flatten(F.transform(frames, lambda m: F.array(*_halved(m, none, none))))
    level = _placed(words, first)
    pairs = None
    while True:
        level = materialise(level)
        # a block without a word of the frame's own length has no pair of that frame
        own = F.max(F.length("word") == F.col("m"))
        sizes = level.groupBy("block").agg(F.count(F.lit(1)).alias("members"), own.alias("own")).where("members > 1 AND own").drop("own")
        sizes = materialise(sizes)
        total = sizes.agg(F.sum("members")).first()[0] or 0
        met = materialise(joined_with_hot(level, sizes, "block", "members", total))
        open_ = F.col("m") - F.col("head") - F.col("tail")
        small = (F.col("members") <= BLOCK) | (open_ < 2)
        blocks = met.where(small).groupBy("block", "m").agg(F.collect_list(F.struct("word", "n")).alias("items")).select("m", "items")
        found = blocks.mapInArrow(_verified, NEAR)
        pairs = found if pairs is None else pairs.union(found)
        skewed = met.where(~small)
        if skewed.isEmpty():
            return pairs.distinct()
        level = _placed(skewed, F.array(*_halved(F.col("m"), F.col("head"), F.col("tail"))))


def _roots(forms: DataFrame) -> DataFrame:
    """Follows ``forms`` (word, form) to the last: word, root. Steps double, and a chain is short, as each form is TIMES
    as frequent as its variant."""
    roots = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = met.select("word", "root")
        if met.where("moved").isEmpty():
            return roots


def group_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text, ...) and what each is a variant of: word, form, root, n, n_near, form_n.

    A word has LETTERS code points and OCCURRENCES occurrences or more; n counts them. n_near is how many words are one
    edit away. form is the one of these with the largest n (the first in code-point order on ties), if that n (form_n)
    is at least TIMES the word's own, else both are null. root is where following forms ends, the word itself without a
    form.

    Null and empty texts have no words. A null doc_id is read as ''. Repeated rows count once each. Ties between forms
    are decided as said. An empty table gives an empty result. Other columns are not read. Texts are read whole, and
    words of any length are compared.
    """
    bounded_batches(docs.sparkSession)
    words = materialise(count_words(docs.select("doc_id", "text")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = materialise(near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    judged = words.join(near, "word", "left")
    far = -F.col("best.less") >= TIMES * F.col("n")
    formed = materialise(judged.select("word", F.when(far, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, -F.col("best.less")).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
