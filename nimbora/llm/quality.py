"""Quality rules: plain counts of each text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets are
estimated, one from trusted documents and one from the whole raw corpus; a document's score is the sum of its features'
log ratios divided by their number. Every document whose score reaches a fixed threshold is kept: the decision depends
on the document and the two multinomials alone.

All steps are column expressions, one aggregation to a row per bucket, and no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import fenced, whole_text

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"

#: Characters that count as symbols.
SYMBOL = r"[#*$%&|<>]"

#: Words of a window that must not repeat.
WINDOW = 8

#: Buckets of the hashed n-grams; the ratios are one constant array of this length.
BUCKETS = 16_384

#: Documents of a lower mean log ratio are dropped. By rule: the middle of the interval on which the share of good
#: documents that are dropped and that of bad ones that are kept have the least sum, over the labelled documents of
#: sf0.1 that pass the base rule. It lies from -0.0562 to -0.0342.
THRESHOLD = -0.045


def _hashes() -> Column:
    """The words' hashes, in order."""
    return F.transform(F.array_remove(F.split(whole_text(), SPACE), ""), lambda w: F.xxhash64(w))


def _pair(h: Column, after: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(h, after), F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good throughout."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id")


def _counts(docs: DataFrame, buckets: int) -> dict[int, int]:
    """How often each bucket's features occur in the texts."""
    singles = F.transform("_h", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.transform(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0))), lambda h, i: _pair(h, F.get("_h", i + 1), buckets))
    features = docs.select(_hashes().alias("_h")).select(F.explode(F.concat(singles, pairs)).alias("bucket"))
    return {r["bucket"]: r["n"] for r in features.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of the trusted to the raw multinomial for each bucket, with one added to every count.

    The raw counts cover all rows of ``docs``; the trusted ones cover all rows whose doc_id is among ``trusted_ids``.
    Without any trusted row all ratios are 0. What comes to the driver is one row a bucket.
    """
    raw = _counts(docs, buckets)
    target = _counts(docs.join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi"), buckets)
    n_target, n_raw = sum(target.values()), sum(raw.values())
    if not n_target:
        return [0.0] * buckets
    import math

    base = math.log((n_raw + buckets) / (n_target + buckets))
    ratios = [base] * buckets
    for bucket, n in raw.items():
        ratios[bucket] = base + math.log((target.get(bucket, 0) + 1) / (n + 1))
    return ratios


def measure(docs: DataFrame) -> DataFrame:
    """Adds the plain counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the word hashes _h.

    ``n_repeat_words`` counts the words in windows of eight that occur twice or more in the text. Windows are told
    apart by 64-bit hashes. A window's copies are found by sorting (hash, position) within the row.
    """
    text = whole_text()
    words = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.withColumn("_lines", lines).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    starts = F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, WINDOW)]))
    hashed = counted.withColumn("_win", windows)
    keyed = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    sorted_rows = hashed.withColumn("_keyed", F.when(repeats, keyed)).drop("_win")
    same = F.filter("_keyed", lambda x, i: (x["h"] == F.get("_keyed", i - 1)["h"]) | (x["h"] == F.get("_keyed", i + 1)["h"]))
    at = sorted_rows.withColumn("_at", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("_keyed")
    cover = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return at.withColumn("n_repeat_words", n_repeat).drop("_at")


def judge_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds counts, ``base_failed``, ``llr`` and ``kept`` to each row of ``docs`` (doc_id, text, ...).

    ``labels`` (doc_id, quality) names trusted documents: quality 1 in all of an id's rows that are not null. ``llr`` is the mean log
    ratio of a text's features, 0 for a text without words. ``kept`` is false where base_failed, else llr >= threshold.

    Null and empty texts count as no words, so they fail the base rule. Repeated rows are judged alike, each by
    itself; rows with a null doc_id are judged but never trusted. An empty table gives an empty result, and without
    trusted rows the base rule alone decides. Columns of ``docs`` that bear an added name are replaced, others stay.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "_h", "_words", "_lines", "_win", "_keyed", "_at", "_good"]
    clear = docs.drop(*added)
    ratios = fit_ratios(clear.select("doc_id", "text"), labels, buckets)
    ratio = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    n_features = F.greatest(2 * F.size("_h") - 1, F.lit(1))
    gains = F.transform("_h", lambda h, i: F.get(ratio, F.pmod(h, F.lit(buckets)).cast("int")) + F.when(i + 1 < F.size("_h"), F.get(ratio, _pair(h, F.get("_h", i + 1), buckets))).otherwise(0.0))
    total = F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)
    scored = measure(clear).withColumn("llr", total / n_features).drop("_h")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    return fenced(judged, [F.col(f"`{c}`") for c in clear.columns], [F.col(c) for c in measured])
