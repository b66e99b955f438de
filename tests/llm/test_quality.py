"""Quality rules against a plain Python version."""

import math
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from nimbora.llm import quality

M = 64


def word_hash(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def chain(hashes):
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed=seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def features(text):
    h = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [signed(x) % M for x in h] + [signed(chain(p)) % M for p in zip(h, h[1:])]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
TEXTS = [
    (0, None),
    (1, ""),
    (2, "one two three\none two three\n \n\t\none two three four"),
    (3, "a b c d e f g h i a b c d e f g h i j k l m n o p q r s t u"),
    (4, "x " * 30),
    (5, LONG),
    (6, "é ü 😀 ### $$ <b> | good words in a plain text of more than twenty words that goes on and on until it ends here"),
    (7, "é ü 😀 ### $$ <b> | good words in a plain text of more than twenty words that goes on and on until it ends here"),
    (None, "no id but a plain text of more than twenty words that goes on and on until it ends here at last my friend now"),
]
LABELS = [(6, 1), (6, 1), (5, 1), (4, 0), (3, 1), (3, 0), (2, None), (None, 1)]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("other", F.lit(1))
    out = quality.judge_quality(docs, spark.createDataFrame(LABELS, "doc_id long, quality int"), buckets=M).collect()
    assert len(out) == len(TEXTS)
    raw = Counter(b for _, t in TEXTS for b in features(t))
    target = Counter(b for i, t in TEXTS if i in (5, 6) for b in features(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = [math.log((target[b] + 1) / (n_target + M)) - math.log((raw[b] + 1) / (n_raw + M)) for b in range(M)]
    by_text = dict(TEXTS)
    for r in out:
        text = by_text[r["doc_id"]]
        want = counts(text)
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == want
        f = features(text)
        llr = sum(ratio[b] for b in f) / len(f) if f else 0.0
        assert abs(r["llr"] - llr) < 1e-9
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality.THRESHOLD)
        assert r["other"] == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge_quality(none, labels).count() == 0
    some = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    assert quality.judge_quality(some, labels).first()["llr"] == 0.0
