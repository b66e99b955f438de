"""Gibberish, foreign and mixed texts are of no certain language."""

import random
import zlib

import corpus_pipeline
from nimbora.llm import languages
from tests.llm.test_languages import PARTS


def text(rng, parts, n=60):
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_only_certain_texts_stay(spark):
    rng = random.Random(8)
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 3 == 1]
    taught = sorted(set(range(5000)) - set(held))
    clean = [(i, text(rng, PARTS[lang]), lang) for i, lang in zip(taught[:200] + held[:60], sorted(PARTS) * 100, strict=False)]
    gibberish = [(i, text(rng, "bcfjkmpqvwxyz", 90), "aa") for i in held[60:70]]
    foreign = [(i, text(rng, ["ska", "jag", "och", "ing", "inte"]), "bb") for i in held[70:80]]
    mixed = [(i, text(rng, PARTS["aa"], 30) + " " + text(rng, PARTS["cc"], 30), "cc") for i in held[80:90]]
    rows = clean + gibberish + foreign + mixed + [(held[90], None, "aa"), (held[91], "12 34", "aa")]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert not kept & {i for i, _, _ in gibberish + foreign + mixed}
    assert kept == {i for i, _, _ in clean}
    assert languages.certain_languages(docs, docs.where("false")).count() == 0
