"""The pipeline's stages, each on its own input, against plain Python versions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nimbora.llm import quality, substrings
from tests.llm import test_jaccard, test_quality, test_substrings

WORDS = {"aa": ["the", "ing", "and", "er", "ion", "st"], "bb": ["que", "ción", "ado", "los", "ñar", "por"]}


def sentence(rng, lang):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 12))).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    passage = " ".join(sentence(rng, "aa") for _ in range(9))
    rows = []
    for i in range(80):
        lang = rng.choice(["aa", "aa", "bb"])
        parts = [sentence(rng, lang) for _ in range(rng.randint(6, 25))]
        if i % 9 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        rows.append((i, rng.choice([" ", "\n"]).join(parts), lang, "s0", 0))
    rows += [(100 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(6)]
    rows += [(120 + i, rows[i][1] + " Extra.", rows[i][2], "s1", 0) for i in range(20, 26)]
    rows += [(200, None, "aa", "s2", 0), (201, "", None, None, 0), (202, "short text", "aa", "s2", 0), (203, "1234 5678 " * 30, "aa", "s2", 0), (204, " ".join(f"{k}%" for k in range(40)), "bb", "s2", 0), (205, "WORD!! " * 60, "aa", "s2", 0)]
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 0) for i in [*range(80), *range(100, 150)]] + [(205, 0, 0), (20, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), labels


def collected(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect()) if "text" in df.columns else df.collect()


def test_stages(spark, folder, monkeypatch, tmp_path):
    base, labels = folder
    docs, inputs, outputs = spark.read.parquet(f"{base}/documents.parquet"), [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([(r["doc_id"], r["text"]) for r in docs.collect()])
        out = stage(spark, docs, base)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs.append(docs)

    # quality rules
    monkeypatch.setattr(test_quality, "M", quality.BUCKETS)
    features = {i: test_quality.features(t) for i, t in inputs[0]}
    bad = {i for i, q, _ in labels if q == 0}
    trusted = {i for i, q, _ in labels if q == 1} - bad
    raw, target = Counter(b for f in features.values() for b in f), Counter(b for i in trusted if i in features for b in features[i])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    kept = []
    for i, t in inputs[0]:
        n, _, _, _, repeated = test_quality.counts(t)
        f = features[i]
        llr = sum(np.log((target[b] + 1) / (n_target + quality.BUCKETS) / ((raw[b] + 1) / (n_raw + quality.BUCKETS))) for b in f) / max(len(f), 1)
        if n >= 20 and 100 * repeated <= 30 * n and llr >= quality.THRESHOLD:
            kept.append((i, t))
    assert collected(outputs[0]) == sorted(kept)
    assert not {200, 201, 202, 203, 205} & {i for i, _ in kept} and len(kept) >= 40

    # language ID: clean texts stay, texts without letters go
    assert set(collected(outputs[1])) == {(i, t) for i, t in inputs[1] if any(c.isalpha() for c in t)}

    # one of each group of near duplicates
    found = test_jaccard.brute(inputs[2])
    first = {i for i, _, c in found if i == c}
    assert collected(outputs[2]) == sorted((i, t) for i, t in inputs[2] if i in first)
    assert len(inputs[2]) - len(first) >= 5

    # repeated spans
    want = test_substrings.brute(inputs[3], substrings.WORDS)
    assert collected(outputs[3]) == sorted((i, t) for i, (gone, t) in want.items() if t or not gone)
    assert sum(bool(gone) for gone, _ in want.values()) >= 5

    # packing
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, t in inputs[4]:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = list(range(len(ids), 0, -1024))[::-1]
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            pieces[(i, k, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in outputs[4].collect()) == pieces


def test_odd_rows_pass_the_stages(spark, folder):
    """Null and repeated ids, a very long text and columns with clashing names, stage by stage."""
    base, _ = folder
    good = spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 40")
    rng = random.Random(12)
    pool = good.where("lang = 'aa'").first()["text"].split()
    long = " ".join(rng.choice(pool) + "." * (k % 9 == 8) for k in range(20_000))
    one = good.where("lang = 'aa'").first()
    extra = [(None, one["text"], "aa", None, None), (None, None, None, None, None), (one["doc_id"], one["text"], "aa", "s9", 5), (900, long, "aa", "s9", 7), (901, long, "aa", "s9", 7)]
    docs = good.unionByName(spark.createDataFrame(extra, good.schema))
    for k, clash in enumerate(["kept", "lang_pred", "component_id", "removed", "piece"]):
        out = corpus_pipeline.STAGES[k][1](spark, docs.withColumn(clash, F.lit("clash")), base)
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if k == 0:
            assert ids[one["doc_id"]] in (0, 2) and ids[900] == ids[901] and ids[None] <= 1
        elif k == 1:
            assert ids[one["doc_id"]] == 2 and ids[None] == 1 and ids[900] == ids[901] == 1
        elif k < 4:
            assert ids[one["doc_id"]] == 2 and ids[None] == 2 and ids[900] == 1 and ids[901] == 0
        else:
            assert ids[None] >= 2 and ids[900] == ids[901] > 10 and ids[one["doc_id"]] >= 2


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
