"""Language identification: held-out accuracy, filters against plain sets, and odd inputs."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from nimbora.llm import languages

PARTS = {"aa": ["the", "ing", "and", "er", "ion"], "bb": ["que", "ción", "ado", "los", "ñar"], "cc": ["sch", "ung", "ü", "der", "keit"]}


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        rows.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = made(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", languages.held_out(F.col("doc_id")))
    out = languages.identify_languages(docs, docs.where("not held_out")).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def windows(text):
    data = b"  " + text.lower().encode() + b"  "
    return [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3)]


def brute_model(rows):
    """Filters as one number of bits a slot, from plain counts."""
    counts = {}
    for _, text, lang in rows:
        for g in windows(text):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    totals = {x: sum(c.values()) for x, c in counts.items()}
    names, table = sorted(counts), {}
    for k, lang in enumerate(names):
        for g, n in counts[lang].items():
            share = n / totals[lang]
            shares = [c.get(g, 0) / totals[x] for x, c in counts.items()]
            if share >= languages.SHARE and share >= languages.PART * max(x for x in shares if x >= languages.SHARE):
                for s in languages.slots(np.array([g], np.uint32)):
                    table[int(s[0])] = table.get(int(s[0]), 0) | 1 << k
    return names, table


def brute_judgement(names, table, text):
    """The bits of each window's slots, their popcounts by language, less what the filters' false positives add."""
    filled = [sum(b >> k & 1 for b in table.values()) / 2**languages.SLOT_BITS for k in range(len(names))]
    found = windows(text)
    real = []
    for k, share in enumerate(filled):
        hits = 0
        for g in found:
            hits += all(table.get(int(s[0]), 0) >> k & 1 for s in languages.slots(np.array([g], np.uint32)))
        false = share**languages.PROBES
        real.append(max(0.0, (hits - len(found) * false) / (1 - false)))
    best = real.index(max(real))
    return (names[best], real[best] / sum(real)) if sum(real) else (None, 0.0)


def test_matches_brute_force_alone_shuffled_and_repartitioned(spark):
    """A text's score is that of plain counting, whatever lies beside it and however rows are dealt."""
    rows = made(90, 4)
    names, table = brute_model(rows)
    texts = [t for _, t, _ in made(25, 5)] + ["zz", "xq zq", "a", "the queschung", "schung " * 300]
    want = [brute_judgement(names, table, t) for t in texts]
    frames = []
    for parts in (1, 7):
        training = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts, "doc_id")
        numbered = list(enumerate(texts))
        random.Random(parts).shuffle(numbered)
        docs = spark.createDataFrame(numbered, "doc_id long, text string").repartition(parts)
        frames.append({r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.identify_languages(docs, training).collect()})
    assert frames[0] == frames[1]
    for i, (lang, score) in enumerate(want):
        assert frames[0][i][1] == score and (lang is None or frames[0][i][0] == lang), texts[i]
    model = languages.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for i, t in enumerate(texts):
        assert model.predict([t])[1][0] == frames[0][i][1]
    assert model.predict(["zz"])[1] == model.predict(["aa ing", "zz", "queción"])[1][1:2] == [0.0]


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(languages, "CHUNK", 64)
    rows = made(40, 6)
    names, table = brute_model(rows)
    model = languages.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1))
    got = model.predict([t for _, t, _ in rows])
    want = [brute_judgement(names, table, t) for _, t, _ in rows]
    assert [*zip(got[0], got[1], strict=True)] == want


def test_filters_hold_what_was_chosen(spark):
    rows = made(60, 2)
    model = languages.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    share = {}
    for lang in model.languages:
        # one run of all texts, as training sees them, up to the order
        own = np.concatenate([languages.grams(languages.padded(t)) for _, t, x in rows if x == lang])
        share[lang] = {g: c / len(own) for g, c in zip(*np.unique(own, return_counts=True), strict=True)}
    for k, lang in enumerate(model.languages):
        sure = [g for g, s in share[lang].items() if s >= 0.5 * max(share[x].get(g, 0) for x in share)]
        probe = np.array(sure, np.uint32)
        found = np.bitwise_and.reduce([model.table[s, 0] for s in languages.slots(probe)])
        assert ((found >> np.uint64(k)) & np.uint64(1)).all()


def test_odd_inputs(spark):
    training = spark.createDataFrame(made(60, 3) + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    texts = [None, "", "123 !!", "漢字", "a", "queción " * 400_000, "schung", "schung"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in languages.identify_languages(docs, training).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert out[3]["lang_pred"] in PARTS and out[4]["lang_pred"] in PARTS
    assert out[5]["lang_pred"] == "bb" and out[6]["lang_pred"] == "cc" == out[7]["lang_pred"]
    nothing = languages.identify_languages(docs, training.where("false")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert languages.identify_languages(docs.where("false"), training).count() == 0
