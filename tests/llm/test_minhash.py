"""MinHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm import test_jaccard as plain

from nimbora.llm import jaccard, minhash


def brute(rows):
    words = [(i, plain.words_of(t)) for i, t in rows]
    sets = [(i, plain.runs_of(w, 4)) for i, w in words]
    return {(i, n, c, i == c) for i, n, c in plain.linked(sets)}


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("part", F.lit(1))
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    return {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}


ODD = [(500001, None), (500002, ""), (500003, " \n\t "), (500004, "One TWO"), (500005, "one two"), (500006, "é É one"), (500006, "é É one"), (500007, "a b c d"), (500008, "A b c d e")]


def test_matches_brute_force(spark):
    rows = plain.corpus(1, [1, 2, 4, 5, 6, 8, 10, 14, 20, 30, 45, 60, 64, 70, 80, 110, 130, 160, 200, 260, 300, 400, 500, 520, 600, 900, 1100, 2500] * 3)
    assert run(spark, rows + ODD) == brute(rows + ODD)


def near_rows():
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    group = [(10_000 + i, " ".join(plain.edited(rng, base, 0.012))) for i in range(200)]
    words, chain = [f"c{k}" for k in range(100)], []
    for i in range(25):
        words = [*words[:-3], *(f"x{i}_{k}" for k in range(3))] if i % 2 else [*(f"y{i}_{k}" for k in range(3)), *words[3:]]
        words = words[5:] + words[:5]
        chain.append((20_000 + i, " ".join(words)))
    template = [f"t{k}" for k in range(60)]
    quoting = []
    for i in range(120):
        own = [f"own{i}_{k}" for k in range(30)]
        quoting += [(40_000 + 2 * i, " ".join(template + own)), (40_001 + 2 * i, " ".join(template + own[:-2]))]
    return group + chain + quoting + [(30_000 + i, "same text in every one of these rows") for i in range(300)]


def test_groups_chains_and_a_shared_template(spark):
    rows = near_rows()
    assert run(spark, rows) == brute(rows)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Buckets beyond the bound go through the parity-sketch join, with the same result."""
    monkeypatch.setattr(minhash, "CROWD", 20)
    met = []
    crowds = minhash._crowds
    monkeypatch.setattr(minhash, "_crowds", lambda *a: met.append(a[2].count()) or crowds(*a))
    rows = near_rows()
    assert run(spark, rows) == brute(rows)
    assert met and met[0] > 0


def test_pairs_at_the_threshold_share_buckets():
    """Sets of every size whose similarity is just enough agree on some of the 64 bands, most often on many."""
    rng = np.random.default_rng(2)
    least = []
    for n in (4, 8, 12, 40, 100, 250, 260, 600, 3000):
        for _ in range(60):
            shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
            one, other = (extra, extra[:0]) if rng.random() < 0.5 else (extra[: len(extra) // 2], extra[len(extra) // 2 :])
            a, b = np.unique(np.concatenate([shared, one])), np.unique(np.concatenate([shared, other]))
            least.append(int((minhash.band_keys(a) == minhash.band_keys(b)).sum()))
    assert min(least) >= 1 and np.mean(least) > 15


def test_bins_are_as_equal_as_sets_are_similar():
    """Densified bins, too, agree with a chance equal to the similarity."""
    rng = np.random.default_rng(3)
    for n in (5, 30, 200, 2000):
        agree = []
        for _ in range(150):
            shared, own = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(np.concatenate([shared, own[:n]])), np.unique(np.concatenate([shared, own[n:]]))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - 1 / 3) < 0.03


def test_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_are_left_out(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_duplicates(docs).collect()] == [(3, 2, 3, True)]
