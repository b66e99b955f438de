"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from nimbora.llm import jaccard
from nimbora.llm.graphs import components


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(words, width):
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def linked(sets):
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {(i, len(s), root(i)) for i, s in sets}


def brute(rows):
    return linked([(i, runs_of(words_of(t), 5)) for i, t in rows])


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    out = jaccard.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out}


def edited(rng, words, rate):
    return [w if rng.random() > rate else f"e{rng.random():.6f}" for w in words]


def corpus(seed, sizes):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for size in sizes:
        base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
        for _ in range(rng.choice([1, 2, 4])):
            words = edited(rng, base, rng.choice([0, 0.004, 0.01, 0.02, 0.03, 0.05]))
            at = rng.randint(0, len(words))
            rows.append(words[:at] + passage * rng.choice([0, 0, 1]) + words[at:])
    rng.shuffle(rows)
    return [(i * 3 % 100003, " ".join(w)) for i, w in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = corpus(1, [1, 2, 4, 5, 6, 8, 10, 14, 20, 30, 45, 60, 64, 70, 80, 110, 130, 160, 200, 260, 300, 400, 500, 520, 600, 900, 1100, 2500] * 3)
    odd = [(500001, None), (500002, ""), (500003, " \n\t "), (500004, "One TWO"), (500005, "one two"), (500006, "é É one"), (500006, "é É one")]
    assert run(spark, rows + odd) == brute(rows + odd)


def test_large_group_and_chain(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    group = [(10_000 + i, " ".join(edited(rng, base, 0.01))) for i in range(250)]
    words, chain = [f"c{k}" for k in range(100)], []
    for i in range(25):
        words = [*words[:-3], *(f"x{i}_{k}" for k in range(3))] if i % 2 else [*(f"y{i}_{k}" for k in range(3)), *words[3:]]
        words = words[5:] + words[:5]
        chain.append((20_000 + i, " ".join(words)))
    copies = [(30_000 + i, "same text in every one of these rows") for i in range(300)]
    rows = group + chain + copies
    assert run(spark, rows) == brute(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 40, 64, 90, 130, 300, 500, 700, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            swap = (n + n) * 20 // 180 // 2
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]))
            differ = len(np.setxor1d(a, b))
            bits = np.unpackbits((jaccard.bit_sketch(a) ^ jaccard.bit_sketch(b)).view(np.uint8)).sum()
            assert bits <= differ
            for (spare, x), (_, y) in zip(jaccard.sketches(a), jaccard.sketches(b)):
                assert len(np.intersect1d(x, y)) > spare


def test_all_parts_when_asked_for():
    """Without a bound on parts, similar sets of any size share more parts than may be left out."""
    rng = np.random.default_rng(3)
    for n in (600, 1500, 6000):
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            swap = (n + n) * 20 // 180 // 2
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]))
            for (spare, x), (_, y) in zip(jaccard.sketches(a, None), jaccard.sketches(b, None)):
                assert len(x) > 100 and len(np.intersect1d(x, y)) > spare


def test_sampled_parts_have_a_wide_margin():
    """Pairs at the very threshold share far more of the sampled parts than may be left out."""
    rng = np.random.default_rng(4)
    margins = []
    for n in (520, 700, 1100, 2500, 9000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            swap = (n + n) * 20 // 180 // 2
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]))
            margins += [len(np.intersect1d(x, y)) - spare for (spare, x), (_, y) in zip(jaccard.sketches(a), jaccard.sketches(b))]
    assert len(margins) >= 200 and min(margins) >= 25


def test_a_shared_template_is_not_compared(spark, monkeypatch):
    """2,000 texts with 20 words in common and 5 of their own: none link, and none are compared with each other."""
    compared = []
    across, near = jaccard._across, jaccard._near
    monkeypatch.setattr(jaccard, "_across", lambda placed, sets: compared.append(placed.count()) or across(placed, sets))
    monkeypatch.setattr(jaccard, "_near", lambda pairs, sets: compared.append(pairs.count()) or near(pairs, sets))
    template = " ".join(f"t{k}" for k in range(20))
    rows = [(i, f"{template} " + " ".join(f"own{i}_{k}" for k in range(5))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == [(i, 21, i) for i in range(2000)]
    assert compared == [0, 0]


def test_a_hot_part_is_many_block_pairs(spark, monkeypatch):
    """One part's documents are cut into blocks whose pairs are rows of their own, and every link is found."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(300)]
    rows = [(i, " ".join(edited(rng, base, 0.045))) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    out = {r["id"]: r["component"] for r in components(edges).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}
