"""K-d tree sharding: balance, whole groups, gapless slots, odd inputs."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nimbora.llm import sharding


def check(spark, rows, shards, slack):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    out = sharding.shard_documents(docs, shards).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    held, slots, groups, weight = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in out:
        assert 0 <= r["shard"] < shards
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[(r["text_crc32"], r["size"])].add(r["shard"])
        weight[(r["text_crc32"], r["size"])] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    share = sum(held.values()) / shards
    for g, s in groups.items():
        assert len(s) == 1 or weight[g] > 0.5 * share
    assert all(abs(held[s] - share) <= slack * share for s in range(shards)), held


def brute_split(points, room):
    """Shard of each point, by sorting: the first key past the wanted weight is the cut of the widest dimension."""
    out = {}

    def split(rows, a, b):
        if b - a == 1 or not rows:
            out.update({r["id"]: a for r in rows})
            return
        c = max(sharding.DIMENSIONS, key=lambda c: (max(r[c] for r in rows) - min(r[c] for r in rows), -sharding.DIMENSIONS.index(c)))
        middle = (a + b) // 2
        wanted = sum(r["size"] for r in rows) * sum(room[a:middle]) / max(sum(room[a:b]), 1e-9)
        weight, cut = 0, None
        for key in sorted({(r[c], r["tie"]) for r in rows}):
            weight += sum(r["size"] for r in rows if (r[c], r["tie"]) == key)
            if weight > wanted:
                cut = key
                break
        left = [r for r in rows if cut is None or (r[c], r["tie"]) < cut]
        split(left, a, middle)
        split([r for r in rows if r not in left], middle, b)

    split(points, 0, len(room))
    return out


@pytest.mark.parametrize("room", [[1.0] * 8, [0.2, 1.0, 0.0, 0.7, 1.0], [1.0, 1.0]])
def test_tree_matches_brute_force(spark, room):
    rng = random.Random(6)
    points = [{"id": i, "d_bytes": rng.choice([0, 5, rng.randint(0, 2**20 - 1)]), "d_lines": rng.randint(0, 900), "d_width": rng.choice([3, 2**19]), "tie": rng.randint(0, 2**42 - 1), "size": rng.randint(1, 500)} for i in range(250)]
    points += [dict(points[0], id=300 + i) for i in range(20)]
    rows = spark.createDataFrame([tuple(p.values()) for p in points], "id long, d_bytes long, d_lines long, d_width long, tie long, size long")
    assert {r["id"]: r["shard"] for r in sharding.split_shards(rows, room).collect()} == brute_split(points, room)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "b", "gämma\n", "dd"]) for _ in range(n))


@pytest.mark.parametrize("shards", [8, 5])
def test_balance_with_groups(spark, shards):
    rng = random.Random(1)
    copy, other = words(rng, 300), words(rng, 100)
    rows = [(i, words(rng, rng.randint(1, 300))) for i in range(1500)]
    rows += [(2000 + i, copy) for i in range(100)] + [(3000 + i, other) for i in range(30)] + [(7, None), (8, ""), (7, None)]
    check(spark, rows, shards, 0.05)


def test_group_larger_than_a_shard(spark):
    rng = random.Random(2)
    copy = words(rng, 100)
    rows = [(i, words(rng, rng.randint(1, 100))) for i in range(800)] + [(1000 + i, copy) for i in range(500)]
    check(spark, rows, 8, 0.05)


def test_rows_alike_in_everything(spark):
    check(spark, [(None, "one text")] * 300 + [(5, "one text")] * 300 + [(i, "x" * (i % 50)) for i in range(600)], 8, 0.05)


def test_few_and_no_rows(spark):
    check(spark, [(1, "a"), (1, "a"), (2, "x" * 50000)], 8, 10)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
