"""Packing: round trip against the tokenizers library, gapless sequences, few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nimbora.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(histogram, capacity):
    rows = packing.plan_sequences(histogram, capacity)
    seqs = defaultdict(list)
    seen = defaultdict(set)
    for length, first, last, each, sequence, offset in rows:
        for r in range(first, last + 1):
            assert r not in seen[length]
            seen[length].add(r)
            seqs[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
    assert {n: len(s) for n, s in seen.items()} == {n: c for n, c in histogram.items() if c}
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    assert sorted(seqs) == list(range(len(seqs)))
    return len(seqs)


def test_plans():
    rng = random.Random(3)
    assert check_plan({}, 10) == 0
    assert check_plan({5: 4, 10: 1, 1: 7}, 10) == 4
    for _ in range(60):
        capacity = rng.choice([7, 16, 100, 1024])
        histogram = {rng.randint(1, capacity): rng.choice([1, 2, 3, 50, 400]) for _ in range(rng.randint(1, 60))}
        n = check_plan(histogram, capacity)
        volume = sum(k * c for k, c in histogram.items())
        large = sum(c for k, c in histogram.items() if 2 * k > capacity)
        assert n <= max(-(-volume // capacity), large) * 1.5 + 1


TEXTS = [None, "", "a", "Hello  world\n\n it's <|endoftext|> 123 ü日本 😀", "word " * 1023, "word " * 1022 + "x", "ünï cödé " * 3000, "x" * 30000, " \t \n" * 50, "Ⅷ½²  'll 're ' s"]


@pytest.mark.parametrize("keep_ids", [False, True])
def test_pieces_match_library(spark, keep_ids):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    out = packing.pack_documents(docs, PATH, keep_ids=keep_ids).collect()
    lib = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = list(range(len(ids), 0, -1024))[::-1]
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = defaultdict(int)
    for r in out:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        assert not keep_ids or zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    assert got == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


LONG = [
    " " * 2_000_000,
    "\t" * 2_000_000 + "end",
    "a" + "\n" * 2_000_000 + " b",
    "x" + " " * 1_200_000 + "<|endoftext|>" + " \n" * 700 + "'s",
    " " * 999 + "a" + " " * 1000 + "b" + " " * 1001 + "　" * 1500 + "\x1c" * 1200 + "c " + "\x85" * 3000,
    "<|endoftext|>" + " " * 1500 + "<|endof" + "\r\n" * 800 + "5" + " " * 1300,
]


@pytest.mark.parametrize("text", LONG)
@pytest.mark.parametrize("special", [False, True])
def test_long_white_space_matches_library(text, special):
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = not special
    want = lib.encode(text, add_special_tokens=False).ids
    assert packing.byte_level_encoder(PATH).encode(text, special).tolist() == want


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, LONG[0]), (2, LONG[1])], "doc_id long, text string")
    out = packing.pack_documents(docs, PATH).collect()
    assert sum(r["length"] for r in out) == sum(len(packing.byte_level_encoder(PATH).encode(t, True)) + 1 for t in LONG[:2])
