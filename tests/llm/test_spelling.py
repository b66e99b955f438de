"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nimbora.llm import spelling


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in alphabet:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def brute(rows):
    words = counted(rows)
    alphabet = set("".join(words))
    near = {w: edits(w, alphabet) & set(words) for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    out = spelling.group_variants(docs.repartition(3)).collect()
    assert len(out) == len({r["word"] for r in out})
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out}


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeéüz"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(25)]
    words = []
    for base in bases:
        n = rng.choice([30, 200, 900])
        words += [base] * n
        for v in rng.sample(sorted(edits(base, letters)), 6):
            words += [v] * rng.choice([4, 5, 6, 40])
            words += [rng.choice(sorted(edits(v, letters)))] * 5
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    return [(k, rng.choice([" ", "-", "1", "ł"]).join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]


@pytest.mark.parametrize("block", [64, 2])
def test_matches_brute_force(spark, monkeypatch, block):
    """With small blocks all are subdivided to the last code point."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = corpus(block) + [(None, "nothing nothing nothing"), (9000, None), (9001, ""), (9002, "!!! 123"), (0, "repeated " * 7), (0, "repeated " * 7)]
    assert run(spark, rows) == brute(rows)


def test_one_prefix_for_most_words(spark):
    """A dictionary in which all words share their first half, and another in which all share their last."""
    rng = random.Random(3)
    ends = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(700)]
    rows = [(k, f"underst{e} {e}ations ") for k, e in enumerate(ends)] * 6
    rows += [(9_000 + k, f"underst{ends[0]} " * 50) for k in range(3)]
    assert run(spark, rows) == brute(rows)


def test_chains_of_forms(spark):
    chain = [("abcdefghij", 3200), ("abcdefghi", 620), ("abcdefgh", 110), ("abcdefg", 20)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    out = {r["word"]: (r["form"], r["root"]) for r in spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert run(spark, rows) == brute(rows)
    assert out["abcdefg"] == ("abcdefgh", "abcdefghij")


def test_ties_go_to_the_first_in_order(spark):
    rows = [(1, "colours " * 5 + "colourés " * 30 + "coloures " * 30 + "colourz " * 30)]
    assert run(spark, rows) == brute(rows)


def test_long_words(spark):
    long = "ab" * 30_000
    rows = [(1, f"{long} " * 5), (2, f"{long}c " * 25), (3, ("x" * 20_000 + " ") * 5)]
    assert run(spark, rows) == {(long, long + "c", long + "c", 5, 1, 25), (long + "c", None, long + "c", 25, 1, None), ("x" * 20_000, None, "x" * 20_000, 5, 0, None)}


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in "xy")
        assert spelling.is_one_edit(a, b) == (b in edits(a, "ab"))


def test_an_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
