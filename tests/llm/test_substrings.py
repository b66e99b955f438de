"""Substring dedup against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from nimbora.llm import substrings


def cut(text):
    """Sentences with the white space after them: a new one starts after a line's end or closing punctuation and space."""
    sentences, start, closed = [], None, False
    for k, c in enumerate(text):
        if c.isspace():
            if start is not None and (c == "\n" or text[k - 1] in ".!?"):
                closed = True
        elif start is None or closed:
            if start is not None:
                sentences.append(text[start:k])
            start, closed = k, False
    return sentences + ([text[start:]] if start is not None else [])


def brute(rows, words):
    split = {}
    for i, t in rows:
        split[i] = cut(t or "")
    where = defaultdict(set)
    for i, sentences in split.items():
        plain = [tuple(s.lower().split()) for s in sentences]
        for a in range(len(plain)):
            for b in range(a, len(plain)):
                if b - a + 1 >= substrings.SENTENCES and sum(map(len, plain[a : b + 1])) >= words:
                    where[tuple(plain[a : b + 1])].add((i, a, b))  # every run, of any length
    gone = defaultdict(set)
    for places in where.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b + 1))
    out = {}
    for i, t in rows:
        kept = [s for k, s in enumerate(split[i]) if k not in gone[i]]
        head = (t or "")[: len(t or "") - len((t or "").lstrip())]
        out[i] = (sorted(gone[i]), (head + "".join(kept)).rstrip() if gone[i] else t)
    return out


def sentence(rng, n):
    return " ".join(f"W{rng.randint(0, 3000)}" for _ in range(n)) + rng.choice([".", "!", "?!", "."])


def test_matches_brute_force(spark):
    rng = random.Random(7)
    passages = [[sentence(rng, rng.randint(1, 14)) for _ in range(rng.randint(5, 9))] for _ in range(4)]
    rows = []
    for i in range(60):
        own = [sentence(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 12))]
        for p in passages:
            if rng.random() < 0.3:
                at = rng.randint(0, len(own))
                own = own[:at] + p + own[at:]
        rows.append((i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n", "  \n"]).join(own)))
    one = sentence(rng, 40)  # a sentence by itself is no run
    two = sentence(rng, 9) + " " + sentence(rng, 17)
    rows += [(70, None), (71, ""), (72, " \n "), (73, one), (74, "Short. " + one.upper()), (75, one + " " + one), (76, "no end " * 30), (77, two), (78, "Short. " + two.upper()), (79, two + "\n" + two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("removed", F.lit("clash"))
    out = substrings.drop_repeated_spans(docs).collect()
    assert len(out) == len(rows)
    want = brute(rows, substrings.WORDS)
    for r in out:
        assert (r["removed"], r["text"]) == want[r["doc_id"]], r["doc_id"]
        assert r["first"] == 1
    assert sum(bool(w[0]) for w in want.values()) > 10
    assert not want[74][0] and want[78][0] == [1, 2] and want[79][0] == [0, 1, 2, 3]


def test_hot_passage_and_repeated_rows(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 9) for _ in range(7))
    rows = [(i, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}") for i in range(400)]
    rows += [rows[0], (None, rows[1][1])]
    out = substrings.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out if passage in r["text"]) == [(False, 0), (False, 0), (True, None)]
    assert all(len(r["removed"]) in (0, 7) for r in out)


def test_empty_and_long(spark):
    assert substrings.drop_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(9)
    long = " ".join(sentence(rng, 6) for _ in range(4000))
    out = {r["doc_id"]: r for r in substrings.drop_repeated_spans(spark.createDataFrame([(1, long), (2, long), (3, "x" * 100_000)], "doc_id long, text string")).collect()}
    assert out[1]["text"] == long and out[2]["text"] == "" and len(out[2]["removed"]) == 4000 and out[3]["removed"] == []
