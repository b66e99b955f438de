"""Alignment of two tokenizers against a plain version with both libraries, group by group and pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nimbora.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in own):
        table[chr(256 + k)] = b
    return table


BYTE = byte_of()


def tokens(libraries, text):
    """Ids and bytes of both sides, or none."""
    a, b = libraries
    if not text:
        return [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    side_a = [(i, bytes(BYTE[c] for c in a.id_to_token(i))) for i in ids_a]
    side_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (side_a, side_b) if b"".join(t for _, t in side_a) == whole == b"".join(t for _, t in side_b) else ([], [])


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, rows):
    made, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(libraries, text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            groups.append(([i for i, x, y in a if start <= x and y <= cut], [i for i, x, y in b if start <= x and y <= cut]))
            start = cut
        links = [(i, j) for i, x, y in a for j, u, v in b if x < v and u < y]
        counts.update(set(links))
        made.append((doc_id, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = Counter()
    for doc_id, n_a, n_b, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[0]] for p in links)
        out[doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""] += 1
    return out, counts, most


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def sample():
    rng = random.Random(8)
    words = "the quick brown fox Überraschung señor naïve 12345 isn't co-operate <|endoftext|> <s> </s> 日本語 😀 ▁ x_y\tz \n\n  tokenizers internationalization".split(" ")
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "  two  spaces "), (104, "\n"), (105, "\x00\x01 zero"), (106, "▁"), (107, "é combining"), (108, "<|endoftext|>"), (None, "no id at all"), (1, "again"), (1, "again")]
    return rows + [(110 + k, rows[3][1]) for k in range(20)]


def test_matches_brute_force(spark, libraries):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("chunk", F.lit(1)).repartition(5)
    out = Counter(tuple(r[c] for c in NAMES) for r in alignment.count_alignments(docs, A, B).collect())
    assert out == brute(libraries, rows)[0]


def test_pair_counts(spark, libraries):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, counts, most = brute(libraries, rows)
    out = {(r["id_a"], r["id_b"]): (r["docs"], r["best"]) for r in alignment.pair_counts(alignment.aligned_chunks(docs, A, B)).collect()}
    assert out == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_tokens_and_their_groups(spark, libraries):
    rows = sample()
    for r in alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect():
        by_group = defaultdict(lambda: ([], []))
        for side, (ids, groups) in enumerate(((r["ids_a"], r["groups_a"]), (r["ids_b"], r["groups_b"]))):
            for i, g in zip(ids, groups):
                by_group[g][side].append(i)
        assert sorted(by_group) == list(range(r["n_groups"]))
        assert r["groups"] == ";".join(",".join(map(str, by_group[g][0])) + "|" + ",".join(map(str, by_group[g][1])) for g in range(r["n_groups"]))
        assert (r["n_a"], r["n_b"]) == (len(r["ids_a"]), len(r["ids_b"]))


def test_union_find_against_a_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 80))))
        near = defaultdict(set)
        for x, y in zip(a.tolist(), b.tolist()):
            near[x].add(y)
            near[y].add(x)
        want = [-1] * n
        for k in range(n):
            if want[k] < 0:
                todo = [k]
                while todo:
                    x = todo.pop()
                    if want[x] < 0:
                        want[x] = k
                        todo += near[x]
        assert alignment.united(n, a, b).tolist() == want


def test_long_texts_and_long_runs(spark, libraries):
    rows = [(1, "word and other words " * 20_000), (2, " " * 1_500_000), (3, "x" * 200_000), (4, "\n\t" * 600_000 + "end")]
    out = {r["doc_id"]: r for r in alignment.count_alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    for i, text in rows[:1] + rows[2:3]:
        a, b = tokens(libraries, text)
        assert (out[i]["n_a"], out[i]["n_b"]) == (len(a), len(b))
    assert out[2]["n_links"] > 0 and out[4]["n_links"] > 0


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.count_alignments(empty, A, B).collect() == []
    assert alignment.align_documents(empty, A, B).collect() == []


def test_no_row_holds_a_whole_chunk(spark):
    """Rows are buffered by their number, so what a row holds must not grow with the documents beside it."""
    docs = spark.createDataFrame([(k, f"word{k} number {k * k} of many {k % 7}") for k in range(900)], "doc_id long, text string").coalesce(1)
    alone = alignment.aligned_chunks(docs.where("doc_id < 30"), A, B)
    whole = alignment.aligned_chunks(docs, A, B)

    def largest(chunks):
        return chunks.select(F.max(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"]

    assert largest(whole) < 2 * largest(alone)


def test_slices_are_bounded_and_whole():
    texts = ["a" * 5, None, "b" * 9, "", "c" * 30, "d", "é" * 4, "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(alignment._slices(batch, 15))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(8))
    assert [p.num_rows for p in parts] == [4, 1, 2, 1]
    assert list(alignment._slices(batch.slice(0, 0), 15)) == []
