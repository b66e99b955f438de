"""The segment-tree encoder against the tokenizers library."""

import random

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from nimbora.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello world, it's 2024! <|endoftext|>x<|startoftext|> <|END",
    "É é ÜBER straße ΣΑΣ İstanbul  thin　wide\u0085x",
    "日本語テキスト 😀👍🏽 ½ ⅷ ٣",
    "a" * 20000,
    "".join(random.Random(1).choice("abcdefghij") for _ in range(5000)),
    "they'll we've I'd 'S 'LL ''' --- ...",
    "the the " * 2000,
    "a\x1cb \x1d\x1f c\x85d\u2028e\xa0f\u200bg",
    "e\u0301 n\u0303o \u212b \u01c5 \u1e9e \ufb01n",
    ("word," * 40 + " ") * 3,
]


def test_matches_library(spark):
    lib = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "th", "er", "É", " ", "  ", "1", "!", "ß", "\n", "ÿ", "'s", "漢"]) for _ in range(200)) for _ in range(60)]
    rows = list(enumerate(TEXTS + made + TEXTS[3:5]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("other", F.lit(1))
    out = bpe.encode_documents(docs, PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False) and r["other"] == 1


def test_leftmost_lowest_rank_first():
    pairs = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}
    assert bpe.merge_word([1] * 5, pairs) == [2, 3]
    assert bpe.merge_word([1] * 4, pairs) == [4]
    assert bpe.merge_word([1], pairs) == [1]


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
