"""The registered corpus queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm import alignment, bpe, jaccard, languages, licenses, minhash, packing, quality, search, sharding, spelling, substrings, urls
from nimbora.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(labels) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    method = F.transform("detections", lambda d: d["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).cast("long").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, method)).alias("labels"),
        F.col("license_score").alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similar shingle sets."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the sentences that were said before."""
    cleaned = substrings.drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.col("removed").alias("removed_sentences"), "text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, under the law of equal bytes."""
    put = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 1024 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", languages.held_out(F.col("doc_id")))
    found = languages.identify_languages(docs.select("doc_id", "text", "held_out"), docs.where("NOT held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similar sets of four-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with the corpus-wide counts of its links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.count_alignments(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus and the form that it is a variant of."""
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    made = [op1_license_scan, op2_ngram_jaccard_join, op3_quality_rules, op4_exact_top_k, op5_substring_dedup, op6_url_filter, op7_bpe_round_trip]
    made += [op8_kd_sharding, op9_best_fit_packing, op10_language_id, op11_minhash_near_dedup, op12_tokenizer_alignment, op13_spelling_variants]
    return {query.__name__: query for query in made}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for the queries that SQL expresses."""
    return {"op4_exact_top_k": OP4_SQL}
