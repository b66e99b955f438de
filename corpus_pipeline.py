"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads back as the
next stage's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm import jaccard, languages, packing, quality, substrings
from nimbora.llm.common import materialise, table
from nimbora.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. Rows with a null doc_id are judged but never trusted; rows that repeat a
    doc_id are judged each by itself. Texts are read whole; columns beyond those of ``documents`` are not carried on.
    An empty table gives an empty one.
    """
    lean = docs.select(*COLUMNS)
    judged = quality.judge_quality(lean, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.where("kept").select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a certain language, learnt from those that are not held out.

    Null and empty texts and those without a letter go. Rows with a null lang teach nothing but are judged; a null
    doc_id is not held out. Repeated rows are judged alike, and each teaches. Texts are read whole; columns beyond those
    of ``documents`` are not carried on. An empty table, or one without any lang, gives an empty one.
    """
    lean = docs.select(*COLUMNS)
    training = lean.where(~languages.held_out(F.col("doc_id"))).select("text", "lang")
    return languages.certain_languages(lean, training).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates.

    Documents without words (null, empty, blank) are groups of their own. Rows with a null doc_id stay. Of rows that
    repeat the first doc_id of a group, all stay. Texts are read whole; columns beyond those of ``documents`` are not
    carried on. An empty table gives an empty one.
    """
    lean = docs.select(*COLUMNS)
    found = jaccard.near_duplicates(lean.select("doc_id", "text"))
    dropped = materialise(found.where("doc_id <> component_id").select("doc_id").distinct())
    named, nameless = lean.where("doc_id IS NOT NULL"), lean.where("doc_id IS NULL")
    return named.join(dropped, "doc_id", "left_anti").select(*COLUMNS).unionByName(nameless)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that others said first; those with nothing left go.

    ``n_chars`` is counted anew where sentences went. Null and empty texts and rows with a null doc_id stay as they are.
    Rows that repeat a doc_id and text are judged alike, as one occurrence. Texts are read whole; columns beyond those
    of ``documents`` are not carried on. An empty table gives an empty one.
    """
    cleaned = substrings.drop_repeated_spans(docs.select(*COLUMNS))
    left = cleaned.where((F.size("removed") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 1024 tokens.

    Null and empty texts are a piece of the end token alone; repeated rows and rows with a null doc_id each give their
    own pieces. Texts are encoded whole. An empty table gives an empty one.
    """
    return packing.pack_documents(docs.select(*COLUMNS), tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", drop_repeats),
    ("best-fit packing", pack),
]

#: SQL cannot express the tokenizer, the hashed multinomials or the filters; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
