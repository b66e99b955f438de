"""URL filters: ordered host and path rules, then gradient-boosted trees on lexical features.

URLs that a rule decides are the labelled ones: a bounded sample of them trains the trees, which then judge every URL
that no rule decides. Features are the lengths of the parts, depth, digit ratio, entropy of the characters, parameter
counts and statistics of the host's last label: its count over all pages, and its share of blocked URLs among labelled
ones. A training row's share leaves out the rows of its own fold of hosts, so the trees cannot read the row's own label
from it.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import LOWER, UPPER, joined_with_hot, materialise

#: Rules as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The trees learn from at most so many labelled URLs, those of the smallest hashes (a documented bound).
SAMPLE = 20_000

#: Folds of hosts, for shares that leave a row's own fold out.
FOLDS = 5

FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "digits", "digit_ratio", "hyphens", "labels", "parameters", "entropy", "path_entropy", "secure", "suffix_length", "suffix_blocked", "suffix_count"]


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` of ``url``; both are empty where it is null or has no ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def with_rule(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``_ruled`` (its verdict) of the longest rule that fits; both null where none does."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return parts.withColumns({"rule": rule, "_ruled": ruled})


def _entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of a string's characters."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / F.greatest(n, F.lit(1)))
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def with_features(parts: DataFrame) -> DataFrame:
    """Adds the lexical features that need no statistics, and ``_suffix``, the host's last label."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    plain = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "query_length": F.length(query),
        "depth": _count(F.col("path"), "/"),
        "digits": _count(url, "[0-9]"),
        "digit_ratio": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "hyphens": _count(F.col("host"), "-"),
        "labels": _count(F.col("host"), r"\."),
        "parameters": _count(query, "="),
        "entropy": _entropy(url),
        "path_entropy": _entropy(F.col("path")),
        "secure": url.startswith("https:").cast("int"),
        "_suffix": F.substring_index("host", ".", -1),
    }
    made = parts.withColumns(plain)
    return made.withColumn("suffix_length", F.length("_suffix"))


def _fold() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def _blocked() -> Column:
    return (F.col("_ruled") == "block").cast("int")


def _with_counts(featured: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds suffix_count. A common suffix has a large part of all pages: its rows are not shuffled."""
    total = counts.agg(F.sum("_count")).first()[0] or 0
    return joined_with_hot(featured, counts, "_suffix", "_count", total).withColumn("suffix_count", F.log1p("_count")).drop("_count")


def _as_doubles(featured: DataFrame) -> DataFrame:
    return featured.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def _shares(labelled: DataFrame) -> DataFrame:
    """_suffix and suffix_blocked, smoothed; at most a row for each labelled URL, so it may be broadcast."""
    return labelled.groupBy("_suffix").agg(((F.sum(_blocked()) + 0.5) / (F.count(F.lit(1)) + 1)).alias("suffix_blocked"))


def _fitted(labelled: DataFrame, trees: int, depth: int):
    """The trees, fitted on featured URLs with _ruled and suffix_count."""
    own = labelled.groupBy("_suffix", _fold().alias("_fold")).agg(F.sum(_blocked()).alias("_b"), F.count(F.lit(1)).alias("_n"))
    whole = own.groupBy("_suffix").agg(F.sum("_b").alias("_all_b"), F.sum("_n").alias("_all_n"))
    others = own.join(whole, "_suffix").select("_suffix", "_fold", ((F.col("_all_b") - F.col("_b") + 0.5) / (F.col("_all_n") - F.col("_n") + 1)).alias("suffix_blocked"))
    rows = _as_doubles(labelled.withColumn("_fold", _fold()).join(others, ["_suffix", "_fold"]))
    training = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", _blocked().alias("label"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7).fit(training)


def _scored(featured: DataFrame, labelled: DataFrame, model) -> DataFrame:
    """Adds probability (of not blocked, of blocked) to featured URLs with suffix_count."""
    known = featured.join(F.broadcast(_shares(labelled)), "_suffix", "left").withColumn("suffix_blocked", F.coalesce("suffix_blocked", F.lit(0.5)))
    return model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_as_doubles(known)))


def _labelled(pages: DataFrame, rules: list[tuple[str, str, str]], sample: int) -> tuple[DataFrame, DataFrame]:
    """Featured labelled URLs (a bounded sample), and the suffix counts of all pages."""
    ruled = with_rule(with_parts(pages), rules)
    counts = materialise(ruled.select(F.substring_index("host", ".", -1).alias("_suffix")).groupBy("_suffix").agg(F.count(F.lit(1)).alias("_count")))
    lines = ruled.where(F.col("_ruled").isNotNull()).select("url", "host", "path", "_ruled")
    picked = materialise(lines.orderBy(F.xxhash64("url"), "url").limit(sample))
    return materialise(_with_counts(with_features(picked), counts)), counts


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, trees: int = 20, depth: int = 4) -> DataFrame:
    """How well trees fitted on the labelled URLs of all but one fold of hosts judge those of that fold: verdict, n, share right.

    URLs that are null or have no host, and those that no rule decides, take no part. Repeated rows count once each. Only
    page_id and url are read. An empty fold gives no rows; where all labelled URLs are of that fold, nothing can be fitted.
    """
    featured, _ = _labelled(pages, rules, sample)
    seen, unseen = featured.where(_fold() != 0), featured.where(_fold() == 0)
    judged = _scored(unseen, seen, _fitted(seen, trees, depth))
    right = (vector_to_array("probability")[1] >= 0.5).cast("int") == _blocked()
    return judged.groupBy(F.col("_ruled").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("share"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, trees: int = 20, depth: int = 4) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``block_probability`` (null where a rule decides) and ``verdict`` to each row of ``pages``.

    The trees are fitted on at most ``sample`` URLs that a rule decides. With labelled URLs of one verdict alone, that
    verdict holds for the rest too; with none, the rest is allowed. Ties (probability 0.5) are blocked.

    Null URLs and those without ``://`` have empty host and path and are judged by their features like others;
    repeated rows get equal verdicts; an empty table gives an empty result. Columns that bear an added name are
    replaced, others stay. URLs of any length are read whole.
    """
    added = ["host", "path", "rule", "verdict", "block_probability", "_ruled", "_suffix", "_fold", "_count", "features", "rawPrediction", "probability", "prediction", *FEATURES]
    clear = pages.drop(*added)
    featured, counts = _labelled(clear, rules, sample)
    verdicts = sorted(r["_ruled"] for r in featured.select("_ruled").distinct().collect())
    ruled = with_rule(with_parts(clear), rules)
    names = [F.col(f"`{c}`") for c in clear.columns]
    if len(verdicts) < 2:
        rest = F.lit(verdicts[0] if verdicts else "allow")
        return ruled.select(*names, "host", "path", "rule", F.lit(None).cast("double").alias("block_probability"), F.coalesce("_ruled", rest).alias("verdict"))
    scored = _scored(_with_counts(with_features(ruled), counts), featured, _fitted(featured, trees, depth))
    p = F.when(F.col("_ruled").isNull(), vector_to_array("probability")[1])
    judged = F.coalesce("_ruled", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("block_probability", p).select(*names, "host", "path", "rule", "block_probability", judged.alias("verdict"))
