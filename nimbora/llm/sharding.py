"""Sharding by a k-d tree: nodes split at weighted medians of their widest dimension until they hold one shard's bytes.

The dimensions are metadata of a text (bytes, lines, bytes a character, each on a scale over the whole table), so equal
texts lie at one point; a text's hash follows the coordinate as a tie break, and equal texts stay together. A weighted
quantile is found without sorting: the bytes are summed by leading bits of the key, running sums over these digits find
the one that holds the quantile, and it is looked at in finer bits, one aggregation for all nodes of a level at a time.
To the driver comes one row a node.

Groups of equal texts too heavy for even splits are placed first, the heaviest where least lies, and the tree's splits
make up for them. Only a group larger than a shard is dealt out over several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.llm.common import materialise, numbered, whole_text, with_row_number

#: Shards of the registered query.
SHARDS = 8

#: Bits of a coordinate, bits of the tie break, and bits looked at in one pass.
COORDINATE, TIE, DIGIT = 20, 42, 11

DIMENSIONS = ["d_bytes", "d_lines", "d_width"]

#: A group of equal texts is placed by itself above this part of a shard, so there are at most shards / HEAVY of them.
HEAVY = 1 / 128


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes and 1), text_crc32, a hash and the raw dimensions of each row's text."""
    text = whole_text()
    lean = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.length(text).alias("chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"))
    return lean.select("doc_id", "size", "text_crc32", "hash", F.log2(F.col("size")).alias("d_bytes"), F.log2(F.col("lines") + 1).alias("d_lines"), (F.col("size") / (F.col("chars") + 1)).alias("d_width"))


def _scaled(points: DataFrame) -> DataFrame:
    """The dimensions on a whole-number scale from the table's least to its largest value."""
    ends = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)]).first()
    top = (1 << COORDINATE) - 1

    def scale(c: str) -> Column:
        low, high = ends[f"min_{c}"] or 0.0, ends[f"max_{c}"] or 0.0
        return F.lit(0).cast("long") if high <= low else F.floor((F.col(c) - low) / (high - low) * top).cast("long")

    return points.withColumns({c: scale(c) for c in DIMENSIONS})


def _case(column: Column, values: dict, otherwise) -> Column:
    made = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for k, v in values.items():
        made = F.when(column == k, v).otherwise(made)
    return made


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), TIE).bitwiseOR(F.col("tie"))


def split_shards(points: DataFrame, room: list[float]) -> DataFrame:
    """Adds ``shard`` to each row of ``points`` (DIMENSIONS, tie, size); ``room`` is each shard's share of the bytes."""
    node = F.lit(0)
    spans = {0: (0, len(room))}
    while any(b - a > 1 for a, b in spans.values()):
        open_nodes = {n: ab for n, ab in spans.items() if ab[1] - ab[0] > 1}
        here = points.withColumn("node", node).where(F.col("node").isin(list(open_nodes)))
        seen = here.groupBy("node").agg(F.sum("size").alias("size"), *[(F.max(c) - F.min(c)).alias(c) for c in DIMENSIONS]).collect()
        widest = {r["node"]: max(DIMENSIONS, key=lambda c: (r[c], -DIMENSIONS.index(c))) for r in seen}
        weight = {r["node"]: r["size"] for r in seen}
        middle = {n: (a + b) // 2 for n, (a, b) in open_nodes.items()}
        wanted = {n: weight.get(n, 0) * sum(room[a : middle[n]]) / max(sum(room[a:b]), 1e-9) for n, (a, b) in open_nodes.items()}
        at = {n: (0, 0.0) for n in open_nodes}  # leading bits of the cut, and the weight before them
        keyed = here.where(F.col("node").isin(list(widest))).select("node", "size", _case(F.col("node"), {n: _key(c) for n, c in widest.items()}, F.lit(0).cast("long")).alias("key"))
        live, shift = set(widest), COORDINATE + TIE
        while shift > 0 and live:
            step = min(DIGIT, shift)
            shift -= step
            lead = _case(F.col("node"), {n: F.lit(at[n][0]).cast("long") for n in live}, F.lit(-1).cast("long"))
            left = _case(F.col("node"), {n: F.lit(float(wanted[n] - at[n][1])) for n in live}, F.lit(0.0))
            sums = keyed.where(F.shiftright("key", shift + step) == lead).groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("size"))
            upto = F.sum("size").over(Window.partitionBy("node").orderBy("digit"))  # at most 2 ** DIGIT rows a node
            past = F.col("upto") > left
            # one row a node: the digit in which the wanted weight is passed, and the weight before it
            found = sums.withColumn("upto", upto).groupBy("node").agg(F.min(F.when(past, F.struct("digit", (F.col("upto") - F.col("size")).alias("before")))).alias("cut"), F.max("digit").alias("last"), F.max("upto").alias("all"))
            for r in found.collect():
                n, before = r["node"], at[r["node"]][1]
                if r["cut"] is None:
                    at[n] = ((r["last"] + 1) << shift, before + r["all"])
                    live.discard(n)
                else:
                    at[n] = (r["cut"]["digit"], before + r["cut"]["before"])
        cut = {n: at[n][0] for n in widest}
        after, later = {}, node
        for n, (a, b) in open_nodes.items():
            left, right = 2 * n + 1, 2 * n + 2
            after[left], after[right] = (a, middle[n]), (middle[n], b)
            goes_left = _key(widest[n]) < F.lit(cut[n]).cast("long") if n in widest else F.lit(True)
            later = F.when(node == n, F.when(goes_left, left).otherwise(right)).otherwise(later)
        spans = {n: ab for n, ab in spans.items() if n not in open_nodes} | after
        points, node = points.withColumn("node", later), F.col("node")
    shard = _case(node, {n: F.lit(a) for n, (a, _) in spans.items()}, F.lit(0)).cast("int")
    return points.withColumn("shard", shard)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Puts all rows of ``docs`` (doc_id, text) into shards of nearly equal bytes.

    Returns doc_id, size, text_crc32, shard and slot (0, 1, ... without gaps in each shard). Equal texts share a shard
    unless together they exceed one.

    Null texts have size 1 and the checksum of the empty text, whose group they join. Repeated rows are separate rows
    of one group; which of them takes which slot is left open. Ties between coordinates are broken by the text's hash.
    An empty table gives an empty result. Other columns of ``docs`` are not read; texts of any length are read whole.
    """
    points = materialise(describe(docs))
    total = points.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    weight = F.count(F.lit(1)) * F.col("size")
    heavy = points.groupBy("hash", "text_crc32", "size").agg(weight.alias("weight")).where(F.col("weight") > share * HEAVY).collect()
    placed, fixed, spread = [0.0] * shards, [], []
    for r in sorted(heavy, key=lambda r: (-r["weight"], r["hash"])):
        s = min(range(shards), key=lambda k: placed[k])
        if placed[s] + r["weight"] > 0.98 * share:
            spread.append((r["hash"], r["text_crc32"]))
        else:
            placed[s] += r["weight"]
            fixed.append((r["hash"], r["text_crc32"], s))
    spark = docs.sparkSession
    # at most shards / HEAVY rows
    known = spark.createDataFrame([(h, c, s) for h, c, s in fixed] + [(h, c, None) for h, c in spread], "hash long, text_crc32 long, own int").withColumn("is_heavy", F.lit(True))
    scaled = _scaled(points).join(F.broadcast(known), ["hash", "text_crc32"], "left")
    dealt_out = F.col("is_heavy") & F.col("own").isNull()
    bits = F.when(dealt_out, F.xxhash64("hash", F.monotonically_increasing_id())).otherwise(F.col("hash"))
    ready = with_row_number(scaled.withColumn("tie", bits.bitwiseAND((1 << TIE) - 1)).select("doc_id", "size", "text_crc32", "own", "tie", *DIMENSIONS))
    grown = split_shards(ready.where("own IS NULL"), [max(share - p, 0.0) for p in placed])
    put = grown.select("doc_id", "size", "text_crc32", "_row", "shard").unionByName(ready.where("own IS NOT NULL").select("doc_id", "size", "text_crc32", "_row", F.col("own").alias("shard")))
    sizes = {r["shard"]: r["n"] for r in put.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return numbered(put, "shard", sizes).withColumnRenamed("rank_in_key", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
