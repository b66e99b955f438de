"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct runs of five words. Its parity sketch deals the set into parts by
hash and keeps the XOR of each part: documents whose sets differ in D elements differ in at most D parts. Sets with a
similarity of 0.8 or more differ in at most a ninth of their summed sizes, so by the pigeonhole principle they share
parts as soon as there are more filled parts than that. Sketches are compared within size bands, each twice as wide as
the one before; a set near the upper end of its band is sketched for the next band too.

Joining all documents that share a part would make pairs of everything that quotes the same passage. Parts are ordered
by how many documents have them, and each document leaves out its most frequent ones, as many as the pigeonhole
principle leaves to spare: the first part in that order that two similar documents share is always among those kept. A document leaves
a part, too, if no document of that part is near enough in this order (a position filter), so texts that share a
template but have more words of their own than similar texts may have are not compared at all.

Documents of a part are compared with the part's first and last one; what links is contracted to components, and only
documents of different components that share a part are compared with each other. So copies make links in proportion
to their number. A candidate pair must pass a bound by its bit sketches (their Hamming distance is at most the
symmetric difference) before the sets themselves decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from nimbora.llm.common import bounded_batches, joined_with_hot, materialise
from nimbora.llm.graphs import components

#: Words of a shingle.
SHINGLE = 5

#: Two documents link when PERCENT of the union is shared.
PERCENT = 80

#: Largest set of the first band, whose parts are the single elements.
FIRST = 64

#: Parts of a band's sketch for each element of its largest set. A caller may bound the parts that are kept, as by PARTS: bands
#: up to sets of 512 elements then still keep all, and the pigeonhole principle holds for them; wider ones keep a sample by
#: hash: similar sets are expected to share 100 or more of them, and sharing fewer than SURE has a chance of about one
#: in 10**12 for a pair at the very threshold, of the order of the hashes' own collisions.
PER_ELEMENT, PARTS, SURE = 0.3, 256, 45

#: Bits of the bit sketch, in words of 64.
WORDS = 8

#: Documents of a block that is compared with another.
BLOCK = 512

#: Digests that a sketching task remembers, to sketch copies once.
REMEMBERED = 100_000

#: Ids are sent to all executors up to this number, else joined by a shuffle.
BROADCAST_IDS = 500_000

MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles: runs of ``shingle`` words, or all words if they are fewer."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    width = min(n, shingle)
    run = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    return np.unique(_mixed(run))


def largest_partner(n: int) -> int:
    """The largest set that a set of ``n`` elements can link with."""
    return 100 * n // PERCENT


def difference_bound(n: int, other: int) -> int:
    """The most elements in which linked sets of these sizes differ."""
    return (n + other) * (100 - PERCENT) // (100 + PERCENT)


def band_sketch(elements: np.ndarray, band: int, most_parts: int | None = PARTS) -> tuple[int, np.ndarray]:
    """How many of the most frequent parts may be left out, and the filled parts, as one number each.

    Without ``most_parts`` all parts are kept, and the pigeonhole principle holds for sets of every size.
    """
    n = len(elements)
    bound = difference_bound(n, largest_partner(n))
    tag = np.uint64((band + 1) * 0xA24BAED4963EE407 & MASK)
    if band == 0:
        return max(n - bound - 1, 0), _mixed(elements ^ tag)
    total = int(FIRST * 2**band * PER_ELEMENT)
    part = _mixed(elements + np.uint64(0x632BE59BD9B4E019)) % np.uint64(total)
    capped = most_parts is not None and total > most_parts
    if capped:
        inside = part < most_parts
        elements, part = elements[inside], part[inside]
    order = np.argsort(part, kind="stable")
    part, elements = part[order], elements[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    if not len(starts):
        return 0, np.empty(0, np.uint64)
    parity = np.bitwise_xor.reduceat(elements, starts)
    spare = SURE - 1 if capped else len(starts) - bound - 1
    return max(spare, 0), _mixed(_mixed(parity) + part[starts] * np.uint64(0xC2B2AE3D27D4EB4F) ^ tag)


def sketches(elements: np.ndarray, most_parts: int | None = PARTS) -> list[tuple[int, np.ndarray]]:
    """The sketches of a set in its own band and, where a partner may lie there, in the next."""
    n = len(elements)
    if not n:
        return []
    band = 0
    while n > FIRST * 2**band:
        band += 1
    bands = [band] + [band + 1] * (largest_partner(n) > FIRST * 2**band)
    return [band_sketch(elements, b, most_parts) for b in bands]


def bit_sketch(elements: np.ndarray) -> np.ndarray:
    """The parity of each of 64 * WORDS bits, to which the elements are dealt."""
    bits = np.bincount((elements >> np.uint64(20)) % np.uint64(64 * WORDS), minlength=64 * WORDS).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def copy_digest(elements: np.ndarray) -> tuple[bytes, int, int]:
    """A digest that tells sets apart, and its two halves as signed numbers."""
    digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sketch_rows(most_parts: int | None, shingle: int = SHINGLE):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # copies within a task are sketched once, as far as they are remembered
        for batch in batches:
            n, high, low, ends, spare, inner, parts = [], [], [], [0], [], [0], []
            for text in batch.column("text"):
                elements = shingle_set(text.as_py(), shingle)
                digest, upper, lower = copy_digest(elements)
                n.append(len(elements))
                high.append(upper)
                low.append(lower)
                if digest not in met:
                    if len(met) == REMEMBERED:
                        met.clear()
                    met.add(digest)
                    for s, p in sketches(elements, most_parts):
                        spare.append(s)
                        parts.append(p)
                        inner.append(inner[-1] + len(p))
                ends.append(len(spare))
            flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(flat))
            structs = pa.StructArray.from_arrays([pa.array(spare, pa.int32()), lists], ["spare", "parts"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)],
                names=["doc_id", "n_shingles", "high", "low", "bands"],
            )

    return rows


def _set_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            bits = np.concatenate([bit_sketch(s) for s in sets]) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WORDS, pa.int32()), pa.array(bits)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["id", "n", "bits", "elements"],
            )

    return rows


@F.arrow_udf(LongType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    counts = []
    for i in range(len(a)):
        x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
        at = np.searchsorted(y.view(np.uint64), x.view(np.uint64))
        at[at == len(y)] = 0
        counts.append(int(np.count_nonzero(y[at] == x)))
    return pa.array(counts, pa.int64())


def _hamming(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for k in range(WORDS):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches allow to link."""
    lean = sets.select("id", "n", "bits")
    left, right = (lean.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    met = pairs.join(left, "a").join(right, "b")
    sizes = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (_hamming(F.col("bits_a"), F.col("bits_b")) * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT))
    return met.where(sizes).select("a", "b")


def _linked(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left, right = (sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("elements").alias(f"set_{k}")) for k in "ab")
    counted = near.join(left, "a").join(right, "b").withColumn("shared", _shared("set_a", "set_b"))
    return counted.where(100 * F.col("shared") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b").distinct()


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a part's documents, the pairs of different components that sizes and bit sketches allow to link."""

    def fields(items: pa.StructArray) -> tuple[np.ndarray, ...]:
        bits = items.field("bits").flatten().to_numpy().view(np.uint64).reshape(len(items), WORDS)
        return (*(items.field(c).to_numpy() for c in ("rep", "component", "n")), bits)

    for batch in batches:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(batch.num_rows):
            rep, component, n, bits = fields(batch.column("left")[i].values)
            other, of_other, n_other, bits_other = fields(batch.column("right")[i].values)
            names, sizes = np.unique(np.concatenate([component, of_other]), return_counts=True)
            usual = names[sizes.argmax()]  # of two documents in different components one is outside the largest
            for k, ids, of, own, sketch, ids_2, of_2, own_2, sketch_2 in (
                *((k, rep, component, n, bits, other, of_other, n_other, bits_other) for k in np.flatnonzero(component != usual)),
                *((k, other, of_other, n_other, bits_other, rep, component, n, bits) for k in np.flatnonzero(of_other != usual)),
            ):
                size = own[k] + own_2
                fits = (of_2 != of[k]) & (100 * np.minimum(own[k], own_2) >= PERCENT * np.maximum(own[k], own_2))
                differ = np.bitwise_count(sketch_2 ^ sketch[k]).sum(axis=1, dtype=np.int64)
                fits &= differ * (100 + PERCENT) <= size * (100 - PERCENT)
                found = ids_2[fits]
                left.append(np.minimum(found, ids[k]))
                right.append(np.maximum(found, ids[k]))
        pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a part and may link.

    ``placed`` has part, rep and component. A part's documents are cut into blocks of bounded size, and the pairs of
    blocks are named before any block is joined to them, so that the pairs of one part go to many tasks. Only pairs that
    pass the bounds leave a task.
    """
    mixed = F.min("component") < F.max("component")
    blocks_of = placed.groupBy("part").agg(mixed.alias("mixed"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members")).where("mixed").drop("mixed")
    blocks_of = materialise(blocks_of)
    total = blocks_of.agg(F.sum("members")).first()[0] or 0
    lean = sets.select(F.col("id").alias("rep"), "n", "bits").dropDuplicates(["rep"])
    members = joined_with_hot(placed.select("part", "rep", "component"), blocks_of, "part", "members", total).drop("members").join(lean, "rep")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocks = materialise(dealt.groupBy("part", "block").agg(F.collect_list(F.struct("rep", "component", "n", "bits")).alias("items")))
    each = blocks_of.select("part", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = each.select("part", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    left = blocks.select("part", "block", F.col("items").alias("left"))
    right = blocks.select("part", F.col("block").alias("other"), F.col("items").alias("right"))
    met = pairs.join(left, ["part", "block"]).join(right, ["part", "other"]).select("left", "right")
    return met.mapInArrow(_block_pairs, "a long, b long").distinct()


def _restricted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids`` (id)."""
    named = ids.select(F.col("id").alias("doc_id"))
    small = named.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(named) if small else named, "doc_id", "left_semi")


def sets_of(texts: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The whole sets of the documents that ``ids`` (id) names, written: id, n, bits, elements."""
    return materialise(_restricted(texts, ids.distinct()).mapInArrow(_set_rows(shingle), "id long, n long, bits array<bigint>, elements array<bigint>"))


def star_pairs(shared: DataFrame) -> DataFrame:
    """Of each part, the pairs (a, b) of its documents with the first and with the last of them."""
    return shared.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(shared.select(F.col("rep").alias("a"), F.col("high").alias("b"))).where("a < b").distinct()


def star_links(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """The star pairs whose sets link, written."""
    return materialise(_linked(materialise(_near(materialise(star_pairs(shared)), sets)), sets))


def copies_classed(sketched: DataFrame) -> DataFrame:
    """Each row's class of equal sets, written: doc_id, n_shingles, rep (the class's smallest doc_id)."""
    lean = sketched.select("doc_id", "n_shingles", "high", "low")
    copies = materialise(lean.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    return materialise(lean.join(copies, ["high", "low"], "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("rep")))


def sketched_documents(texts: DataFrame, most_parts: int | None, shingle: int = SHINGLE) -> DataFrame:
    """Sizes, digests and parity sketches of ``texts`` (doc_id, text), written."""
    schema = "doc_id long, n_shingles long, high long, low long, bands array<struct<spare:int,parts:array<bigint>>>"
    return materialise(texts.mapInArrow(_sketch_rows(most_parts, shingle), schema))


def shared_parts(sketched: DataFrame, members: DataFrame) -> DataFrame:
    """The parts by which documents may link, written: part, rep, and the part's smallest and largest rep (low, high)."""
    banded = sketched.select("doc_id", F.posexplode("bands").alias("band", "sketch")).select("doc_id", "band", "sketch.spare", F.explode("sketch.parts").alias("part"))
    frequent = materialise(banded.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = frequent.agg(F.sum("n")).first()[0] or 0
    met = joined_with_hot(banded, frequent, "part", "n", total)
    own = met.join(members.distinct(), "doc_id").groupBy("rep", "band", "part").agg(F.max("n").alias("n"), F.min("spare").alias("spare"), F.max("n_shingles").alias("size"))
    by_frequency = Window.partitionBy("rep", "band").orderBy(F.desc("n"), F.desc("part"))
    # of two documents whose first shared part is this one, none has any of the other's rarer elements; in the first
    # band parts are elements, so the rarer ones of both count towards their difference
    before = F.when((F.col("band") == 0) & (F.col("size") <= FIRST), F.col("size") - F.col("place")).otherwise(0)
    room = F.floor((F.col("size") + F.floor(100 * F.col("size") / PERCENT)) * (100 - PERCENT) / (100 + PERCENT))
    kept = materialise(own.withColumn("place", F.row_number().over(by_frequency)).where("place > spare").select("rep", "part", before.alias("before"), room.alias("room")))
    ends = materialise(kept.groupBy("part").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("members"), F.min("before").alias("least")).where("low < high"))
    total = ends.agg(F.sum("members")).first()[0] or 0
    return materialise(joined_with_hot(kept, ends, "part", "members", total).where("before + least <= room").select("part", "rep", "low", "high"))


def confirmed(texts: DataFrame, members: DataFrame, shared: DataFrame, shingle: int = SHINGLE, known: DataFrame | None = None) -> DataFrame:
    """n_shingles and component_id of each row of ``members``, by links between documents of one part of ``shared``.

    Links (a, b) that are ``known`` already are taken as they are.
    """
    sets = sets_of(texts, shared.select(F.col("rep").alias("id")), shingle)
    stars = materialise(star_pairs(shared))
    links = materialise(_linked(materialise(_near(stars, sets)), sets))
    if known is not None:
        links = links.union(known)
    found = components(links)

    placed = materialise(shared.join(found, shared["rep"] == found["id"], "left").select("part", "rep", F.coalesce("component", "rep").alias("component")))
    across = materialise(_across(placed, sets).join(stars, ["a", "b"], "left_anti"))
    more = materialise(_linked(across, sets))
    if not more.isEmpty():
        found = components(links.union(more))
    result = members.join(found, members["rep"] == found["id"], "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, most_parts: int | None = PARTS) -> DataFrame:
    """n_shingles and component_id of each row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id.

    Two documents link when the Jaccard similarity of their shingle sets is 0.8 or more; component_id is the smallest
    doc_id that links reach. Sets are compared by 64-bit hashes of shingles. ``most_parts`` bounds the parts kept of a
    sketch (see PARTS); with None all are kept, and no pair of any size rests on chance but for hash collisions, at the
    cost of more than four times the input on disk.

    Null, empty and blank texts have no shingles and link with nothing, not even each other. Rows that repeat a doc_id
    count as linked with each other if they have words. A similarity of exactly 0.8 links. Rows with a null doc_id are
    left out. An empty table gives an empty result. Other columns are not read. Texts of any length are read whole.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = sketched_documents(texts, most_parts)
    members = copies_classed(sketched)
    return confirmed(texts, members, shared_parts(sketched, members))
