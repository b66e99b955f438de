"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is split at special tokens, normalised, and split into words as the vocabulary file says. A word's symbols stand
in a row; a segment tree over the ranks of neighbouring symbols holds at its root the leftmost pair of the lowest rank.
Merging it changes two neighbouring ranks and empties one place, each a walk from a leaf to the root, until no pair can
merge: a word of n symbols takes n log n steps. New words of a
batch are merged side by side, one tree to a row of an array; words met before are looked up.
"""

from __future__ import annotations

import functools
import json
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import bounded_batches
from nimbora.llm.packing import byte_alphabet

#: A worker remembers the ids of at most twice so many words, and none longer than this many characters.
REMEMBERED, LONGEST = 300_000, 64

#: Characters of text that are worked on at a time.
CHUNK = 2_000_000

NONE = 1 << 60


def merge_word(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges a word's symbol ids; ``pairs`` gives for two neighbouring ids the pair's rank and the merged id."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    # a node holds rank * span + place, so that the least value is the leftmost pair of the lowest rank
    span = 2 * size
    tree = [NONE] * span
    for i in range(n - 1):
        found = pairs.get((symbols[i], symbols[i + 1]))
        if found is not None:
            tree[size + i] = found[0] * span + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    while (root := tree[1]) < NONE:
        i = root % span
        j = after[i]
        k = after[i] = after[j]
        merged = symbols[i] = pairs[(symbols[i], symbols[j])][1]
        # the pair at i changes, the one at j goes, the one before i changes
        value = NONE
        if k < n:
            before[k] = i
            found = get((merged, symbols[k]))
            if found is not None:
                value = found[0] * span + i
        changes = [(size + i, value)]
        if j < n - 1:
            changes.append((size + j, NONE))
        h = before[i]
        if h >= 0:
            found = get((symbols[h], merged))
            changes.append((size + h, NONE if found is None else found[0] * span + h))
        for leaf, value in changes:
            if tree[leaf] == value:
                continue
            tree[leaf] = value
            while leaf > 1:
                other = tree[leaf ^ 1]
                if other < value:
                    value = other
                leaf >>= 1
                if tree[leaf] == value:
                    break
                tree[leaf] = value
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class PairTable:
    """Ranks and merged ids of pairs of symbol arrays, by binary search."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.array([r for r, _ in pairs.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(ranks[order], 0)
        self.merged = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        self.merged[ranks] = [m for _, m in pairs.values()]

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
        """What the segment tree holds for these pairs; a symbol of -1 pairs with nothing."""
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at] * span + place, NONE)


def merge_rows(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges many words at once, one to a row, filled up with -1 on the right; merged places become -1.

    Every row has its own segment tree; a step takes the root of each tree that still has a pair.
    """
    many, n = symbols.shape
    size = 1
    while size < n - 1:
        size *= 2
    span = 2 * size
    tree = np.full((many, span), NONE, np.int64)
    if n > 1:
        tree[:, size : size + n - 1] = table.leaves(symbols[:, :-1], symbols[:, 1:], np.arange(n - 1), span)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    # one column more on either side stands for no neighbour: its symbol is -1
    wide = np.full((many, n + 2), -1, np.int64)
    wide[:, 1:-1] = symbols
    after, before = np.tile(np.arange(1, n + 3), (many, 1)), np.tile(np.arange(-1, n + 1), (many, 1))
    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        rank, place = np.divmod(tree[row, 1], span)
        i = place + 1
        j = after[row, i]
        k = after[row, j]
        h = before[row, i]
        merged = table.merged[rank]
        wide[row, i], wide[row, j] = merged, -1
        after[row, i], before[row, k] = k, i
        leaves = [size + j - 1, size + place, size + h - 1]
        values = [NONE, table.leaves(merged, wide[row, k], place, span), table.leaves(wide[row, h], merged, h - 1, span)]
        for leaf, value in zip(leaves, values, strict=True):
            # a neighbour beyond the ends has no leaf; leaf 0 of the array is not part of the tree
            tree[row, np.where((leaf >= size) & (leaf < span), leaf, 0)] = value
        step = size
        while step > 1:
            step //= 2
            leaves = [np.maximum(leaf, 2) >> 1 for leaf in leaves]
            for leaf in leaves:
                leaf = np.minimum(leaf, span // 2 - 1)
                tree[row, leaf] = np.minimum(tree[row, 2 * leaf], tree[row, 2 * leaf + 1])
        row = row[tree[row, 1] < NONE]
    return wide[:, 1:-1]


class Tokenizer:
    """The parts of a vocabulary file: splitting, merging and joining texts."""

    def __init__(self, path: str) -> None:
        import tokenizers

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[(self.vocab[left], self.vocab[right])] = (rank, self.vocab[left + right])
        self.table = PairTable(self.pairs)
        shown = {b: c for c, b in byte_alphabet().items()}
        self.inner = [self.vocab[shown[b]] for b in range(256)]
        self.final = [self.vocab[shown[b] + self.suffix] for b in range(256)]
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        split = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.odd = regex.compile(r"[\x1c-\x1f]")  # what Python takes for white space but the vocabulary does not
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        shown_tokens = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]
        self.token_array = pa.array(shown_tokens, pa.string())
        # words met lately and before: when the first is full it becomes the second, so that common words stay
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's bytes."""
        raw = word.encode()
        made = [self.inner[b] for b in raw]
        made[-1] = self.final[raw[-1]]
        return made

    def learn(self, chunks: set[str]) -> list[str]:
        """Makes all chunks known: their words that are new are merged side by side, by their lengths.

        Returns the chunks that are too long to be remembered for other texts.
        """
        known, before = self.known, self.known_before
        long, compound, fresh = [], [], {}
        for chunk in chunks.difference(known):
            ids = before.get(chunk)
            if ids is not None:
                known[chunk] = ids
                continue
            words = self.words.findall(chunk)
            if len(chunk) > LONGEST:
                long.append(chunk)
            if words != [chunk]:
                compound.append((chunk, words))
            for word in words:
                if word in known or word in before:
                    continue
                if len(word) <= LONGEST:
                    fresh[word] = None
                else:
                    known[word] = array("i", merge_word(self.symbols(word), self.pairs)).tobytes()
                    long.append(word)
        groups: dict[int, list[str]] = {}
        for word in fresh:
            groups.setdefault((len(word.encode()) - 1).bit_length(), []).append(word)
        for group in groups.values():
            made = [self.symbols(word) for word in group]
            width = max(map(len, made))
            merged = merge_rows(np.array([m + [-1] * (width - len(m)) for m in made], np.int64), self.table)
            kept = merged >= 0
            flat, ends = merged[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            start = 0
            for word, end in zip(group, ends, strict=True):
                known[word] = flat[start:end]
                start = end
        for chunk, words in compound:
            known[chunk] = b"".join([known[w] if w in known else before[w] for w in words])
        return long

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers. No word crosses white space, so what stands between it is looked up."""
        split = []
        for text in texts:
            parts = self.at_special.split(text) if self.at_special else [text]
            for part in parts:
                if part in self.special:
                    split.append(part)
                    continue
                # characters are lower-cased one by one, but Python's lower() looks at what stands around a sigma
                plain = part.lower() if part.isascii() or ("\u03a3" not in part and is_normalized("NFC", part)) else self.normalizer.normalize_str(part)
                split.append(self.space.split(plain) if self.odd.search(plain) else plain.split())
            split.append(None)
        long = self.learn(set().union(*[part for part in split if isinstance(part, list)]))
        done, own = [], []
        for part in split:
            if part is None:
                done.append(b"".join(own))
                own = []
            elif isinstance(part, str):
                own.append(array("i", [self.special[part]]).tobytes())
            else:
                own.extend(map(self.known.__getitem__, part))
        for chunk in long:
            self.known.pop(chunk, None)
        if len(self.known) >= REMEMBERED:
            self.known, self.known_before = {}, self.known
        return done

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, worked on some texts at a time."""
        done, held, size = [], [], 0
        for text in texts:
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size >= CHUNK:
                done += self.encode_all(held)
                held, size = [], 0
        return done + self.encode_all(held)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The tokens of each list with spaces between them, as the library joins them where a file names no decoder."""
        ids = lists.flatten()
        offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
        fits = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(self.token_array)))
        tokens = self.token_array.take(pc.if_else(fits, ids, None))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file and worker."""
    return Tokenizer(path)


def encoded(text: Column, path: str) -> Column:
    """The ids of each text, as array<int>; null is read as empty."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = tokenizer(path)
        done = own.encode_batch(texts)
        ends = np.cumsum([0, *(len(d) // 4 for d in done)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(done), np.int32)))

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that each list of ids stands for; ids outside the vocabulary stand for nothing."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return tokenizer(path).decode(pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists)

    return decode(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` (the whole text's token ids) and ``decoded`` (the text they stand for) to each row of ``docs``.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike, an empty table
    gives an empty result, and a text of any length is encoded whole. Columns named ids or decoded are replaced, others
    stay.
    """
    bounded_batches(docs.sparkSession)
    with_ids = docs.drop("ids", "decoded").withColumn("ids", encoded(F.col("text"), path))
    return with_ids.withColumn("decoded", decoded(F.col("ids"), path))
