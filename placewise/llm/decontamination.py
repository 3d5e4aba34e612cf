"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, then exact weighted-shingle similarity.

Every document window of an item's size classes gets a 64-bit SimHash of its words. Windows start at every third word, and each item has
fingerprints at every offset, so an exact copy always has a window in step with it. Four blocks of 16 bits, each looked up with up to one
changed bit, find every item fingerprint within ``RADIUS`` bits. A candidate counts only if the item's own 5-word shingles, each weighted by the
length of its words, are found in the document around the window up to the wanted share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.rows import pieces
from placewise.llm.words import _WORD_FACTORS, byte_set, mix, runs

RADIUS = 7  # four blocks with one changed bit each, and three more bits
STEP = 3
_WIDEST = 40_000  # words of a window, so that bit counts fit in 16 bits
_SPAN = STEP << 15  # words whose windows are made at once, so that a very long text takes no more memory
_LETTERS = byte_set(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_FLIPS = np.array([0, *(1 << i for i in range(16))], np.uint16)


def _size_class(words: int) -> tuple[int, int]:
    """(window length, step) for an item: about a third apart, so that every item has a window in step with any copy."""
    if words < STEP + 2:
        return words, 1
    size = STEP
    while (wider := STEP * max(size // STEP + 1, round(size * 1.45 / STEP))) <= min(words - STEP + 1, _WIDEST):
        size = wider
    return size, STEP


def _size_classes(words: int) -> list[tuple[int, int]]:
    """The item's own class and smaller ones, so that a window lies clean beside edits: of half its length for one edit anywhere, of a quarter where
    more edits keep the share. What keeps a shingle keeps five words in a row, which hold a window of three in step."""
    parts = [words // 2 if words >= 16 else 8 if words >= 12 else 5] * (words > 5) + [words // 4] * (words >= 50)
    return list(dict.fromkeys([_size_class(words), *map(_size_class, parts)]))


def _bits(hashes: np.ndarray, step: int) -> np.ndarray:
    """Running counts of set bits, after every ``step`` words (a rest is left out)."""
    whole = len(hashes) // step * step
    ones = np.unpackbits(hashes[:whole].view(np.uint8)).reshape(-1, step, 64)
    total = ones[:, 0]
    for j in range(1, step):
        total = total + ones[:, j]
    out = np.zeros((len(total) + 1, 64), np.uint16)
    np.cumsum(total, axis=0, dtype=np.uint16, out=out[1:])  # may wrap; differences stay right
    return out


def _fingerprints(counts: np.ndarray, size: int, step: int) -> np.ndarray:
    width = size // step
    if len(counts) <= width:
        return np.zeros(0, np.uint64)
    major = (counts[width:] - counts[:-width]) > size // 2
    return np.packbits(major, axis=1).view(np.uint64).ravel()


def _windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows."""
    n = len(hashes) - k + 1
    value = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        value += hashes[j : j + n] * np.uint64(_WORD_FACTORS[j])
    return mix(value)


class ItemIndex:
    """The fingerprints of a block of items, by size class, and the shingles to check."""

    def __init__(self, keys: list, texts: list[str]):
        words = runs(pc.utf8_lower(pa.array(texts, pa.string())), _LETTERS)
        self.keys, self.sizes, self.shingles, self.weights = [], [], [], []
        found: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
        for i, key in enumerate(keys):
            a, b = words.first[i], words.first[i + 1]
            if a == b:
                continue
            own, n, k = words.hashes[a:b], int(b - a), min(5, int(b - a))
            length = (words.ends[a:b] - words.starts[a:b]).astype(float)
            values, at = np.unique(_windows(own, k), return_index=True)
            sums = np.concatenate([[0.0], np.cumsum(length)])
            self.shingles.append(values)
            self.weights.append(sums[at + k] - sums[at])
            for size, step in _size_classes(n):
                prints = _fingerprints(_bits(own, 1), size, 1)
                found.setdefault((size, step), []).append((len(self.keys), n, prints))
            self.keys.append(key)
            self.sizes.append(n)
        self.classes = {c: self._index(members) for c, members in found.items()}
        self.lengths = np.array(self.sizes, np.int64)
        self.shingle_words = np.minimum(self.lengths, 5)
        self.totals = np.array([w.sum() for w in self.weights])
        self.by_length = {}  # all items' shingles and their weights; equal shingles weigh alike
        for k in set(self.shingle_words.tolist()):
            every = [np.concatenate([x[i] for i in np.flatnonzero(self.shingle_words == k)]) for x in (self.shingles, self.weights)]
            known, at = np.unique(every[0], return_index=True)
            self.by_length[k] = known, every[1][at]

    @staticmethod
    def _index(members):
        prints = np.concatenate([p for _, _, p in members])
        item = np.concatenate([np.full(len(p), i) for i, _, p in members])
        offset = np.concatenate([np.arange(len(p)) for _, _, p in members])
        blocks = []
        for column in prints.view(np.uint16).reshape(-1, 4).T:
            spread = (column[:, None] ^ _FLIPS).ravel()
            order = np.argsort(spread, kind="stable")
            bounds = np.searchsorted(spread[order], np.arange(65537))
            blocks.append((bounds, order // len(_FLIPS)))
        return prints, item, offset, blocks

    def candidates(self, windows: np.ndarray, cls: tuple[int, int]):
        """(window, item, offset) of all fingerprints within the radius."""
        prints, item, offset, blocks = self.classes[cls]
        columns = windows.view(np.uint16).reshape(-1, 4)
        at, to = [], []
        for j, (bounds, entries) in enumerate(blocks):
            value = columns[:, j].astype(np.int64)
            hit = np.flatnonzero(bounds[value + 1] > bounds[value])
            begin, many = bounds[value[hit]], bounds[value[hit] + 1] - bounds[value[hit]]
            for part in _portions(many):
                own = many[part]
                place = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
                w, p = np.repeat(hit[part], own), entries[place]
                near = np.bitwise_count(windows[w] ^ prints[p]) <= RADIUS
                at.append(w[near])
                to.append(p[near])
        both = np.unique(np.column_stack([np.concatenate(at), np.concatenate(to)]), axis=0) if at else np.zeros((0, 2), np.int64)
        return both[:, 0], item[both[:, 1]], offset[both[:, 1]]

    def _stretches(self, words) -> tuple[np.ndarray, ...]:
        """(text, item, low, high, begin) of the stretches around all windows near an item's fingerprint, each once."""
        found = []
        longest = max((size for size, _ in self.classes), default=0)
        for span in range(0, len(words.hashes), _SPAN):
            own = words.hashes[span : span + _SPAN + longest]
            counts = {step: _bits(own, step) for step in {s for _, s in self.classes}}
            for size, step in self.classes:
                windows = _fingerprints(counts[step], size, step)[: _SPAN // step]
                starts = span + np.arange(len(windows)) * step
                owner = np.searchsorted(words.first, starts, "right") - 1
                inside = np.flatnonzero(starts + size <= words.first[owner + 1])  # not across two texts
                at, items, offsets = self.candidates(windows[inside], (size, step))
                found.append(np.column_stack([owner[inside[at]], items, starts[inside[at]] - offsets]))
        found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        text, item, begin = found.T
        n = self.lengths[item]
        low = np.maximum(begin - 2 - n // 10, words.first[text])
        return text, item, low, np.minimum(begin + n + 2 + n // 10, words.first[text + 1]), np.maximum(begin, words.first[text])

    def leaks(self, texts: pa.Array, least: float):
        """(text number, item number, first word, words, similarity) of the best place of each item in each text.

        A stretch's shingles that any item has are summed up beforehand, for all stretches at once; only where that sum reaches the wanted share of the stretch's own item
        are the two sets compared.
        """
        words = runs(pc.utf8_lower(texts.cast(pa.large_string())), _LETTERS)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        text, item, low, high, begin = self._stretches(words)
        for k, (known, weights) in self.by_length.items():
            own = np.flatnonzero(self.shingle_words[item] == k)
            if not len(own):
                continue
            hashes = _windows(words.hashes, k)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            sums = np.concatenate([[0.0], np.cumsum(np.where(known[at] == hashes, weights[at], 0.0))])
            first, last = low[own], np.maximum(high[own] - k + 1, low[own])
            own = own[(sums[last] - sums[first]) * (1 + 1e-9) >= least * self.totals[item[own]]]
            for t, i, a, b, place in zip(*(x[own].tolist() for x in (text, item, low, high, begin))):
                there = np.isin(self.shingles[i], hashes[a : max(b - k + 1, a)])
                similarity = float(self.weights[i][there].sum() / self.weights[i].sum())
                place -= int(words.first[t])
                earlier = best.get((t, i))
                if similarity >= least and (earlier is None or (-similarity, place) < (-earlier[0], earlier[1])):
                    best[t, i] = (similarity, place, self.sizes[i])
        return [(text, i, place, n, s) for (text, i), (s, place, n) in sorted(best.items())]


def _portions(many: np.ndarray, most: int = 1 << 20):
    """Slices of consecutive entries with at most about ``most`` pairs, so that memory stays bounded."""
    ends = np.cumsum(many)
    begin = 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)))
        yield slice(begin, end)
        begin = end


def item_blocks(items: DataFrame, key: str, text: str, block: int):
    """Indexes of all items with a text, at most about ``block`` items each, one after the other."""
    own = items.select(F.col(key).alias("key"), F.col(text).alias("body")).where("body is not null and body <> ''")
    parts = -(-own.count() // block)
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("key", "body"), F.lit(parts)) == part).orderBy("key", "body").collect()
        yield ItemIndex([r.key for r in rows], [r.body for r in rows])


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    similarity: float = 0.8, block: int = 5000,
) -> DataFrame:
    """key, item_id, first_word, n_words, similarity: the best place of each item in each document that holds it.

    Words are runs of letters and digits in lower case. similarity is the weighted share of the item's 5-word shingles (fewer words: the
    whole item) in the stretch. Items without a word are found nowhere; repeated items are found each. Null or empty documents hold nothing;
    a null key or item key is passed on; repeated rows give repeated results. Items go to the workers in blocks of at most about
    ``block``, whatever their number, and each block passes over all documents; no documents are shuffled.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType),
        T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType()),
    ])
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    out = None
    for index in item_blocks(items, item_key, item_text, block):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(schema)
            for whole in batches:
                for batch in pieces(whole, 1):
                    found = shared.value.leaks(batch.column(1), similarity)
                    numbers = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(numbers), pa.array([shared.value.keys[f[1]] for f in found], kinds.field(1).type),
                        *(pa.array([f[j] for f in found], kinds.field(j).type) for j in (2, 3, 4)),
                    ], schema=kinds)

        part = source.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaking(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, block: int = 5000) -> DataFrame:
    """``docs`` without the rows that hold an item; all other rows, null texts too, and all columns stay."""
    out = docs
    for index in item_blocks(items, item_key, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index(text)

        def keep(batches, shared=shared):
            for whole in batches:
                for batch in pieces(whole, at):
                    leaking = {f[0] for f in shared.value.leaks(batch.column(at), similarity)}
                    yield batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)]))

        out = out.mapInArrow(keep, docs.schema)
    return out
