"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry.

Components are whole numbers (``floor(scale * x)``), so distances and means are exact and do not depend on the order of rows. To find the nearest
entry of a part, the part's coarse grid cell is hashed and looked up in a cache; a cell seen first is given the entries that are not dominated across its box (an entry
is dominated if its smallest distance to the box is larger than some entry's largest). Only these are evaluated for the part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.rows import add_columns, pieces
from placewise.llm.words import mix

_CELLS_HELD = 1 << 15  # cells held for one part position; a fuller cache starts anew
_CELLS_AT_ONCE = 1 << 12


class CellCache:
    """The entries that can be nearest somewhere in a grid cell, for the cells of one part position."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.width = entries, width
        self.evaluated = self.rows = 0
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, self.entries.shape[1]), np.int64)
        self.open = np.zeros((0, len(self.entries)), bool)

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cells), len(self.entries)), bool)
        for begin in range(0, len(cells), _CELLS_AT_ONCE):
            low = cells[begin : begin + _CELLS_AT_ONCE, None, :] * self.width
            high = low + (self.width - 1)
            under, over = low - self.entries, self.entries - high
            least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
            most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
            out[begin : begin + _CELLS_AT_ONCE] = least <= most.min(axis=1, keepdims=True)
        return out

    def _candidates(self, parts: np.ndarray) -> np.ndarray:
        cells = parts // self.width
        hashed = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            hashed = mix(hashed + column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        own = cells[first]
        known = np.zeros(len(keys), bool)
        open_ = np.zeros((len(keys), len(self.entries)), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = (self.keys[at] == keys) & (self.cells[at] == own).all(axis=1)
            open_[known] = self.open[at[known]]
        new = ~known
        open_[new] = self._undominated(own[new])
        if new.any():
            if len(self.keys) + new.sum() > _CELLS_HELD:
                self._forget()
            keys, cells_held, open_held = (np.concatenate(x) for x in ((self.keys, keys[new]), (self.cells, own[new]), (self.open, open_[new])))
            order = np.argsort(keys, kind="stable")
            self.keys, self.cells, self.open = keys[order], cells_held[order], open_held[order]
        out = open_[inverse]
        out[(own[inverse] != cells).any(axis=1)] = True  # two cells with one hash
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part; the lowest of equally near entries."""
        rows, entries = np.nonzero(self._candidates(parts))
        self.evaluated, self.rows = self.evaluated + len(rows), self.rows + len(parts)
        distance = ((parts[rows] - self.entries[entries]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(distance, np.searchsorted(rows, np.arange(len(parts))))
        hit = np.flatnonzero(distance == best[rows])
        return entries[hit[np.unique(rows[hit], return_index=True)[1]]], best


@dataclass
class Codebooks:
    """``entries`` is a whole-number array (parts, entries, components of a part)."""

    entries: np.ndarray
    scale: float
    width: int

    @property
    def sha256(self) -> str:
        """Digest of all components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def caches(self) -> list[CellCache]:
        """The caches of this worker process; those of earlier codebooks go."""
        key = (self.sha256, self.entries.shape, self.width)
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = [CellCache(e, self.width) for e in self.entries]
        return _CACHES[key]

    def assign(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whole-number parts, entry of each part, squared distances) of a column of vectors."""
        parts, _, size = self.entries.shape
        values = whole_numbers(column, parts * size, self.scale).reshape(-1, parts, size)
        found = [cache.nearest(np.ascontiguousarray(values[:, p])) for p, cache in enumerate(self.caches())]
        return values, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


_CACHES: dict[tuple, list[CellCache]] = {}


def padded(column: pa.Array, dimensions: int) -> np.ndarray:
    """A column of vectors without nulls as float64 rows, shorter vectors filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dimensions).all():
        return flat.reshape(len(column), dimensions)
    out = np.zeros((len(column), dimensions))
    out[np.arange(dimensions) < sizes[:, None]] = flat
    return out


def whole_numbers(column: pa.Array, dimensions: int, scale: float) -> np.ndarray:
    return np.floor(padded(column, dimensions) * scale).astype(np.int64)


def usable_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    v = df[vector]
    return df.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))))


def train_codebooks(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, cell_width: int = 128,
) -> Codebooks:
    """Codebooks of all usable vectors: they start as the vectors with the smallest keys and move to the floor of their parts' means.

    Each round reads all vectors once; a task sends one sum for each entry and component, so what is shuffled and collected does not
    depend on the number of rows. Null vectors and vectors with null or non-finite components are left out. Null keys come last, equal keys are ordered by
    vector. Vectors that are too short (an empty one, too) are filled up with zeros to the longest and to whole parts. Fewer vectors than ``entries`` give
    fewer entries, none gives empty codebooks. Components beyond what squared sums can hold in 64 bits are an error.
    """
    rows = usable_vectors(df, vector).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    size = F.size("vector")
    bounds = rows.agg(F.max(size).alias("size"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    each = max(1, -(-(bounds.size or 0) // parts))
    if (bounds.most or 0.0) * scale + 1 >= (2**60 / (parts * each)) ** 0.5:
        raise ValueError(f"a component of {bounds.most} is too large for exact 64-bit distances")
    first = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).select("vector").toArrow().column(0).combine_chunks()
    start = whole_numbers(first, parts * each, scale).reshape(-1, parts, each).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start), scale, cell_width)
    for _ in range(rounds if len(first) else 0):
        books = _moved(rows.select("vector"), books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; unused entries stay."""
    parts, count, size = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((parts * count, size), np.int64), np.zeros(parts * count, np.int64)
        for whole in batches:
            for batch in pieces(whole, 0):
                values, codes, _ = books.assign(batch.column(0))
                slots = (codes + np.arange(parts) * count).ravel()
                np.add.at(total, slots, values.reshape(-1, size))
                used += np.bincount(slots, minlength=parts * count)
        slots = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(slots, size), pa.int64()), pa.array(np.tile(np.arange(size), len(slots)), pa.int64()),
            pa.array(total[slots].ravel(), pa.int64()), pa.array(np.repeat(used[slots], size), pa.int64()),
        ], names=["slot", "at", "total", "used"])

    made = rows.mapInArrow(sums, "slot long, at long, total long, used long").groupBy("slot", "at").agg(F.sum("total").alias("total"), F.sum("used").alias("used"))
    moved = books.entries.reshape(parts * count, size).copy()
    for row in made.collect():  # at most one row for each component of each entry
        moved[row.slot, row.at] = row.total // row.used
    return Codebooks(moved.reshape(books.entries.shape), books.scale, books.width)


def encode_vectors(df: DataFrame, books: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The rows with usable vectors, with ``code`` (an entry number for each part) and ``error`` (squared distances, summed over the parts).

    All other columns stay; a column that has a new one's name is replaced. Repeated rows stay repeated. An empty table gives an empty table.
    """

    def compute(column):
        _, codes, distances = books.assign(column)
        return [codes.tolist(), distances.sum(axis=1).tolist()]

    return add_columns(usable_vectors(df, vector), vector, [(code, T.ArrayType(T.IntegerType())), (error, T.LongType())], compute, arrow=True)


def decode_vectors(coded: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """``coded`` with the vectors that the codes stand for, in original units; a null code gives a null."""
    flat = F.lit([[[x / books.scale for x in entry] for entry in part] for part in books.entries.tolist()])
    parts = F.zip_with(F.col(code), flat, lambda c, entries: F.get(entries, c))
    return coded.withColumn(vector, F.when(F.col(code).isNotNull(), F.flatten(parts)))
