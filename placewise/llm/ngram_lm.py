"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Tasks count their own texts first and send packed, sorted blocks to shards of the hash range; a shard's blocks are merged into one file of
sorted arrays in the shared folder. Scoring tasks map these files and look up sorted batches of distinct words and pairs. A word is known by 64 bits
of its hash, the second word of a pair by 40.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.rows import add_columns, pieces
from placewise.llm.words import LOWER_ASCII, mix, runs
from placewise.tables import fresh_path, materialize, shuffle_width

BEGIN, END = (int(x) for x in mix(np.array([0xB0, 0xE0], np.uint64)))
_LOW = np.uint64(24)  # a pair's second word keeps the upper 40 bits
_WIDE = np.uint64(40)
_HELD = 2_000_000  # pairs that a counting task holds before it sends them on

BLOCKS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("payload", T.BinaryType())])


# --- packed arrays ------------------------------------------------------------------------------------------
def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
        out.write(b"\0" * (-out.tell() % 64))
    return out.getvalue()


def unpack(data) -> list[np.ndarray]:
    """The arrays as views of ``data`` (bytes or a mapped file)."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        head = io.BytesIO(view[at : at + 512])
        np.lib.format.read_magic(head)
        shape, _, dtype = np.lib.format.read_array_header_1_0(head)
        begin = at + head.tell()
        out.append(np.frombuffer(view, dtype, int(np.prod(shape)), begin).reshape(shape))
        at = begin + out[-1].nbytes
        at += -at % 64
    return out


def _narrow(counts: np.ndarray) -> list[np.ndarray]:
    """Small counts in a byte each, larger ones aside."""
    large = np.flatnonzero(counts > 254)
    return [np.where(counts > 254, 255, counts).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.uint64)]


def _widen(small: np.ndarray, at: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.uint64)
    out[at] = large
    return out


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _pairs_by(u: np.ndarray, v: np.ndarray, counts: np.ndarray):
    """(distinct first words, their numbers of pairs, second words, counts), sorted by both words."""
    words, rank = np.unique(u, return_inverse=True)
    keys, counts = _sum_by((rank.astype(np.uint64) << _WIDE) | v, counts)
    many = np.bincount((keys >> _WIDE).astype(np.int64), minlength=len(words))
    return words, many, keys & np.uint64((1 << 40) - 1), counts


def _five_bytes(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :5])


def _from_five(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 8), np.uint8)
    out[:, :5] = v
    return out.view(np.uint64).ravel()


# --- files in the shared folder -----------------------------------------------------------------------------
def _plain(path: str) -> str | None:
    """The path for open(), if the shared folder is mounted; else None."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return "/" + rest.lstrip("/") if scheme == "file" else None
    return path


def write_shared(path: str, data: bytes) -> None:
    """Write a file whole or not at all, so a lost or repeated task leaves nothing half done."""
    if (own := _plain(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        part = f"{own}.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            file.write(data)
        os.replace(part, own)
        return
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(name))
    part = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


@lru_cache(maxsize=256)
def map_shared(path: str) -> list[np.ndarray] | None:
    """The arrays of a file, memory-mapped; None if no task wrote it. A store that cannot be mapped is copied to the worker's disk once."""
    own = _plain(path)
    if own is None:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        if system.get_file_info(name).type == fs.FileType.NotFound:
            return None
        own = os.path.join(tempfile.mkdtemp(prefix="lm-"), "shard")
        fs.copy_files(name, own, source_filesystem=system)
    elif not os.path.exists(own):
        return None
    return unpack(np.memmap(own, np.uint8, "r"))


# --- training -----------------------------------------------------------------------------------------------
def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, first token of each text) with the end tokens in place."""
    words = runs(texts, fold=LOWER_ASCII)
    first = words.first + np.arange(len(words.first))
    tokens = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner], tokens[ends] = words.hashes, END
    before = np.empty(len(tokens), np.uint64)
    before[1:] = tokens[:-1]
    before[first[:-1]] = BEGIN
    return tokens, before, first


def _shard_slices(keys: np.ndarray, shards: int):
    """(shard, slice) of sorted 64-bit hashes."""
    numbers = (keys >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    bounds = np.searchsorted(numbers, np.arange(shards + 1))
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if b > a]


def _count_blocks(shards: int):
    """Texts to packed blocks of word counts (kind 0) and pair counts (kind 1)."""

    def send(held):
        words, counts = _sum_by(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        rows = [(0, s, pack(words[part], *_narrow(counts[part]))) for s, part in _shard_slices(words, shards)]
        firsts, many, seconds, counts = _pairs_by(*(np.concatenate([h[i] for h in held]) for i in (2, 3, 4)))
        ends = np.concatenate([[0], np.cumsum(many)])
        for s, part in _shard_slices(firsts, shards):
            own = slice(ends[part.start], ends[part.stop])
            rows.append((1, s, pack(firsts[part], many[part].astype(np.uint32), _five_bytes(seconds[own]), *_narrow(counts[own]))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=BLOCKS.names)

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for batch in pieces(whole, 0, 1 << 20):
                tokens, before, _ = _tokens(batch.column(0))
                words, many, seconds, counts = _pairs_by(before, tokens >> _LOW, np.ones(len(tokens), np.uint64))
                held.append((*_sum_by(tokens, np.ones(len(tokens), np.uint64)), np.repeat(words, many), seconds, counts))
                size += len(seconds)
                if size > _HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return run


def _blocks(table: pa.Table) -> list[list[np.ndarray]]:
    """The arrays of a group's blocks, without copies."""
    return [unpack(p.as_buffer()) for p in table.column("payload")]


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(np.int64)


def _merge_counts(folder: str, shards: int):
    """A shard's blocks to: merged word counts (kind 0); for pairs a file, the numbers of different words before each word (kind 2), figures (kind 3)."""

    def merge(key, table):
        kind, shard = (k.as_py() for k in key)
        blocks = _blocks(table)
        rows = []
        if kind == 0:
            words, counts = _sum_by(np.concatenate([b[0] for b in blocks]), np.concatenate([_widen(*b[1:4]) for b in blocks]))
            rows.append((0, shard, pack(words, *_narrow(counts))))
        else:
            firsts, many, seconds, counts = _pairs_by(
                np.concatenate([np.repeat(b[0], b[1]) for b in blocks]), np.concatenate([_from_five(b[2]) for b in blocks]), np.concatenate([_widen(*b[3:6]) for b in blocks])
            )
            del blocks
            ends = np.concatenate([[0], np.cumsum(many)])
            sums = lambda x: np.add.reduceat(x.astype(np.uint64), ends[:-1])
            context = np.column_stack([sums(counts), sums(counts == 1), sums(counts == 2), sums(counts > 2)])
            keys = (np.repeat(np.arange(len(firsts), dtype=np.uint64), many) << _WIDE) | seconds
            figures = _counts_of_counts(counts)
            wide = counts.astype(np.uint32) if counts.max() < 2**32 else counts
            write_shared(f"{folder}/pairs-{shard}", pack(firsts, context, keys, wide))
            del keys
            after, times = _sum_by(seconds, np.ones(len(seconds), np.uint64))
            for s, part in _shard_slices(after << _LOW, shards):
                rows.append((2, s, pack(_five_bytes(after[part]), *_narrow(times[part]))))
            rows.append((3, shard, pack(figures)))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=BLOCKS.names)

    return merge


FIGURES = T.StructType([T.StructField(n, T.LongType()) for n in ("tokens", "words", "pairs", "n1", "n2", "n3", "n4")])


def _merge_words(folder: str):
    """A shard's word counts and numbers of different words before: one file, and its figures."""

    def merge(key, table):
        shard = key[0].as_py()
        kinds = table.column("kind").to_pylist()
        blocks = _blocks(table)
        own = [b for k, b in zip(kinds, blocks) if k == 0]
        words, counts = _sum_by(np.concatenate([b[0] for b in own]), np.concatenate([_widen(*b[1:4]) for b in own]))
        after = [b for k, b in zip(kinds, blocks) if k == 2]
        seconds, times = _sum_by(np.concatenate([_from_five(b[0]) for b in after]), np.concatenate([_widen(*b[1:4]) for b in after]))
        at = np.minimum(np.searchsorted(seconds, words >> _LOW), len(seconds) - 1)
        write_shared(f"{folder}/words-{shard}", pack(words, counts, times[at].astype(np.uint32)))
        values = [int(counts.sum()), len(words), int(times.sum()), *_counts_of_counts(times).tolist()]
        return pa.table([pa.array([v], pa.int64()) for v in values], names=FIGURES.names)

    return merge


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; 0.5, 1, 1.5 where the counts of counts cannot tell."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


@dataclass
class BigramModel:
    """Where the arrays lie and the few figures that hold for all of them."""

    folder: str
    shards: int
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    pair_discounts: tuple = (0.5, 1.0, 1.5)
    word_discounts: tuple = (0.5, 1.0, 1.5)
    word_rest: float = field(default=1.0)  # share of the uniform distribution in the word probabilities

    def _discounted(self, counts: np.ndarray, by: tuple) -> np.ndarray:
        return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0.0)

    def look_up_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number of different words before) of sorted distinct words."""
        counts, before = np.zeros(len(words)), np.zeros(len(words))
        for shard, part in _shard_slices(words, self.shards):
            if (arrays := map_shared(f"{self.folder}/words-{shard}")) is not None:
                own, at = words[part], np.minimum(np.searchsorted(arrays[0], words[part]), len(arrays[0]) - 1)
                known = arrays[0][at] == own
                counts[part], before[part] = np.where(known, arrays[1][at], 0), np.where(known, arrays[2][at], 0)
        return counts, before

    def look_up_pairs(self, firsts: np.ndarray, many: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair count, context figures) of pairs sorted by both words."""
        counts, context = np.zeros(len(seconds)), np.zeros((len(firsts), 4))
        ends = np.concatenate([[0], np.cumsum(many)])
        for shard, part in _shard_slices(firsts, self.shards):
            if (arrays := map_shared(f"{self.folder}/pairs-{shard}")) is None:
                continue
            words, figures, keys, values = arrays
            rank = np.minimum(np.searchsorted(words, firsts[part]), len(words) - 1)
            known = words[rank] == firsts[part]
            context[part] = np.where(known[:, None], figures[rank], 0)
            own = slice(ends[part.start], ends[part.stop])
            wanted = (np.repeat(rank.astype(np.uint64), many[part]) << _WIDE) | seconds[own]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            counts[own] = np.where((keys[at] == wanted) & np.repeat(known, many[part]), values[at], 0)
        return counts, np.repeat(context, many, axis=0)

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of each text."""
        tokens, before, first = _tokens(texts)
        words, where = np.unique(tokens, return_inverse=True)
        counts, different = self.look_up_words(words)
        base = np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        lower = self._discounted(different, self.word_discounts) / max(self.pairs, 1) + self.word_rest / (self.words + 1)
        contexts, rank = np.unique(before, return_inverse=True)
        keys, back = np.unique((rank.astype(np.uint64) << _WIDE) | (tokens >> _LOW), return_inverse=True)
        many = np.bincount((keys >> _WIDE).astype(np.int64), minlength=len(contexts))
        pair, figures = self.look_up_pairs(contexts, many, keys & np.uint64((1 << 40) - 1))
        total = np.maximum(figures[:, 0], 1)
        known = figures[:, 0] > 0
        higher = np.where(known, self._discounted(pair, self.pair_discounts) / total, 0.0)
        left = np.where(known, figures[:, 1:] @ np.array(self.pair_discounts) / total, 1.0)
        logs = np.log10(higher[back] + left[back] * lower[where])
        each = lambda values: np.add.reduceat(values, first[:-1]) if len(first) > 1 else values
        return [np.diff(first), each((counts > 0)[where].astype(np.int64)), each(base[where]), each(logs)]


def train_bigrams(docs: DataFrame, text: str = "text", shards: int | None = None) -> BigramModel:
    """A model of the whole texts of ``docs``, its arrays in the shared folder.

    Words are lower-cased (A-Z) runs without white space; every text, empty ones too, ends with an end token. Null: an empty text. The
    number of shards follows the session's shuffle partitions (the setting that grows with the data), so a shard fits into a task.
    """
    spark = docs.sparkSession
    shards = shards or 1 << max(6, (shuffle_width(spark) - 1).bit_length())
    folder = fresh_path(spark)
    blocks = docs.select(F.col(text).alias("body")).mapInArrow(_count_blocks(shards), BLOCKS)
    merged = materialize(blocks.groupBy("kind", "shard").applyInArrow(_merge_counts(folder, shards), BLOCKS))
    figures = materialize(merged.where("kind in (0, 2)").groupBy("shard").applyInArrow(_merge_words(folder), FIGURES))
    sums = figures.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in FIGURES.names]).first()
    # At most one short row a shard comes to the driver.
    counts = sum((unpack(r.payload)[0] for r in merged.where("kind = 3").select("payload").collect()), np.zeros(4, np.int64))
    model = BigramModel(folder, shards, sums.tokens, sums.words, sums.pairs, _discounts(counts.tolist()), _discounts([sums.n1, sums.n2, sums.n3, sums.n4]))
    if sums.pairs:
        d, over = model.word_discounts, sums.words - sums.n1 - sums.n2
        model.word_rest = (d[0] * sums.n1 + d[1] * sums.n2 + d[2] * over) / sums.pairs
    return model


def is_held_out(key: Column | str) -> Column:
    """Whether a key's text is kept from training; a null key's is not."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string") if isinstance(key, str) else key, "UTF-8")), F.lit(10)) == 0, F.lit(False))


def score_documents(docs: DataFrame, model: BigramModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score (smoothed word counts) and score (the model's log10 probability); perplexity is 10 ** (-score / n_tokens)."""
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    return add_columns(docs, text, fields, model.score, arrow=True, keep_text=keep_text)
