"""Filter interaction audit: what every filter removes in every order.

A document's failures are a bit mask, and documents count by mask. For each part a Gray-code walk over all subsets of filters toggles one filter at a time and keeps for
every mask the number of active filters it fails, and the survivors (masks that fail none). The stored survivors of all subsets give every step of every order
as a difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.rows import add_columns
from placewise.llm.words import byte_set, runs, utf8
from placewise.tables import materialize

# The filters in their order, and what they look for.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SIGNS = byte_set(b"#$%&*|")
CAPITALS = byte_set(bytes(range(65, 91)))

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(column: pa.Array) -> list[int]:
    """Bits 0 to 3 (filters A to D) of every text; a null text is empty. Distinct words are told apart by 64-bit hashes."""
    words = runs(column)
    counts = words.counts
    order = np.lexsort((words.hashes, words.owner))
    owner, hashes = words.owner[order], words.hashes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    distinct = np.bincount(owner[fresh], minlength=len(counts))
    data, offsets = utf8(column)

    def of(members: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(members[data])])[offsets])

    points = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    failing = [counts < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * counts, 100 * of(CAPITALS) > MOST_CAPITALS_PERCENT * points, of(SIGNS) > 0]
    return sum((f.astype(np.int64) << i for i, f in enumerate(failing)), np.zeros(len(counts), np.int64)).tolist()


def fail_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, docs, good, toxic: how many documents fail exactly the filters of a mask.

    E fails where a smaller key has the same text (null and empty are the same), in any part, removed or not; equal keys and null keys are
    not smaller, and a row without key never fails it. Texts are compared by SHA-256. A key's labels count once, however often they are repeated. A null part is ''.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), F.col(text).alias("body"))
    rows = add_columns(rows, "body", [("mask", T.LongType())], lambda c: [text_failures(c)], arrow=True, keep_text=False)
    said = labels.groupBy(F.col(key).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = rows.join(said, "key", "left").select("key", "part", "digest", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # Counted by key first, then by what can differ within a text: a text with very many copies is few rows when its smallest key is looked for.
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_key = rows.groupBy(*kinds, "key").agg(F.count("*").alias("docs"))
    alike = materialize(by_key.groupBy(*kinds).agg(
        F.sum("docs").alias("docs"), F.min("key").alias("first"), F.min_by("docs", "key").alias("at_first"), F.sum(F.when(F.col("key").isNull(), F.col("docs"))).alias("unkeyed")
    ))
    least = alike.groupBy("digest").agg(F.min("first").alias("least"))
    alike = alike.join(least, "digest")
    passing = F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0) + F.coalesce("unkeyed", F.lit(0))
    split = F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("docs") - passing).alias("n")),
    ))
    cells = alike.select("part", "good", "toxic", split).where("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def surviving(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters. ``cells`` and the result: (parts, masks or subsets, measures)."""
    masks = np.arange(1 << filters)
    failures = np.zeros(1 << filters, np.int64)  # active filters that a mask fails
    alive = cells.sum(axis=1)
    out = np.zeros_like(cells)
    out[:, 0] = alive
    subset = 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1  # the filter that the Gray code toggles
        subset ^= 1 << bit
        touched = masks[masks >> bit & 1 == 1]
        if subset >> bit & 1:
            alive = alive - cells[:, touched[failures[touched] == 0]].sum(axis=1)
            failures[touched] += 1
        else:
            failures[touched] -= 1
            alive = alive + cells[:, touched[failures[touched] == 0]].sum(axis=1)
        out[:, subset] = alive
    return out


def audit_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts: one row for each part, order of the filters and step, zeros too.

    ``cells`` has part, mask, docs, good and toxic. kept are left after the step, removed go in it, redundant fail its filter but went before,
    unique_fails fail no other filter, good_lost and toxic_lost are labelled ones that go in it, shapley is what its filter removes, summed over all orders.
    """
    n = len(filters)
    orders = ["".join(o) for o in permutations(filters)]
    bits = np.array([[filters.index(c) for c in o] for o in orders])
    after = np.cumsum(1 << bits, axis=1)
    before = after - (1 << bits)
    measures = ("docs", "good", "toxic")
    wide = cells.groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(1 << n)]).alias(c) for c in measures
    ])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                own = batch.slice(begin, 256)
                counted = np.stack([own.column(i + 1).flatten().to_numpy().reshape(-1, 1 << n) for i in range(3)], axis=2)
                states = surviving(counted, n)
                lost = states[:, before] - states[:, after]  # (parts, orders, steps, measures)
                fails = np.stack([counted[:, np.arange(1 << n) >> b & 1 == 1, 0].sum(axis=1) for b in range(n)], axis=1)
                only = counted[:, 1 << np.arange(n), 0]
                shapley = np.zeros_like(fails)
                for b in range(n):
                    for s in range(1 << n):
                        if not s >> b & 1:
                            size = s.bit_count()
                            shapley[:, b] += factorial(size) * factorial(n - 1 - size) * (states[:, s, 0] - states[:, s | 1 << b, 0])
                removed = lost[..., 0]
                columns = [states[:, after, 0], removed, fails[:, bits] - removed, only[:, bits], lost[..., 1], lost[..., 2], shapley[:, bits]]
                parts = len(counted)
                yield pa.RecordBatch.from_arrays([
                    own.column(0).take(pa.array(np.repeat(np.arange(parts), len(orders) * n))), pa.array(np.tile(np.repeat(orders, n), parts), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1), parts * len(orders)), pa.int32()), *[pa.array(c.ravel(), pa.int64()) for c in columns],
                ], names=["part", "filter_order", "step", *COUNTS])

    return wide.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five text filters over ``docs``, by part. An empty table has no parts and gives no rows; for odd values see ``fail_masks``."""
    return audit_orders(fail_masks(docs, labels, key, text, part))
