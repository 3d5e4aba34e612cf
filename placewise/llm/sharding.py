"""Shards of near equal bytes: sampled splitters cut the key space into ranges, overfull ranges are cut again, ranges fill shards."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.tables import materialize

SAMPLES_PER_RANGE = 32


def _table(values: list, kind: str) -> Column:
    """A constant array, written as one literal so that plans stay short."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _lookup(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the key, by halving."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    table = _table(bounds, "bigint")
    fits = lambda at, s: (at + s <= len(bounds)) & (F.coalesce(F.get(table, at + s - 1), F.lit(2**63 - 1)) <= key)
    return F.aggregate(_table(steps, "int"), F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot, range_id of every row; shards have near equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus 1. Equal texts have one key and stay in one shard unless all of
    them together are more than a shard's fair share. A null text counts as an empty one. Slots number a shard's rows from 0
    without gaps. Repeated rows, also with a repeated or null key, each get their own slot. Other columns are left out.

    The number of ranges grows with the rows (512 to 8,192), so a range stays small enough for one task; what the driver holds
    is the range table, at most about twice that many rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = materialize(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("place"),
    ))
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = ranges or min(8192, max(512, n // 1_000_000))
    fair, small = max(total / shards, 1.0), max(total / ranges, 1.0)

    # Size-weighted sample: a row is drawn as often as its share of the bytes asks for, by a hash, so a rerun draws the same.
    draws = F.col("size") * (ranges * SAMPLES_PER_RANGE / max(total, 1))
    part = F.shiftrightunsigned(F.xxhash64("key", "place", F.lit("draw")), 11) / F.lit(2.0**53)
    sample = narrow.select("place", (F.floor(draws) + F.when(part < draws - F.floor(draws), 1).otherwise(0)).cast("long").alias("times")).where("times > 0")
    sample = sample.groupBy("place").agg(F.sum("times").alias("times"))
    seen = F.sum("times").over(Window.orderBy("place"))  # a bounded sample: ranges * SAMPLES_PER_RANGE draws
    cut = F.floor((seen - F.col("times")) / SAMPLES_PER_RANGE) != F.floor(seen / SAMPLES_PER_RANGE)
    bounds = sorted({r.place for r in sample.withColumn("cut", cut).where("cut").select("place").collect()})

    placed = narrow.withColumn("range_id", _lookup(F.col("place"), bounds))
    # Overfull ranges are cut into equal parts of their key interval.
    sizes = {r.range_id: r.bytes for r in placed.groupBy("range_id").agg(F.sum("size").alias("bytes")).collect()}
    edges = [-(2**63), *bounds, 2**63]
    parts = [max(1, -(-sizes.get(i, 0) // int(2 * small + 1))) for i in range(len(edges) - 1)]
    low, wide = [float(e) for e in edges[:-1]], [float(b) - float(a) for a, b in zip(edges, edges[1:])]
    at = lambda values, kind="int": F.get(_table(values, kind), F.col("range_id"))
    share = (F.col("place").cast("double") - at(low, "double")) / at(wide, "double")
    placed = placed.withColumn("part", F.least(F.floor(share * at(parts)), at(parts) - 1).cast("int"))
    # What is still large is mostly one key; it is dealt by row, and stays together as long as a shard can hold it.
    found = placed.groupBy("range_id", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    firsts = [0]
    for p in parts:
        firsts.append(firsts[-1] + p)
    units = [1] * firsts[-1]
    for r in found:
        units[firsts[r.range_id] + r.part] = max(1, -(-r.bytes // int(4 * small + 1)))
    flat = lambda values: F.get(_table(values, "int"), at(firsts[:-1]) + F.col("part"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("key", F.lit("salt")), flat(units).cast("long")).cast("int"))
    offsets = [0]
    for u in units:
        offsets.append(offsets[-1] + u)
    placed = placed.withColumn("unit", (flat(offsets[:-1]) + F.col("salt")).cast("int"))

    counted = {r.unit: (r.bytes, r.rows) for r in placed.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    bundles = []
    for i, width in enumerate(units):
        members = [u for u in range(offsets[i], offsets[i] + width) if u in counted]
        weight = sum(counted[u][0] for u in members)
        bundles += [(weight, members)] if weight <= fair else [(counted[u][0], [u]) for u in members]
    shard_of, slot_of, filled = [0] * offsets[-1], [0] * offsets[-1], [0] * shards
    heap = [(0, s) for s in range(shards)]
    for weight, members in sorted(bundles, key=lambda b: (-b[0], b[1])):  # the largest first, each to the emptiest shard
        held, s = heapq.heappop(heap)
        for u in members:
            shard_of[u], slot_of[u] = s, filled[s]
            filled[s] += counted[u][1]
        heapq.heappush(heap, (held + weight, s))
    by_unit = lambda values, kind: F.get(_table(values, kind), F.col("unit"))
    order = Window.partitionBy("unit").orderBy("place", "key")
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", by_unit(shard_of, "int").alias("shard"),
        (by_unit(slot_of, "bigint") + F.row_number().over(order) - 1).cast("long").alias("slot"), "range_id",
    )
