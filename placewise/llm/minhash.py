"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates, exact checks.

Sets of word shingles are compared; equal sets are one set from the start, so a group of copies is one row. Candidate links are stars: a
bucket's sets are compared with its most central one, the one that shares most buckets with others. Where a small bucket still holds
sets of different groups, all those pairs are compared. In a large one further stars around other sets follow, round by round, as long
as a round finds a link. What then stays open in large buckets is joined exactly: two sets similar enough share a shingle among the rarest of
each (the prefix of the set in the order of frequency), so only sets of different groups that share such a shingle are compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.components import connected_components
from placewise.llm.rows import add_columns
from placewise.llm.words import LOWER_ASCII, mix, runs, shingles
from placewise.tables import by_shuffle, materialize

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
SMALL = 16  # sets in a bucket whose open pairs are all compared; in larger ones those that share a rare shingle
SALTS = 16  # parts of a hot shingle's holders
_PROBES = 24
_SPOTS = 1 << 26  # bits of a table that is broadcast: 8 MB, however many keys there are
_SPOTS_A_ROW = 1 << 15


@lru_cache(maxsize=1)
def _detours() -> np.ndarray:
    """For each bin a random order of all bins, the same in every task: where an empty bin looks for a value."""
    rng = np.random.default_rng(20)
    return np.argsort(rng.random((BINS, BINS)), axis=1)


@lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    """The smallest hash of each bin: bins are equal intervals of the hash range."""
    return np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """One value per bin of a sorted, non-empty set of 64-bit hashes: the bin's smallest, or that of the first full bin on its detour."""
    at = np.searchsorted(sorted_set, _edges())
    ends = np.append(at[1:], len(sorted_set))
    full = ends > at
    lowest = sorted_set[np.minimum(at, len(sorted_set) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        for width in (_PROBES, BINS):
            detour = _detours()[empty, :width]
            hit = full[detour]
            good = hit.any(1)
            lowest[empty[good]] = lowest[detour[good, hit[good].argmax(1)]]
            empty = empty[~good]
            if not len(empty):
                break
    return lowest


def distinct_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, first = shingles(runs(texts, fold=LOWER_ASCII), k)
    return [np.unique(values[a:b]) for a, b in zip(first, first[1:])]


_BAND_FACTORS = mix(np.arange(1, BINS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def _names(sets: list[np.ndarray]) -> list[list[int]]:
    """Size and two 64-bit sums of each set: they tell equal sets."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [[len(s) for s in sets], [signed(int(s.sum(dtype=np.uint64))) for s in sets], [signed(int(mix(s).sum(dtype=np.uint64))) for s in sets]]


def _describe(k: int):
    def compute(texts):
        sets = distinct_sets(texts, k)
        bands = [mix((signature(s).reshape(BANDS, ROWS) * _BAND_FACTORS).sum(1, dtype=np.uint64)).view(np.int64) if len(s) else None for s in sets]
        return [*_names(sets), bands]

    return compute


def _members(k: int):
    def compute(texts):
        sets = distinct_sets(texts, k)
        return [*_names(sets), [s.view(np.int64) for s in sets]]

    return compute


_NAME = ["n_shingles", "low", "high"]


def _maybe_among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` with _pw_maybe: false where ``column`` is surely not in ``keys`` (one column), true for all that are and a few more.

    Keys are bits of a table of at most ``_SPOTS`` bits, so most texts need not be shuffled to leave a few keys' rows out, and what is broadcast has a bound.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(_SPOTS))
    row = lambda c: F.floor(c / _SPOTS_A_ROW).cast("long").alias("_pw_spots_row")
    at = keys.select(spot(keys.columns[0]).alias("_pw_spot"))
    spots = materialize(at.groupBy(row(F.col("_pw_spot"))).agg(F.expr(f"bitmap_construct_agg(_pw_spot % {_SPOTS_A_ROW})").alias("_pw_spots")))
    found = rows.withColumn("_pw_spot", spot(column)).withColumn("_pw_spots_row", row(F.col("_pw_spot"))).join(F.broadcast(spots), "_pw_spots_row", "left")
    byte = F.expr(f"cast(conv(hex(substring(_pw_spots, cast(_pw_spot % {_SPOTS_A_ROW} div 8 as int) + 1, 1)), 16, 10) as bigint)")
    maybe = F.coalesce(F.getbit(byte, (F.col("_pw_spot") % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn("_pw_maybe", maybe).drop("_pw_spot", "_pw_spots_row", "_pw_spots")


def _pair(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _stars(shared: DataFrame, hubs: DataFrame, where="true") -> DataFrame:
    """Pairs (a, b) of each set with its buckets' hubs."""
    return shared.join(by_shuffle(hubs), ["band", "value"]).where("set_id <> hub").where(where).select(*_pair("set_id", "hub")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose full sets have a similarity of ``percent`` or more."""
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("a_members"), F.size("members").alias("a_size"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("b_members"), F.size("members").alias("b_size"))
    sized = pairs.join(by_shuffle(left), "a").join(by_shuffle(right), "b")
    # 100 * common >= percent * union needs the smaller set to be large enough; then count.
    possible = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    counted = sized.where(possible).select("a", "b", (F.col("a_size") + F.col("b_size")).alias("both"), F.size(F.array_intersect("a_members", "b_members")).alias("common"))
    return counted.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b")


def _rare_pairs(open_rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different groups that share a shingle of their prefixes and whose sizes allow ``percent``: all that may be linked.

    ``open_rows`` has set_id and component, a row a bucket. Of n shingles, n - ceil(n * percent / 100) + 1 in the order of frequency among the open
    sets are the prefix: linked sets share one. Frequencies are those of the open sets, so what all of them hold stands last.
    """
    own = open_rows.select("set_id", "component").distinct().join(by_shuffle(members), "set_id")
    tokens = materialize(own.select("set_id", "component", F.size("members").alias("size"), F.explode("members").alias("token")))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    # Unshared shingles stand first in the order: they fill the prefix but make no pairs.
    ranked = tokens.join(by_shuffle(counts), "token").groupBy("set_id", "component", "size").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("shared"))
    prefix = F.expr(f"size - cast(ceil(size * {percent} / 100) as int) + 1 - (size - size(shared))")
    exploded = ranked.withColumn("n", prefix).where("n > 0").select("set_id", "component", "size", (F.col("size") - F.size("shared")).alias("before"), F.posexplode(F.slice("shared", F.lit(1), F.col("n"))).alias("at", "s"))
    # rest: shingles from this one on, in the order of frequency
    heads = materialize(exploded.select("set_id", "component", "size", (F.col("size") - F.col("before") - F.col("at")).alias("rest"), "s.token"))
    left = heads.select("token", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).alias("salt"), *(F.col(c).alias(f"a_{c}") for c in ("set_id", "component", "size", "rest")))
    right = heads.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), *(F.col(c).alias(f"b_{c}") for c in ("set_id", "component", "size", "rest")))
    possible = (F.col("a_set_id") < F.col("b_set_id")) & (F.col("a_component") != F.col("b_component"))
    possible &= 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    # The first shingle that two linked sets share has enough left from there on in both; so most pairs by a family's own words fall here.
    possible &= (100 + percent) * F.least("a_rest", "b_rest") >= percent * (F.col("a_size") + F.col("b_size"))
    return left.join(by_shuffle(right), ["token", "salt"]).where(possible).select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept of every row.

    A text's set holds its distinct ``k``-word shingles (A-Z lower-cased; fewer words: the whole sequence as one; none: empty). Texts are
    linked if 100 * intersection >= ``percent`` * union, checked on the full sets; an empty set is linked with nothing. component_id is
    the smallest key that can be reached, kept tells the row with that key. A repeated key with different texts joins their groups' rows
    by the texts, each row by its own; of repeated rows with one key all are kept. Rows with a null key are single: component_id null, kept.

    Candidates share a band of ``ROWS`` of ``BINS`` values; at a similarity of 0.85 two sets share none with a probability of 3e-7 (0.8: 6e-5).
    All sets that share a band and are similar come into one group, in buckets of any size.
    """
    fields = [("n_shingles", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    described = materialize(add_columns(source, "body", fields, _describe(k), arrow=True, keep_text=False))
    usable = described.where("n_shingles > 0 and key is not null")
    sets = materialize(usable.groupBy("n_shingles", "low", "high").agg(F.min("key").alias("set_id"), F.first("bands").alias("bands")))

    buckets = sets.select("set_id", F.posexplode("bands").alias("band", "value"))
    counts = buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(buckets.join(by_shuffle(counts), ["band", "value"]))
    open_ids = materialize(shared.groupBy("set_id").agg(F.sum("n").alias("degree")))
    # Only the sets that share a bucket are needed in full, and a few others do no harm.
    texts = _maybe_among(source.where("key is not null"), "key", open_ids.select("set_id")).where("_pw_maybe").drop("_pw_maybe")
    fields = [*fields[:3], ("members", T.ArrayType(T.LongType()))]
    full = add_columns(texts, "body", fields, _members(k), arrow=True, keep_text=False).withColumnRenamed("key", "set_id")
    named = sets.select("set_id", *_NAME)  # a repeated key may have another text
    members = materialize(full.join(by_shuffle(named), ["set_id", *_NAME]).select("set_id", "members").dropDuplicates(["set_id"]))

    ids = open_ids.select(F.col("set_id").alias("id"))
    hubs = shared.join(by_shuffle(open_ids), "set_id").groupBy("band", "value").agg(F.max(F.struct("degree", "set_id"))["set_id"].alias("hub"))
    tested = materialize(_stars(shared, hubs))
    links = materialize(_verified(tested, members, percent))
    groups = connected_components(links, ids)
    rounds = 0
    while True:
        rounds += 1
        placed = shared.join(by_shuffle(groups.withColumnRenamed("id", "set_id")), "set_id")
        mixed = placed.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        rest = materialize(placed.join(by_shuffle(mixed.select("band", "value")), ["band", "value"]))
        large = rest.where(F.col("n") > SMALL)
        hubs = large.groupBy("band", "value").agg(F.min(F.struct(F.xxhash64("set_id", F.lit(rounds)).alias("draw"), "set_id", "component")).alias("h"))
        hubs = hubs.select("band", "value", F.col("h.set_id").alias("hub"), F.col("h.component").alias("hub_component"))
        pairs = _stars(large, hubs, F.col("component") != F.col("hub_component"))
        if rounds == 1:
            small = rest.where(F.col("n") <= SMALL)
            other = small.select("band", "value", F.col("set_id").alias("o_id"), F.col("component").alias("o_component"))
            pairs = pairs.unionByName(small.join(by_shuffle(other), ["band", "value"]).where("component < o_component").select(*_pair("set_id", "o_id"))).distinct()
        pairs = materialize(pairs.join(by_shuffle(tested), ["a", "b"], "left_anti"))
        found = materialize(_verified(pairs, members, percent))
        if found.isEmpty():
            pairs = materialize(_rare_pairs(large, members, percent).join(by_shuffle(tested), ["a", "b"], "left_anti"))
            links = links.unionByName(materialize(_verified(pairs, members, percent)))
            groups = connected_components(links, ids)
            break
        tested, links = tested.unionByName(pairs), links.unionByName(found)
        groups = connected_components(links, ids)

    joined = described.drop("bands").join(by_shuffle(sets.select(*_NAME, "set_id")), _NAME, "left")
    joined = joined.join(by_shuffle(groups.withColumnRenamed("id", "set_id")), "set_id", "left")
    component = F.when(F.col("key").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.coalesce("component", "set_id"))
    out = joined.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("component_id")))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of a near-duplicate group that are not its smallest key; all other rows and all columns stay.

    Rows go by their own text: of a key with two texts only the one in a smaller key's group goes. Of repeated rows and of near texts under one key one stays. Rows with a null
    key or without words all stay.
    """
    # The text's hash makes the rows of a repeated key different ones, in the keys' order.
    own = F.when(docs[key].isNotNull(), F.struct(docs[key].alias("key"), F.xxhash64(docs[text]).alias("mark")))
    judged = near_duplicates(docs.select(own.alias("_pw_own"), docs[text].alias("_pw_text")), "_pw_own", "_pw_text", k, percent).where("_pw_own is not null and n_shingles > 0")
    counted = materialize(judged.groupBy("_pw_own").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    keys = counted.groupBy(F.col("_pw_own.key").alias("_pw_key")).agg(F.sum("n").alias("n"), F.min("kept").alias("kept"))
    apart = materialize(keys.where("n > 1 or not kept").select("_pw_key", (F.col("n") > 1).alias("repeated")))
    marked = _maybe_among(docs.select(docs[key].alias("_pw_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_pw_row")), "_pw_key", apart.select("_pw_key"))
    near = marked.where("_pw_maybe").join(by_shuffle(apart.select("_pw_key")), "_pw_key", "left_anti")
    clear = marked.where(~F.col("_pw_maybe")).select("_pw_row.*").union(near.select("_pw_row.*"))
    repeated = apart.where("repeated").select("_pw_key")
    if repeated.isEmpty():
        return clear
    rows = docs.select(docs[key].alias("_pw_key"), own.alias("_pw_own"), F.struct(*[docs[c] for c in docs.columns]).alias("_pw_row")).join(by_shuffle(repeated), "_pw_key", "left_semi")
    worded = rows.join(by_shuffle(counted.where("kept").select("_pw_own")), "_pw_own", "left_semi").dropDuplicates(["_pw_own"])
    wordless = rows.join(by_shuffle(counted.select("_pw_own")), "_pw_own", "left_anti")
    return clear.unionByName(worded.unionByName(wordless).select("_pw_row.*"))
