"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all trees, exact ranking of leaf rows.

The inner product becomes a distance by one more component (what a vector's length lacks to the longest). The trees' upper levels are fitted on a bounded sample; every leaf that holds
too many of all rows is cut further by random directions of its tree, at the medians of the leaf's rows, so that cells stay small at any table size. All rows are
indexed. A query takes cells from a queue that all trees share, nearest first, until these hold enough rows, and all rows of the cells are ranked exactly.
Cells are dealt out in bundles; queries and rows of a bundle meet in a task, and only a query's best rows leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.rows import pieces
from placewise.llm.vector_codes import padded, usable_vectors
from placewise.tables import materialize

_CELL_BITS = 32  # of a cell's number, for the cuts below a leaf


@dataclass
class Forest:
    """Nodes of all trees in one numbering; a child below zero is the leaf ``-1 - child``. Leaves are numbered over all trees."""

    roots: list[int]
    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    tree_of_leaf: np.ndarray
    directions: np.ndarray  # (trees, cuts, components)
    scale: float
    longest: float
    counts: np.ndarray | None = None
    cuts: list[np.ndarray] | None = None  # the medians at which a leaf is cut further
    bundle_rows: int = 1 << 14
    bundle_base: np.ndarray | None = None
    bundle_bits: np.ndarray | None = None

    def bundle(self) -> None:
        """Numbers for bundles of about ``bundle_rows`` rows: small leaves of a tree together, the cells of a large leaf by its first cuts."""
        self.bundle_base, self.bundle_bits = np.zeros(len(self.counts), np.int64), np.zeros(len(self.counts), np.int64)
        number = held = 0
        for leaf, rows in enumerate(self.counts):
            if held and (held + rows > self.bundle_rows or self.tree_of_leaf[leaf] != self.tree_of_leaf[leaf - 1]):
                number, held = number + 1, 0
            bits = min(max(0, int(np.ceil(np.log2(max(rows, 1) / self.bundle_rows)))), len(self.cuts[leaf]))
            self.bundle_base[leaf], self.bundle_bits[leaf] = number, bits
            number, held = (number + (1 << bits), 0) if bits else (number, held + rows)

    def bundles(self, cells: np.ndarray) -> np.ndarray:
        leaf, sides = cells >> _CELL_BITS, cells & ((1 << _CELL_BITS) - 1)
        return self.bundle_base[leaf] + (sides & ((1 << self.bundle_bits[leaf]) - 1))

    def points(self, column: pa.Array, query: bool = False) -> np.ndarray:
        """Vectors in the units of the index. Items get the lacking length, queries the length of the longest."""
        x = padded(column, self.normals.shape[1] - 1) * self.scale
        norms = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.column_stack([x * (self.longest / norms)[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every point in every tree."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (moving := np.flatnonzero(at >= 0)).size:
                node = at[moving]
                side = np.einsum("ij,ij->i", x[moving], self.normals[node]) > self.offsets[node]
                at[moving] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of every point in every tree: its leaf and the sides of the leaf's further cuts."""
        leaves = self.leaves(x)
        out = leaves << _CELL_BITS
        for t, directions in enumerate(self.directions):
            shares = x @ directions.T
            for leaf in np.unique(leaves[:, t]):
                if len(medians := self.cuts[leaf]):
                    own = np.flatnonzero(leaves[:, t] == leaf)
                    sides = shares[own, : len(medians)] > medians
                    out[own, t] += sides @ (1 << np.arange(len(medians)))
        return out

    def probes(self, x: np.ndarray, rows: float) -> list[list[int]]:
        """Cells for every query point, nearest first over all trees, until they hold about ``rows`` rows."""
        margins, shares = x @ self.normals.T - self.offsets, x @ self.directions.reshape(-1, x.shape[1]).T
        per_tree = self.directions.shape[1]
        out = []
        for i in range(len(x)):
            own, share = margins[i], shares[i]
            queue = [(0.0, root, 0, 0) for root in self.roots]  # squared distance, node, cut, sides of cuts
            heapq.heapify(queue)
            found, held = [], 0.0
            while queue and held < rows:
                far, node, cut, sides = heapq.heappop(queue)
                while node >= 0:
                    margin = own[node]
                    near = int(margin > 0)
                    heapq.heappush(queue, (far + margin * margin, int(self.children[node, 1 - near]), 0, 0))
                    node = int(self.children[node, near])
                leaf = -1 - node
                medians = self.cuts[leaf]
                begin = int(self.tree_of_leaf[leaf]) * per_tree
                while cut < len(medians):
                    margin = share[begin + cut] - medians[cut]
                    near = int(margin > 0)
                    heapq.heappush(queue, (far + margin * margin, node, cut + 1, sides | (1 - near) << cut))
                    sides |= near << cut
                    cut += 1
                found.append((leaf << _CELL_BITS) + sides)
                held += self.counts[leaf] / (1 << len(medians))
            out.append(found)
        return out


def _plant(x: np.ndarray, trees: int, leaf_rows: int, most_cuts: int, seed: int, scale: float, longest: float) -> Forest:
    """A forest over sample points: each node is cut at the median along the line through two of its points."""
    rng = np.random.default_rng(seed)
    roots, normals, offsets, children, tree_of_leaf = [], [], [], [], []

    def grow(rows: np.ndarray, tree: int) -> int:
        """The number of a new node or leaf; a stack holds what is open, so depth is not bound by recursion."""
        todo, top = [(rows, -1, 0)], None
        while todo:
            own, parent, side = todo.pop()
            normal = None
            for _ in range(4 if len(own) > leaf_rows else 0):
                a, b = rng.choice(own, 2, replace=False)
                length = np.sqrt(((x[a] - x[b]) ** 2).sum())
                if length == 0:
                    continue
                line = (x[a] - x[b]) / length
                shares = x[own] @ line
                middle = float(np.median(shares))
                right = shares > middle
                if right.any() and not right.all():
                    normal = line
                    break
            if normal is None:
                number = -1 - len(tree_of_leaf)
                tree_of_leaf.append(tree)
            else:
                number = len(normals)
                normals.append(normal)
                offsets.append(middle)
                children.append([0, 0])
                todo += [(own[~right], number, 0), (own[right], number, 1)]
            if parent < 0:
                top = number
            else:
                children[parent][side] = number
        return top

    for t in range(trees):
        roots.append(grow(np.arange(len(x)), t))
    directions = rng.standard_normal((trees, most_cuts, x.shape[1]))
    directions /= np.sqrt((directions**2).sum(axis=2, keepdims=True))
    return Forest(
        roots, np.array(normals).reshape(-1, x.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(tree_of_leaf), directions, scale, longest,
    )


def fit_forest(items: DataFrame, vector: str, trees: int = 4, leaf_rows: int = 64, sample: int = 1 << 14, sample_leaf: int = 32, most_cuts: int = 24, seed: int = 7) -> Forest:
    """A forest for distinct usable vectors. Its upper levels are fitted on the ``sample`` vectors with the smallest hashes; counts and medians below them cover all rows.

    The forest is broadcast; its size depends on ``sample`` and ``trees`` only.
    """
    spark = items.sparkSession
    number = lambda x: x.cast("double")
    bounds = items.agg(F.max(F.size(vector)).alias("size"), F.max(F.array_max(F.transform(vector, lambda x: F.abs(number(x))))).alias("most")).first()
    scale = 1.0 / bounds.most if bounds.most and np.isfinite(1.0 / bounds.most) else 1.0
    squared = F.aggregate(vector, F.lit(0.0), lambda s, x: s + (number(x) * scale) * (number(x) * scale))
    longest = items.agg(F.max(squared)).first()[0] ** 0.5 if bounds.size else 1.0
    chosen = items.orderBy(F.xxhash64(vector), vector).limit(sample).select(vector).toArrow().column(0).combine_chunks()
    empty = Forest([], np.zeros((0, (bounds.size or 0) + 1)), np.zeros(0), np.zeros((0, 2)), np.zeros(0), np.zeros((0, 0, 0)), scale, longest)
    forest = _plant(empty.points(chosen), trees, sample_leaf, most_cuts, seed, scale, longest)

    def per_leaf(make, schema):
        shared = spark.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, 0):
                    yield from make(shared.value, shared.value.points(batch.column(0)))

        return items.select(vector).mapInArrow(run, schema)

    def leaves(f, x):
        found, many = np.unique(f.leaves(x), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many)], names=["leaf", "n"])

    counted = per_leaf(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # at most the forest's leaves
    forest.counts = np.zeros(len(forest.tree_of_leaf))
    for row in counted:
        forest.counts[row.leaf] = row.n
    wanted = np.ceil(np.log2(np.maximum(forest.counts / leaf_rows, 1))).astype(int).clip(0, most_cuts)
    forest.cuts = [np.zeros(0)] * len(wanted)
    if wanted.any():

        def projections(f, x):
            found = f.leaves(x)
            for t, directions in enumerate(f.directions):
                shares, many = x @ directions.T, wanted[found[:, t]]
                at = np.repeat(np.arange(len(x)), many)
                cut = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(found[at, t]), pa.array(cut), pa.array(shares[at, cut])], names=["leaf", "cut", "share"])

        medians = per_leaf(projections, "leaf long, cut long, share double").groupBy("leaf", "cut").agg(F.percentile_approx("share", 0.5, 1000).alias("median"))
        cuts = [np.zeros(n) for n in wanted]
        for row in medians.collect():  # at most most_cuts for each leaf
            cuts[row.leaf][row.cut] = row.median
        forest.cuts = cuts
    forest.bundle()
    return forest


def _with_cells(rows: DataFrame, vector: str, forest: Forest, search: float | None) -> DataFrame:
    """``rows``, once for each bundle of cells that holds the vector or, with ``search``, that a query probes; with the numbers of these cells."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    at = rows.columns.index(vector)
    schema = T.StructType([*rows.schema.fields, T.StructField("bundle", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for batch in pieces(whole, at, most=1 << 16):
                x = f.points(batch.column(at), query=search is not None)
                found = list(f.cells(x)) if search is None else [np.array(p, np.int64) for p in f.probes(x, search)]
                owner, cells = np.repeat(np.arange(len(found)), [len(c) for c in found]), np.concatenate(found)
                bundles = f.bundles(cells)
                order = np.lexsort((cells, bundles, owner))
                owner, cells, bundles = owner[order], cells[order], bundles[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (bundles[1:] != bundles[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cells)), pa.int32()), pa.array(cells))
                taken = batch.take(pa.array(owner[first]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bundles[first]), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def _top_of_bundles(queries: DataFrame, items: DataFrame, k: int, width: int, tile_rows: int) -> DataFrame:
    """query, ids, score: for each query the ``k`` best items of its cells in each bundle, none below the query's ``floor``.

    Bundles with many rows on either side are cut into tiles.
    """
    sides = [d.groupBy("bundle").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias(n)) for d, n in ((items, "i_tiles"), (queries, "q_tiles"))]
    tiles = materialize(sides[0].join(sides[1], "bundle").where("i_tiles > 1 or q_tiles > 1"))  # the planner knows its size

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(tiles, "bundle", "left").fillna(1, ["i_tiles", "q_tiles"])
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_tiles")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_tiles") - 1))).drop("i_tiles", "q_tiles")

    by = ["bundle", "i", "q"]
    schema = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("ids", items.schema["ids"].dataType), T.StructField("score", T.DoubleType())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        order = np.argsort(right.column("cells").chunk(0).flatten().to_numpy(), kind="stable")
        right = right.take(pa.array(order)).combine_chunks()
        vectors = [t.column("vector").chunk(0) for t in (left, right)]
        a, b = (padded(v, width) for v in vectors)
        ids, floor = right.column("id").to_numpy(), left.column("floor").to_numpy()
        cells, begins = np.unique(right.column("cells").chunk(0).flatten().to_numpy(), return_index=True)
        ends = np.append(begins[1:], len(b))
        probed = left.column("cells").chunk(0)
        asker, cell = np.repeat(np.arange(len(a)), probed.value_lengths().to_numpy(zero_copy_only=False)), probed.flatten().to_numpy()
        block = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        there = cells[block] == cell
        asker, block = asker[there], block[there]
        asker = asker[np.argsort(block, kind="stable")]
        bounds = np.searchsorted(np.sort(block), np.arange(len(cells) + 1))
        slack = 1e-12 * np.abs(a).sum(axis=1) * np.abs(b).max()  # products in blocks may differ in the last bits; what is close is summed again, alike everywhere
        found, held = [], 0

        def best(pairs):
            q, i, score = (np.concatenate(x) for x in zip(*pairs))
            order = np.lexsort((ids[i], -score, q))
            q, i, score = q[order], i[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            return q[place < k], i[place < k], score[place < k]

        for c in range(len(cells)):
            own, members = asker[bounds[c] : bounds[c + 1]], b[begins[c] : ends[c]]
            for begin in range(0, len(own), 1024):
                some = own[begin : begin + 1024]
                near = a[some] @ members.T
                least = np.maximum(floor[some], -np.partition(-near, k - 1, axis=1)[:, k - 1] if len(members) > k else -np.inf)
                q, i = np.nonzero(near >= (least - slack[some])[:, None])
                score = np.einsum("ij,ij->i", a[some[q]], members[i])
                found.append((some[q], i + begins[c], score))
                held += len(q)
                if held > 1 << 20:
                    found = [best(found)]
                    held = len(found[0][0])
        if not found:
            return kinds.empty_table()
        q, i, score = best(found)
        return pa.Table.from_arrays([left.column("id").take(pa.array(q)), right.column("ids").take(pa.array(i)), pa.array(score)], schema=kinds)

    return dealt(queries, "q", "i").groupBy(*by).cogroup(dealt(items, "i", "q").groupBy(*by)).applyInArrow(rank, schema)


def measured_search(items: DataFrame, queries: DataFrame, forest: Forest, k: int, recall: float, samples: int = 64, start: float = 512.0) -> tuple[float, float]:
    """(rows to look at, recall there): the shortest search that finds the wanted share of the true neighbours of ``samples`` queries.

    Their true neighbours come from a comparison with all items; so one pass with a fixed number of queries.
    """
    spark = items.sparkSession
    chosen = queries.orderBy(F.xxhash64("vector"), "vector").limit(samples).select("vector")
    asking = items.join(F.broadcast(chosen), "vector").select("id", "vector").toArrow().combine_chunks()  # at most ``samples`` rows
    if not asking.num_rows:
        return start, 1.0
    width = forest.normals.shape[1] - 1
    own, points = asking.column("id").to_numpy(), padded(asking.column("vector").chunk(0), width)
    shared = spark.sparkContext.broadcast((forest, own, points))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, own, points = shared.value
        kept = np.full((len(own), 0), 0.0), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0, len(f.roots)), np.int64)
        for whole in batches:
            for batch in pieces(whole, 1, most=1 << 18):
                score = points @ padded(batch.column(1), points.shape[1]).T
                ids = batch.column(0).to_numpy()
                score[own[:, None] == ids[None, :]] = -np.inf
                cells = f.cells(f.points(batch.column(1)))
                many = [np.broadcast_to(x, (len(own), *x.shape)) for x in (ids, cells)]
                both = [np.concatenate(x, axis=1) for x in zip(kept, (score, *many))]
                top = np.argsort(-both[0], axis=1, kind="stable")[:, :k]
                kept = both[0][np.arange(len(own))[:, None], top], both[1][np.arange(len(own))[:, None], top], both[2][np.arange(len(own))[:, None], top]
        q = np.repeat(np.arange(len(own)), kept[0].shape[1])
        yield pa.RecordBatch.from_arrays([
            pa.array(q), pa.array(kept[1].ravel()), pa.array(kept[0].ravel()), pa.array(list(kept[2].reshape(len(q), -1)), pa.list_(pa.int64())),
        ], names=["q", "id", "score", "cells"])

    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = items.select("id", "vector").mapInArrow(compare, "q long, id long, score double, cells array<long>").where(F.col("score") > float("-inf"))
    true = true.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).select("q", "cells").collect()  # k for each sample
    x, search = forest.points(asking.column("vector").chunk(0), query=True), start
    whole = float(forest.counts.sum())
    while True:
        probed = [set(p) for p in forest.probes(x, search)]
        share = sum(not probed[r.q].isdisjoint(r.cells) for r in true) / max(len(true), 1)
        if share >= recall or search > whole or not true:
            return search, share
        search *= 1.25


def nearest_vectors(
    df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.95, trees: int = 4, leaf_rows: int = 64, sample: int = 1 << 14,
) -> DataFrame:
    """query_id, rank, <key>, score: for each query row the ``k`` rows with the largest inner product, ties by smaller key.

    ``is_query`` is a condition on the rows of ``df`` that ask; candidates are all rows with another key. Rows whose key or vector is null, whose vector is zero or empty or
    holds null or non-finite components take no part. Shorter vectors count as filled up with zeros. Repeated rows count once; a key with several vectors is
    a candidate, and if it asks a query, with each (two with one score count once). The search is approximate: how many rows a query looks at is measured, so that 64 sampled queries
    find the share ``recall`` of their true neighbours. Scores are exact, and a query gets all candidates if they are no more than ``k``: queries with
    too few look further.
    """
    own = usable_vectors(df, vector)
    own = own.where(own[key].isNotNull() & F.exists(own[vector], lambda x: x != 0))
    rows = materialize(own.select(own[key].cast("long").alias("id"), own[vector].alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct())
    # A query's own rows are found, too, so it needs as many answers more.
    own_rows = rows.where("asks").groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    slots = k + own_rows
    # Equal vectors are one item with the smallest keys that can be among the answers.
    first = Window.partitionBy("vector").orderBy("id")
    items = rows.select("id", "vector").withColumn("n", F.row_number().over(first)).where(F.col("n") <= slots)
    items = materialize(items.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vector", "ids"))
    asking = rows.where("asks").select("id", "vector")
    name = F.struct(F.col("first"), F.xxhash64("vector").alias("mark"))  # a key may ask with several vectors
    queries = asking.groupBy("vector").agg(F.min("id").alias("first")).select(name.alias("id"), "vector", F.lit(float("-inf")).alias("floor"))
    queries = materialize(queries)
    forest = fit_forest(items, "vector", trees, leaf_rows, sample)
    indexed = materialize(_with_cells(items, "vector", forest, None))
    search, _ = measured_search(items, queries, forest, k, recall)

    def answers(asked: DataFrame, rows: float) -> DataFrame:
        """query, found: up to ``slots`` of (far, id), nearest first."""
        found = _top_of_bundles(materialize(_with_cells(asked, "vector", forest, rows)), indexed, slots, forest.normals.shape[1] - 1, forest.bundle_rows)
        found = found.select("query", F.explode("ids").alias("id"), "score").distinct()  # an item found in several trees has one score
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= slots)
        return materialize(found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("found")))

    asked, part = queries, search / 16
    if part >= 256:  # a short search first: its last answers are floors for what the long one gives back
        floors = answers(asked, part).where(F.size("found") >= slots).select(F.col("query").alias("id"), (-F.col("found")[slots - 1]["far"]).alias("least"))
        asked = materialize(asked.join(floors, "id", "left").select("id", "vector", F.coalesce("least", "floor").alias("floor")))
    out, whole = answers(asked, search), float(forest.counts.sum()) if forest.roots else 0.0
    while search <= whole:
        asked = materialize(asked.join(out.where(F.size("found") >= slots), F.col("id") == F.col("query"), "left_anti"))
        if asked.isEmpty():
            break
        search *= 16
        more = answers(asked, search)
        out = out.join(more, "query", "left_anti").unionByName(more)
    members = asking.join(queries.select(F.col("id").alias("query"), "vector"), "vector").select(F.col("id").alias("query_id"), "query")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    named = members.join(out, "query").select("query_id", F.posexplode(others).alias("at", "f"))
    return named.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias(key), (-F.col("f.far")).alias("score"))
