"""Levels over a road graph, for requests through very many cells.

A level has the nodes at the borders of the cells of the level below; its arcs are those that cross cells and the cheapest ways through each cell. Its nodes are put into larger cells, and so on
while that leaves fewer nodes. A request climbs from both ends level by level, in each one within the cell of the end only, and is searched round by round in the top level. So the number of rounds
follows the levels, which grow with the logarithm of the graph, and a task holds one cell of one level. The path found is opened again level by level, each way by a search in its cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.tables import materialize

_INSIDE, _OUT, _IN = 0, 1, 2
FORTH, BACK, MET = 0, 1, 2
_FEWER = 0.8  # a further level must have so much fewer nodes
_HOP = "struct<u:bigint,v:bigint,depth:int,inner:string,edge:bigint,weight:double>"
PATH = f"array<{_HOP}>"
MOST = 1000  # nodes of a cell above the lowest level, where arcs are many


@dataclass
class Level:
    """spots: node_id, lng, lat, cell. arcs: cell, u, v, to_cell, edge_id, weight, depth, inner, arc; a way through cell ``inner`` of the level below has that level's number plus one as
    ``depth``, a road has depth 0. around: the arcs of each cell ``at``, by ``side``: inside, out of it, into it."""

    spots: DataFrame
    arcs: DataFrame
    around: DataFrame


def _level(spots: DataFrame, arcs: DataFrame) -> Level:
    at = {"cell": F.when(F.col("cell") == F.col("to_cell"), _INSIDE).otherwise(_OUT), "to_cell": F.lit(_IN)}
    rows = [arcs.where(F.lit(c == "cell") | (F.col("cell") != F.col("to_cell"))).select(F.col(c).alias("at"), "u", "v", side.alias("side"), "weight", "edge_id", "depth", "inner") for c, side in at.items()]
    return Level(spots, arcs, materialize(rows[0].unionByName(rows[1])))


def build_levels(nodes: DataFrame, cells: DataFrame, plain: DataFrame, most: int, assign: Callable[[DataFrame, int], DataFrame]) -> list[Level]:
    """The given graph as the lowest level (``plain`` has cell, u, v, to_cell, edge_id, weight) and those above it; ``assign`` puts nodes into squares of one extent."""
    spots = materialize(nodes.join(cells, "node_id").select("node_id", "lng", "lat", "cell"))
    arcs = plain.select("cell", "u", "v", "to_cell", "edge_id", "weight", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("inner"))
    levels = [_level(spots, materialize(arcs.withColumn("arc", F.monotonically_increasing_id())))]
    while levels[-1].spots.select("cell").distinct().count() > 1:
        low = levels[-1]
        crossing = low.arcs.where("cell <> to_cell")
        border = crossing.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
        border = materialize(low.spots.join(border, "node_id", "left_semi").select("node_id", "lng", "lat"))
        if not 0 < border.count() < _FEWER * low.spots.count():
            break
        through = low.around.groupBy("at").applyInArrow(_ways_through, "inner string, u long, v long, weight double")
        through = through.select("u", "v", F.lit(None).cast("long").alias("edge_id"), "weight", F.lit(len(levels)).alias("depth"), "inner")
        arcs = materialize(crossing.select("u", "v", "edge_id", "weight", "depth", "inner").unionByName(through))
        spots = materialize(border.join(assign(border, min(most, MOST)), "node_id"))
        at = [spots.select(F.col("node_id").alias(c), F.col("cell").alias(n)) for c, n in (("u", "cell"), ("v", "to_cell"))]
        levels.append(_level(spots, materialize(arcs.join(at[0], "u").join(at[1], "v").withColumn("arc", F.monotonically_increasing_id()))))
    return levels


class _Cell:
    """The arcs of one cell."""

    def __init__(self, around: pa.Table):
        self.forth: dict[int, list[tuple]] = {}
        self.back: dict[int, list[tuple]] = {}
        self.exits: set[int] = set()
        self.entries: set[int] = set()
        self.rows = list(zip(*(around.column(c).to_pylist() for c in ("u", "v", "side", "weight", "edge_id", "depth", "inner"))))
        for i, (u, v, side, weight, *_) in enumerate(self.rows):
            if side == _INSIDE:
                self.forth.setdefault(u, []).append((v, weight, i))
                self.back.setdefault(v, []).append((u, weight, i))
            elif side == _OUT:
                self.exits.add(u)
            else:
                self.entries.add(v)


def _spread(out: dict, begin: list[tuple[float, int]], most: float = float("inf"), goals: set | None = None) -> dict[int, tuple]:
    """node -> (cost, arcs passed, node before, arc) of all nodes under ``most`` in the order of their costs, fewest arcs first; ends when all ``goals`` are reached."""
    done: dict[int, tuple] = {}
    left = set(goals) if goals is not None else None
    heap = [(cost, 0, node, -1, -1) for cost, node in begin if cost < most]
    heapq.heapify(heap)
    while heap:
        cost, hops, node, before, arc = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = (cost, hops, before, arc)
        if left is not None:
            left.discard(node)
            if not left:
                break
        for v, weight, a in out.get(node, ()):
            if v not in done and cost + weight < most:
                heapq.heappush(heap, (cost + weight, hops + 1, v, node, a))
    return done


def _ways_through(around: pa.Table) -> pa.Table:
    """The cheapest ways from the cell's entries to its exits, without those that pass a node where one of them ends and another begins."""
    cell, out = _Cell(around), []
    both = cell.exits & cell.entries
    for u in sorted(cell.entries):
        passed: dict[int, bool] = {}
        for v, (cost, hops, before, _) in _spread(cell.forth, [(0.0, u)], goals=cell.exits).items():
            passed[v] = hops > 1 and (passed[before] or before in both)
            if hops and v in cell.exits and not passed[v]:
                out.append((u, v, cost))
    columns = list(zip(*out)) or [(), (), ()]
    name = around.column("at")[0].as_py()
    return pa.table({"inner": pa.array([name] * len(out), pa.string()), "u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64()), "weight": pa.array(columns[2], pa.float64())})


def _parted(rows: DataFrame, around: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part number: a cell with very many requests has several parts, each with the cell's arcs."""
    parts = rows.groupBy("cell").agg(F.ceil(F.countDistinct("query_id") / most).cast("int").alias("parts"))
    arcs = around.join(parts.withColumnRenamed("cell", "at"), "at").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts"), arcs


def _from_kinds(query: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("query_id", query), *T.StructType.fromDDL(fields).fields])


def climb(level: Level, links: DataFrame, best: DataFrame, most: int = 2000) -> DataFrame:
    """(query_id, side, cell, node, root, cost): where requests leave or enter the cells of their links (query_id, side, node, cost), and where both sides meet in one cell.

    ``root`` is the link's node; where sides meet ``root`` is the start's and ``node`` the end's. Nothing costs as much as the request's ``best``.
    """
    kinds = _from_kinds(links.schema["query_id"].dataType, "side int, cell string, node long, root long, cost double")
    rows = links.join(level.spots.select(F.col("node_id").alias("node"), "cell"), "node")
    rows, around = _parted(rows, level.around, most)
    asked = rows.groupBy("query_id", "cell", "part").agg(F.collect_list(F.struct("side", "cost", "node")).alias("links")).join(best, "query_id", "left")

    def run(requests: pa.Table, around: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        if not requests.num_rows:
            return schema.empty_table()
        cell, name, out = _Cell(around), requests.column("cell")[0].as_py(), []
        for at, (ends, bound) in enumerate(zip(requests.column("links").to_pylist(), requests.column("best").to_pylist())):
            bound = float("inf") if bound is None else bound
            begin = [sorted((e["cost"], e["node"]) for e in ends if e["side"] == side) for side in (FORTH, BACK)]
            for side, arcs, border in ((FORTH, cell.forth, cell.exits), (BACK, cell.back, cell.entries)):
                done, root = _spread(arcs, begin[side], bound), {}
                for node, (_, _, before, arc) in done.items():
                    root[node] = node if arc < 0 else root[before]
                if side == FORTH:
                    met = min(((done[node][0] + cost, node) for cost, node in begin[BACK] if node in done), default=None)
                    if met and met[0] < bound:
                        bound = met[0]
                        out.append((at, MET, name, met[1], root[met[1]], met[0]))
                out += [(at, side, name, node, root[node], row[0]) for node, row in done.items() if node in border and row[0] < bound]
        if not out:
            return schema.empty_table()
        columns = list(zip(*out))
        return pa.Table.from_arrays([requests.column("query_id").take(pa.array(columns[0])), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns[1:]))], schema=schema)

    return materialize(asked.groupBy("cell", "part").cogroup(around.groupBy("at", "part")).applyInArrow(run, kinds))


def hop(u: str, v: str, depth: int, inner: str):
    """The way through a cell as a path of one hop; of none from a node to itself."""
    none = F.array().cast(PATH)
    one = F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(depth).alias("depth"), F.col(inner).alias("inner"), F.lit(None).alias("edge"), F.lit(None).alias("weight")).cast(_HOP)
    return F.when(F.col(u) == F.col(v), none).otherwise(F.array(one))


def fill(level: Level, entered: DataFrame) -> DataFrame:
    """(query_id, node, cost) of all nodes of the cells that the rows (query_id, back, node, cost) lie in, by the arcs within the cell; ``back`` searches against them."""
    kinds = _from_kinds(entered.schema["query_id"].dataType, "back boolean, node long, cost double")
    rows = entered.join(level.spots.select(F.col("node_id").alias("node"), "cell"), "node")

    def run(requests: pa.Table, around: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, cell, begin, out = to_arrow_schema(kinds), _Cell(around), {}, []
        for query, back, cost, node in zip(*(requests.column(c).to_pylist() for c in ("query_id", "back", "cost", "node"))):
            begin.setdefault((query, back), []).append((cost, node))
        for (query, back), links in begin.items():
            out += [(query, back, node, row[0]) for node, row in _spread(cell.back if back else cell.forth, links).items()]
        columns = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return materialize(rows.groupBy("cell").cogroup(level.around.groupBy("at")).applyInArrow(run, kinds))


def open_paths(levels: list[Level], paths: DataFrame) -> DataFrame:
    """(query_id, place, hop): the roads of the paths (query_id, path) in the order of ``place``."""
    hops = paths.select("query_id", F.posexplode("path").alias("i", "hop")).select("query_id", F.array("i").alias("place"), "hop")

    def run(asked: pa.Table, around: pa.Table) -> pa.Table:
        cell, out = _Cell(around), []
        wanted: dict[int, list[int]] = {}
        for u, v in zip(asked.column("u").to_pylist(), asked.column("v").to_pylist()):
            wanted.setdefault(u, []).append(v)
        for u, goals in wanted.items():
            done = _spread(cell.forth, [(0.0, u)], goals=set(goals))
            for goal in goals:
                steps, node = [], goal
                while node != u:
                    steps.append(done[node][3])
                    node = done[node][2]
                for i, arc in enumerate(reversed(steps)):
                    a, b, _, weight, edge, depth, inner = cell.rows[arc]
                    out.append((u, goal, i, {"u": a, "v": b, "depth": depth, "inner": inner, "edge": edge, "weight": weight}))
        columns = list(zip(*out)) or [()] * 4
        name = asked.column("inner")[0].as_py() if asked.num_rows else None
        step = pa.struct([("u", pa.int64()), ("v", pa.int64()), ("depth", pa.int32()), ("inner", pa.string()), ("edge", pa.int64()), ("weight", pa.float64())])
        return pa.table({"inner": pa.array([name] * len(out), pa.string()), "u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64()), "j": pa.array(columns[2], pa.int32()), "step": pa.array(columns[3], step)})

    for depth in range(len(levels) - 1, 0, -1):
        hops = materialize(hops)
        closed = hops.where(F.col("hop.depth") == depth)
        asked = closed.select("hop.inner", "hop.u", "hop.v").distinct()
        ways = asked.groupBy("inner").cogroup(levels[depth - 1].around.groupBy("at")).applyInArrow(run, f"inner string, u long, v long, j int, step {_HOP}")
        opened = closed.select("query_id", "place", "hop.inner", "hop.u", "hop.v").join(materialize(ways), ["inner", "u", "v"])
        hops = hops.where(F.col("hop.depth") != depth).unionByName(opened.select("query_id", F.concat("place", F.array("j")).alias("place"), F.col("step").alias("hop")))
    return hops
