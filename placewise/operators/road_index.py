"""An index over a road graph, and cheapest paths of many requests with it.

The graph is cut into cells of bounded size. A request is searched cell by cell: a task holds one cell's arcs and settles all requests that have entered it, what leaves the cell
enters the next one in the next round. So the number of rounds follows the cells on the way, not its edges. The index also has component labels, which settle unreachable
requests before the first round, and distances to and from landmarks, whose triangle inequalities give every request a bound before it starts and keep its search near
its path. An index with landmarks has levels over its cells, too (``road_levels``), in which a request through very many cells takes as many rounds as there are levels.
"""

from __future__ import annotations

import heapq
import logging
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.operators.road_levels import BACK, FORTH, MET, PATH, Level, build_levels, climb, fill, hop, open_paths
from placewise.tables import by_shuffle, materialize

LOG = logging.getLogger(__name__)
START_NODE = -1
_STATE, _CROSSING, _ARRIVAL = 0, 1, 2
_LEVELS = 20
_FIRST_ARCS = 12  # of mean length: how far the first round goes
_SLACK = 1e-9  # sums along a path and landmark distances may differ in the last bits
_ENTRY = "struct<cost:double,free:int,pred:bigint,edge:bigint,node:bigint>"


@dataclass
class RoadIndex:
    """cells: node_id, cell. arcs: cell, u, v, to_cell, edge_id, weight, v_to, v_from. labels: node_id, label. marks: node_id, to, from (distances to and from each landmark, infinite
    where there is no path; without landmarks empty arrays). levels: the graph and the levels over it; none without landmarks."""

    cells: DataFrame
    arcs: DataFrame
    labels: DataFrame
    marks: DataFrame
    levels: list[Level] = field(default_factory=list)


def assign_cells(nodes: DataFrame, most: int, extent: DataFrame | None = None) -> DataFrame:
    """node_id, cell: squares of the extent of the nodes or of those in ``extent``, cut in four until none holds more than ``most`` nodes; nodes in one smallest square are dealt by id."""
    x, y = F.coalesce("lng", F.lit(0.0)), F.coalesce("lat", F.lit(0.0))
    spots = nodes.select("node_id", x.alias("x"), y.alias("y"))
    box = (spots if extent is None else extent.select(x.alias("x"), y.alias("y"))).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"), F.count("*").alias("n")).first()
    if not box.n:
        return nodes.select("node_id", F.lit("").alias("cell"))
    # Squares of the levels that even very uneven nodes need; what is still full at the last one is dealt out.
    levels = min(max((-(-box.n // most)).bit_length() + 4, 1), _LEVELS) if box.n > most else 0
    size = F.lit(box.span or 1.0) / F.pow(F.lit(2.0), F.col("level"))
    at = [F.floor((F.col(c) - F.lit(getattr(box, c))) / size).cast("long").alias(f"c{c}") for c in ("x", "y")]
    listed = spots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select("node_id", "level", *at)
    squares = ["level", "cx", "cy"]
    counted = listed.groupBy(*squares).agg(F.count("*").alias("n"))
    full = materialize(counted.where(F.col("n") > most))
    free = listed.join(full, squares, "left").where((F.col("n").isNull()) | (F.col("level") == levels))
    bucket = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("node_id"), F.ceil(F.col("n") / most).cast("long")))
    return free.groupBy("node_id").agg(F.min(F.struct("level", "cx", "cy", bucket.alias("bucket"))).alias("c")).select("node_id", F.concat_ws("/", "c.level", "c.cx", "c.cy", "c.bucket").alias("cell"))


def component_labels(arcs: DataFrame) -> DataFrame:
    """node_id, label: nodes joined by arcs of any direction share a label, their smallest node's.

    Each cell is settled in its task; then only what crosses cells is joined round by round.
    """
    inside = arcs.where("cell = to_cell").select("cell", "u", "v").unionByName(
        arcs.select("cell", "u", F.col("u").alias("v"))).unionByName(arcs.select(F.col("to_cell").alias("cell"), F.col("v").alias("u"), "v")).distinct()

    def settle(table: pa.Table) -> pa.Table:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        return pa.table({"node_id": pa.array(nodes, pa.int64()), "part": pa.array([root(n) for n in nodes], pa.int64())})

    parts = materialize(inside.groupBy("cell").applyInArrow(settle, "node_id long, part long"))
    ends = [parts.select(F.col("node_id").alias(c), F.col("part").alias(n)) for c, n in (("u", "a"), ("v", "b"))]
    links = arcs.where("cell <> to_cell").select("u", "v").join(by_shuffle(ends[0]), "u").join(by_shuffle(ends[1]), "v").where("a <> b").select("a", "b")
    links = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = links.groupBy(F.col("a").alias("part")).agg(F.min("b").alias("label")).select("part", F.least("part", "label").alias("label"))
    while True:
        labels = materialize(labels)
        near = links.join(by_shuffle(labels.select(F.col("part").alias("b"), "label")), "b").groupBy(F.col("a").alias("part")).agg(F.min("label").alias("near"))
        lower = labels.join(by_shuffle(near), "part").select("part", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("part").alias("step"), F.col("label").alias("beyond"))  # where the neighbour's label points to
        moved = lower.join(by_shuffle(jump), "step").select("part", F.least("step", "beyond").alias("label"), (F.least("step", "beyond") < F.col("label")).alias("moved"))
        if moved.where("moved").isEmpty():
            return parts.join(by_shuffle(labels), "part", "left").select("node_id", F.coalesce("label", "part").alias("label"))
        labels = moved.select("part", "label")


def _by_cell(rows: DataFrame, arcs: DataFrame, most: int):
    """Both sides with a part number: a cell that very many requests have entered has several parts, each with the cell's arcs.

    Only the cells' numbers are broadcast: squares with more than ``cell_nodes`` nodes are few, and a cell is a part of one.
    """
    parts = rows.groupBy("cell").agg(F.ceil(F.countDistinct("query_id") / most).cast("int").alias("parts"))
    cells = arcs.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    return dealt, cells


class _Cell:
    """One cell's arcs, and the search of one request within it."""

    def __init__(self, arcs: pa.Table):
        self.out: dict[int, list[tuple]] = {}
        self.marks: dict[int, tuple[list[float], list[float]]] = {}
        same = pc.equal(arcs.column("cell"), arcs.column("to_cell"))
        further = pc.if_else(same, pa.scalar(None, pa.string()), arcs.column("to_cell")).to_pylist()  # null for an arc that stays
        u, v, edge, weight = (arcs.column(c).to_pylist() for c in ("u", "v", "edge_id", "weight"))
        for node, *arc in zip(u, v, further, edge, weight):
            self.out.setdefault(node, []).append(arc)
        if pc.any(pc.greater(pc.list_value_length(arcs.column("v_to")), 0)).as_py():
            self.marks = dict(zip(v, zip(arcs.column("v_to").to_pylist(), arcs.column("v_from").to_pylist())))

    def least_rest(self, node: int, goals: list[dict]) -> float:
        """A lower bound for what is left from ``node`` to the cheapest goal, by the landmarks."""
        if not goals or node not in self.marks:
            return 0.0
        to, back = self.marks[node]
        least = float("inf")
        for g in goals:
            bound = 0.0
            for a, b, c, d in zip(to, g["to"], g["from"], back):
                bound = max(bound, a - b, c - d)  # infinity less infinity is no number and never the larger
            least = min(least, bound + g["last"])
        return least * (1 - _SLACK)

    def search(self, name: str, entries: list[dict], ends: list[dict], goals: list[dict], most: float, limit: float, everything: bool):
        """(settled rows, crossings, arrivals) of one request; nothing that costs ``most`` or more.

        What costs more than ``limit`` is left for the next round, as a crossing into this cell ``name`` itself.
        """
        best: dict[int, tuple] = {}
        rest: dict[int, float] = {}
        arrives: dict[int, list[dict]] = {}
        for e in ends or []:
            arrives.setdefault(e["node"], []).append(e)
        heap: list[tuple] = []
        crossings: dict[int, tuple] = {}
        arrivals: list[tuple] = []

        def reach(node: int, row: tuple) -> None:
            if node not in best or row < best[node]:
                if node not in rest:
                    rest[node] = self.least_rest(node, goals)
                if row[0] + rest[node] < most:
                    best[node] = row
                    heapq.heappush(heap, (row[0] + rest[node], row, node))

        for e in sorted(entries, key=lambda e: (e["cost"], e["node"])):
            reach(e["node"], (e["cost"], e["free"], e["pred"], e["edge"]))
        while heap:
            _, row, node = heapq.heappop(heap)
            if row != best[node] or row[0] + rest[node] >= most:
                continue
            cost, free = row[:2]
            if cost > limit:
                crossings[node] = (row, name)
                continue
            for e in arrives.get(node, ()):
                arrivals.append((cost + e["last"], node, e["edge"]))
                most = min(most, cost + e["last"])
            for v, cell, edge, weight in self.out.get(node, ()):
                further = (cost + weight, 0 if weight > 0 else free + 1, node, edge)
                if further[0] >= most:
                    continue
                if cell is None:
                    reach(v, further)
                elif v not in crossings or further < crossings[v][0]:
                    crossings[v] = (further, cell)
        left = {v: x for v, x in crossings.items() if x[0][0] + self.least_rest(v, goals) < most}
        if everything:
            return best, left, arrivals
        chain: dict[int, tuple] = {}
        for node in [*(v if x[1] == name else x[0][2] for v, x in left.items()), *(a[1] for a in arrivals)]:
            while node in best and node not in chain:
                chain[node] = best[node]
                node = best[node][2]
        return chain, left, arrivals


_AIMS = "array<struct<cell:string,node:bigint,last:double,edge:bigint,to:array<double>,from:array<double>>>"


def _rounds(arcs: DataFrame, entered: DataFrame, aims: DataFrame, limit: float = float("inf"), everything: bool = False, most_requests: int = 2000) -> DataFrame:
    """The results of all rounds: query_id, kind, cell, node, cost, free, pred, edge. ``aims`` has each request's ends and bound; a round is two written tables.

    The first round goes as far as ``limit``, each further one twice as far as the one before, so a request does not search a whole cell for a goal that is near in another.
    """
    query = entered.schema["query_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", query), T.StructField("kind", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("node", T.LongType()),
        T.StructField("cost", T.DoubleType()), T.StructField("free", T.IntegerType()), T.StructField("pred", T.LongType()), T.StructField("edge", T.LongType()),
    ])

    def settle(far: float, requests: pa.Table, cell_arcs: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        if not requests.num_rows:
            return kinds.empty_table()
        cell, out, name = _Cell(cell_arcs), [], requests.column("cell")[0].as_py()
        for at, (entries, aim, most) in enumerate(zip(*(requests.column(c).to_pylist() for c in ("entries", "aims", "bound")))):
            aim = aim or []
            chain, crossings, arrivals = cell.search(name, entries, [a for a in aim if a["cell"] == name], aim if aim and aim[0]["to"] else [], float("inf") if most is None else most, far, everything)
            out += [(at, _STATE, None, node, *row) for node, row in chain.items()]
            out += [(at, _CROSSING, to, node, *row) for node, (row, to) in crossings.items()]
            out += [(at, _ARRIVAL, None, node, cost, 0, None, edge) for cost, node, edge in arrivals]
        if not out:
            return kinds.empty_table()
        columns = list(zip(*out))
        return pa.Table.from_arrays([requests.column("query_id").take(pa.array(columns[0])), *(pa.array(c, kinds.field(i + 1).type) for i, c in enumerate(columns[1:]))], schema=kinds)

    written, known, number = None, entered, 0
    while True:
        dealt, cells = _by_cell(entered, arcs, most_requests)
        asked = dealt.groupBy("query_id", "cell", "part").agg(F.collect_list(F.struct("cost", "free", "pred", "edge", "node").cast(_ENTRY)).alias("entries"))
        asked = asked.join(by_shuffle(aims), "query_id", "left")
        if written is not None:
            arrived = written.where(F.col("kind") == _ARRIVAL).groupBy("query_id").agg(F.min("cost").alias("best"))
            asked = asked.join(by_shuffle(arrived), "query_id", "left").withColumn("bound", F.least("bound", "best")).drop("best")
        reach = limit * 2**number
        out = materialize(asked.groupBy("cell", "part").cogroup(cells.groupBy("cell", "part")).applyInArrow(partial(settle, reach), schema))
        written, number = out if written is None else written.unionByName(out), number + 1
        crossings = out.where(F.col("kind") == _CROSSING).groupBy("query_id", "node", "cell").agg(F.min(F.struct("cost", "free", "pred", "edge")).alias("b")).select("query_id", "node", "cell", "b.*")
        arrived = written.where(F.col("kind") == _ARRIVAL).groupBy("query_id").agg(F.min("cost").alias("best"))
        before = known.groupBy("query_id", "node").agg(F.min(F.struct("cost", "free", "pred", "edge")).alias("old"))
        fresh = crossings.join(by_shuffle(before), ["query_id", "node"], "left").join(by_shuffle(arrived), "query_id", "left").where(
            (F.col("old").isNull() | (F.struct("cost", "free", "pred", "edge") < F.col("old"))) & (F.col("best").isNull() | (F.col("cost") < F.col("best")))
        )
        entered = materialize(fresh.select("query_id", "cell", "node", "cost", "free", "pred", "edge"))
        count = entered.count()
        LOG.info("round %d: %d entries into further cells", number, count)
        if not count:
            return written
        known = known.unionByName(entered)


def build_road_index(adjacency: DataFrame, nodes: DataFrame, cell_nodes: int = 1 << 14, landmarks: int = 4) -> RoadIndex:
    """The index of a graph (adjacency u, v, edge_id, weight of ``build_road_graph`` and its nodes node_id, lng, lat).

    A task holds one cell with its arcs, so ``cell_nodes`` bounds its memory. Landmarks are the outermost nodes in four directions, up to ``landmarks`` of them.
    """
    nodes = materialize(nodes)
    cells = materialize(assign_cells(nodes, cell_nodes))
    at = [cells.select(F.col("node_id").alias(c), F.col("cell").alias(n)) for c, n in (("u", "cell"), ("v", "to_cell"))]
    plain = materialize(adjacency.join(by_shuffle(at[0]), "u").join(by_shuffle(at[1]), "v").select("cell", "u", "v", "to_cell", "edge_id", "weight"))
    labels = materialize(component_labels(plain))
    levels = build_levels(nodes, cells, plain, cell_nodes, lambda border, most: assign_cells(border, most, nodes)) if landmarks else []
    marks = _landmark_distances(plain, cells, nodes, landmarks, levels)
    by_node = marks.select(F.col("node_id").alias("v"), F.col("to").alias("v_to"), F.col("from").alias("v_from"))
    return RoadIndex(cells, materialize(plain.join(by_shuffle(by_node), "v", "left")), labels, marks, levels)


def _landmark_distances(arcs: DataFrame, cells: DataFrame, nodes: DataFrame, landmarks: int, levels: list[Level]) -> DataFrame:
    spread = {f"m{i}": key for i, key in enumerate((F.col("lng") + F.col("lat"), -F.col("lng") - F.col("lat"), F.col("lng") - F.col("lat"), F.col("lat") - F.col("lng")))}
    linked = nodes.join(arcs.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_semi").where("lng is not null and lat is not null")
    found = linked.agg(*[F.max(F.struct(key, -F.col("node_id"))).alias(name) for name, key in spread.items()]).first() if landmarks else []
    chosen = list(dict.fromkeys(-row[1] for row in found if row is not None))[:landmarks]
    if not chosen:
        return cells.select("node_id", F.array().cast("array<double>").alias("to"), F.array().cast("array<double>").alias("from"))
    spark = arcs.sparkSession
    rows = [(2 * i + back, bool(back), node, 0.0) for i, node in enumerate(chosen) for back in (0, 1)]
    entered, climbed = spark.createDataFrame(rows, "query_id int, back boolean, node long, cost double"), []
    for level, above in zip(levels, levels[1:]):  # up to the borders of larger and larger cells around the landmark
        climbed.append(entered)
        entered = fill(level, entered).join(above.spots.select(F.col("node_id").alias("node")), "node", "left_semi")
    reached = _top_distances(levels[-1], entered)
    for level, inside in zip(levels[-2::-1], climbed[::-1]):
        reached = fill(level, reached.unionByName(inside))
    reached = reached.groupBy(F.col("node").alias("node_id"))
    sides = [F.array(*[F.coalesce(F.min(F.when(F.col("query_id") == 2 * i + back, F.col("cost"))), F.lit(float("inf"))) for i in range(len(chosen))]) for back in (1, 0)]
    far = F.array_repeat(F.lit(float("inf")), len(chosen))
    marks = reached.agg(sides[0].alias("to"), sides[1].alias("from"))
    return materialize(cells.select("node_id").join(marks, "node_id", "left").select("node_id", F.coalesce("to", far).alias("to"), F.coalesce("from", far).alias("from")))


def _top_distances(level: Level, entered: DataFrame) -> DataFrame:
    """query_id, back, node, cost of all nodes of a level, from the rows (query_id, back, node, cost), cell by cell."""
    none = F.array().cast("array<double>")
    mark = lambda back, cell: F.concat(F.when(back, "<").otherwise(">"), cell)
    forth, back = F.lit(False), F.lit(True)
    both = level.arcs.select(mark(forth, "cell").alias("cell"), "u", "v", mark(forth, "to_cell").alias("to_cell"), F.col("arc").alias("edge_id"), "weight").unionByName(
        level.arcs.select(mark(back, "to_cell").alias("cell"), F.col("v").alias("u"), F.col("u").alias("v"), mark(back, "cell").alias("to_cell"), F.col("arc").alias("edge_id"), "weight")
    ).withColumns({"v_to": none, "v_from": none})
    placed = entered.join(level.spots.select(F.col("node_id").alias("node"), "cell"), "node").withColumn("cell", mark(F.col("back"), "cell"))
    begin = materialize(placed.select("query_id", "cell", "node", "cost", F.lit(0).alias("free"), F.lit(START_NODE).cast("long").alias("pred"), F.lit(0).cast("long").alias("edge")))
    settled = _rounds(both, begin, entered.sparkSession.createDataFrame([], f"query_id int, aims {_AIMS}, bound double"), everything=True, most_requests=1)
    settled = settled.where(F.col("kind") == _STATE).select("query_id", "node", "cost").unionByName(begin.select("query_id", "node", "cost"))
    return settled.groupBy("query_id", "node").agg(F.min("cost").alias("cost")).select("query_id", (F.col("query_id") % 2 == 1).alias("back"), "node", "cost")


def indexed_paths(starts: DataFrame, ends: DataFrame, index: RoadIndex) -> tuple[DataFrame, DataFrame]:
    """Cheapest paths of all requests: (found: query_id, node, edge_id, cost; state: query_id, node, cost, free, pred, pred_edge).

    ``starts`` and ``ends`` are link tables (query_id, node, cost, edge_id). Requests whose ends lie in other components than their starts are settled before the first
    round. ``state`` has the nodes of the paths that leave a cell or arrive. Equal costs: fewest free arcs since the last one with a length, then the smallest (pred, edge)
    of those found; null nodes reach nothing.
    """
    if index.levels:
        return _paths_by_levels(starts, ends, index)
    placed = index.cells.join(by_shuffle(index.marks), "node_id").join(by_shuffle(index.labels), "node_id").withColumnRenamed("node_id", "node")
    entry = F.struct("cost", F.lit(0).alias("free"), F.lit(START_NODE).cast("long").alias("pred"), F.col("edge_id").cast("long").alias("edge"))
    first = materialize(starts.groupBy("query_id", "node").agg(F.min(entry).alias("b")).join(by_shuffle(placed), "node").select("query_id", "cell", "node", "b.*", "to", "label"))
    last = materialize(ends.join(by_shuffle(placed), "node").select("query_id", "cell", "node", F.col("cost").alias("last"), F.col("edge_id").cast("long").alias("edge"), "to", "from", "label"))
    by_way = F.array_min(F.zip_with("to", "from", lambda a, b: a + b)) + F.col("cost") + F.col("last")  # by a landmark, so no cheapest path costs more
    possible = first.select("query_id", "label", "cost", "to").join(by_shuffle(last.select("query_id", "label", "last", "from")), ["query_id", "label"])
    bounds = possible.groupBy("query_id").agg((F.min(F.coalesce(by_way, F.lit(float("inf")))) * (1 + _SLACK) + _SLACK).alias("bound"))
    aims = last.groupBy("query_id").agg(F.collect_list(F.struct("cell", "node", "last", "edge", "to", "from").cast(_AIMS[6:-1])).alias("aims"))
    aims = materialize(aims.join(by_shuffle(bounds), "query_id"))
    entered = first.join(by_shuffle(aims.select("query_id")), "query_id", "left_semi").select("query_id", "cell", "node", "cost", "free", "pred", "edge")
    mean = index.arcs.agg(F.avg("weight")).first()[0] or 1.0
    out = _rounds(index.arcs, entered, aims, limit=_FIRST_ARCS * mean)
    state = out.where(F.col("kind") == _STATE).groupBy("query_id", "node").agg(F.min(F.struct("cost", "free", "pred", "edge")).alias("b"))
    found = out.where(F.col("kind") == _ARRIVAL).groupBy("query_id").agg(F.min(F.struct("cost", "node", "edge")).alias("b"))
    return (
        found.select("query_id", "b.node", F.col("b.edge").alias("edge_id"), "b.cost"),
        state.select("query_id", "node", "b.cost", "b.free", "b.pred", F.col("b.edge").alias("pred_edge")),
    )


def _paths_by_levels(starts: DataFrame, ends: DataFrame, index: RoadIndex) -> tuple[DataFrame, DataFrame]:
    """``indexed_paths`` by the levels of the index; ``state`` has the nodes of the paths found."""
    levels, query = index.levels, starts.schema["query_id"].dataType
    sides = [d.select("query_id", F.lit(side).alias("side"), "node", F.col("cost").cast("double").alias("cost"), F.col("edge_id").cast("long").alias("edge")) for side, d in ((FORTH, starts), (BACK, ends))]
    placed = sides[0].unionByName(sides[1]).groupBy("query_id", "side", "node").agg(F.min(F.struct("cost", "edge")).alias("b")).join(index.labels.withColumnRenamed("node_id", "node"), "node")
    meets = placed.groupBy("query_id", "label").agg(F.countDistinct("side").alias("n")).where("n = 2").select("query_id", "label")
    links = materialize(placed.join(meets, ["query_id", "label"], "left_semi").select(
        "query_id", "side", "node", "b.cost", F.struct("node", "b.cost", "b.edge").alias("link"), F.array().cast(PATH).alias("path")))
    best = placed.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", query), T.StructField("best", T.DoubleType())]))
    routes = []
    for depth, level in enumerate(levels[:-1], 1):
        out = climb(level, links.select("query_id", "side", "node", "cost"), best)
        forth, back = (links.where(F.col("side") == s).select("query_id", F.col("node").alias(n), F.col("link").alias(f"link{s}"), F.col("path").alias(f"path{s}")) for s, n in ((FORTH, "root"), (BACK, "node")))
        met = out.where(F.col("side") == MET).join(forth, ["query_id", "root"]).join(back, ["query_id", "node"])
        routes.append(materialize(met.select("query_id", "cost", "link0", "link1", F.concat("path0", hop("root", "node", depth, "cell"), "path1").alias("path"))))
        best = materialize(best.unionByName(routes[-1].select("query_id", F.col("cost").alias("best"))).groupBy("query_id").agg(F.min("best").alias("best")))
        # What is left must be able to meet the other side for less.
        least = out.where(F.col("side") != MET).groupBy("query_id", (1 - F.col("side")).alias("side")).agg(F.min("cost").alias("other"))
        open_rows = out.where(F.col("side") != MET).join(least, ["query_id", "side"]).join(best, "query_id", "left").where(F.col("best").isNull() | (F.col("cost") + F.col("other") < F.col("best")))
        before = links.select("query_id", "side", F.col("node").alias("root"), "link", "path")
        way = F.when(F.col("side") == FORTH, F.concat("path", hop("root", "node", depth, "cell"))).otherwise(F.concat(hop("node", "root", depth, "cell"), "path"))
        links = materialize(open_rows.join(before, ["query_id", "side", "root"]).select("query_id", "side", "node", "cost", "link", way.alias("path")))
    routes.append(_top_routes(levels[-1], links, best))
    every = routes[0]
    for part in routes[1:]:
        every = every.unionByName(part)
    chosen = materialize(every.groupBy("query_id").agg(F.min_by(F.struct("link0", "link1", "path"), F.struct("cost", "link0", "link1")).alias("r")).select("query_id", "r.*"))
    hops = open_paths(levels, chosen.select("query_id", "path"))
    lists = hops.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "hop"))).alias("hops"))
    kinds = T.StructType([T.StructField("query_id", query), *T.StructType.fromDDL("node long, cost double, free int, pred long, pred_edge long, last boolean").fields])

    def walk(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        for batch in batches:
            out = []
            for at, (first, last, hops) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("link0", "link1", "hops")))):
                path = [(first["node"], first["cost"], 0, START_NODE, first["edge"])]
                seen = {first["node"]: 0}
                for h in (x["hop"] for x in hops or []):
                    _, cost, free, *_ = path[-1]
                    if h["v"] in seen:  # a circle without a length
                        while len(path) > seen[h["v"]] + 1:
                            del seen[path.pop()[0]]
                        continue
                    seen[h["v"]] = len(path)
                    path.append((h["v"], cost + h["weight"], 0 if h["weight"] > 0 else free + 1, h["u"], h["edge"]))
                out += [(at, *row, False) for row in path]
                out.append((at, last["node"], path[-1][1] + last["cost"], 0, path[-1][0], last["edge"], True))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:]))], schema=schema)

    walked = materialize(chosen.drop("path").join(lists, "query_id", "left").select("query_id", "link0", "link1", "hops").mapInArrow(walk, kinds))
    found = walked.where("last").select("query_id", "node", F.col("pred_edge").alias("edge_id"), "cost")
    return found, walked.where("not last").drop("last")


def _top_routes(level: Level, links: DataFrame, best: DataFrame) -> DataFrame:
    """(query_id, cost, link0, link1, path) of the routes that meet in the top level."""
    none = F.array().cast("array<double>")
    rows = links.join(level.spots.select(F.col("node_id").alias("node"), "cell"), "node")
    entered = materialize(rows.where(F.col("side") == FORTH).select("query_id", "cell", "node", "cost", F.lit(0).alias("free"), F.lit(START_NODE).cast("long").alias("pred"), F.lit(0).cast("long").alias("edge")))
    aim = F.struct("cell", "node", F.col("cost").alias("last"), F.lit(0).cast("long").alias("edge"), none.alias("to"), none.alias("from")).cast(_AIMS[6:-1])
    aims = materialize(rows.where(F.col("side") == BACK).groupBy("query_id").agg(F.collect_list(aim).alias("aims")).join(best.withColumnRenamed("best", "bound"), "query_id", "left"))
    arcs = level.arcs.select("cell", "u", "v", "to_cell", F.col("arc").alias("edge_id"), "weight").withColumns({"v_to": none, "v_from": none})
    out = _rounds(arcs, entered.join(aims.select("query_id"), "query_id", "left_semi"), aims)
    kinds = T.StructType([out.schema["query_id"], *T.StructType.fromDDL("cost double, root long, node long, arcs array<long>").fields])

    def walk(rows: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        state, goal = {}, None
        for kind, node, *row in zip(*(rows.column(c).to_pylist() for c in ("kind", "node", "cost", "free", "pred", "edge"))):
            if kind == _STATE:
                state[node] = min(state.get(node, row), row)
            elif kind == _ARRIVAL:
                goal = min(goal or (row[0], node), (row[0], node))
        if goal is None:
            return schema.empty_table()
        arcs, node = [], goal[1]
        while state[node][2] != START_NODE:
            arcs.append(state[node][3])
            node = state[node][2]
        return pa.Table.from_arrays([rows.column("query_id").slice(0, 1), *(pa.array([x], f.type) for x, f in zip((goal[0], node, goal[1], arcs[::-1]), list(schema)[1:]))], schema=schema)

    won = materialize(out.groupBy("query_id").applyInArrow(walk, kinds))
    hops = won.select("query_id", F.posexplode("arcs").alias("i", "arc")).join(level.arcs, "arc").select("query_id", "i", F.struct("u", "v", "depth", "inner", F.col("edge_id").alias("edge"), "weight").alias("hop"))
    middle = hops.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "hop"))).alias("m")).select("query_id", F.transform("m", lambda x: x["hop"]).cast(PATH).alias("middle"))
    forth, back = (links.where(F.col("side") == s).select("query_id", F.col("node").alias(n), F.col("link").alias(f"link{s}"), F.col("path").alias(f"path{s}")) for s, n in ((FORTH, "root"), (BACK, "node")))
    joined = won.join(middle, "query_id", "left").join(forth, ["query_id", "root"]).join(back, ["query_id", "node"])
    return materialize(joined.select("query_id", "cost", "link0", "link1", F.concat("path0", F.coalesce("middle", F.array().cast(PATH)), "path1").alias("path")))
