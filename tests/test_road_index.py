import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators.road_index import assign_cells, build_road_index, component_labels, indexed_paths
from placewise.operators.roads import END_NODE, trace_paths

LINK = "query_id long, node long, cost double, edge_id long"
ARC = "u long, v long, edge_id long, weight double"


def graph(side, seed):
    """A grid with one-way and free arcs, an island, and a node that only has arcs to itself."""
    rng, arcs = random.Random(seed), []
    nodes = [(n, 105.7 + n % side * 0.001, 10 + n // side * 0.001) for n in range(side * side)]
    for n in range(side * side):
        for dx, dy in ((1, 0), (0, 1)):
            if n % side + dx < side and n // side + dy < side:
                m, gid, weight, kind = n + dx + dy * side, len(arcs), rng.choice([0.0, 1.0, 2.0, 5.0, 9.5]), rng.random()
                if kind < 0.85:
                    arcs.append((n, m, gid, weight))
                if kind > 0.15:
                    arcs.append((m, n, gid, weight))
    island = side * side
    nodes += [(island + i, 106.5 + i * 0.001, 10.5) for i in range(3)] + [(island + 5, None, None)]
    arcs += [(island, island + 1, 9000, 3.0), (island + 1, island + 2, 9001, 3.0), (island + 5, island + 5, 9002, 1.0)]
    return nodes, arcs


def cheapest(arcs, starts, ends):
    out = {}
    for u, v, _, w in arcs:
        out.setdefault(u, []).append((v, w))
    known, heap = {}, [(c, n) for n, c in starts]
    heapq.heapify(heap)
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in known:
            known[node] = cost
            for other, w in out.get(node, []):
                heapq.heappush(heap, (cost + w, other))
    reached = [known[n] + c for n, c in ends if n in known]
    return min(reached) if reached else None


@pytest.fixture(scope="module", params=[(3, 40, 2), (4, 60, 0)])
def case(request, spark):
    seed, cell_nodes, landmarks = request.param
    nodes, arcs = graph(12, seed)
    rng = random.Random(seed)
    ids = [n for n, *_ in nodes]
    starts = [(q, rng.choice(ids), float(rng.randrange(4)), 10_000 + q) for q in range(60) for _ in range(rng.randrange(1, 3))]
    ends = [(q, rng.choice(ids), float(rng.randrange(4)), 20_000 + q) for q in range(60) for _ in range(rng.randrange(1, 3))]
    starts += [(100, 144, 0.0, 1), (101, 0, 0.0, 1), (102, 3, 1.0, 1), (103, 149, 0.0, 1), (104, None, 0.0, 1)]
    ends += [(100, 5, 0.0, 2), (101, 146, 0.0, 2), (102, 3, 1.0, 2), (103, 149, 0.5, 2), (104, 3, 0.0, 2)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((nodes, "node_id long, lng double, lat double"), (arcs, ARC), (starts, LINK), (ends, LINK))]
    index = build_road_index(frames[1], frames[0], cell_nodes=cell_nodes, landmarks=landmarks)
    found, state = indexed_paths(frames[2], frames[3], index)
    return arcs, starts, ends, index, found.collect(), trace_paths(found, state, unroll=3).collect(), frames


def test_costs_equal_a_heap_search(case):
    arcs, starts, ends, _, found, _, _ = case
    got = {r.query_id: r.cost for r in found}
    for q in {s[0] for s in starts}:
        want = cheapest(arcs, [(n, c) for k, n, c, _ in starts if k == q and n is not None], [(n, c) for k, n, c, _ in ends if k == q])
        assert (want is None and q not in got) or math.isclose(got[q], want), q
    assert 100 not in got and 101 not in got and 104 not in got and got[102] == 2.0 and got[103] == 0.5


def test_paths_add_up(case):
    arcs, starts, ends, _, found, steps, _ = case
    weights = {(u, v, e): w for u, v, e, w in arcs}
    paths = {}
    for s in sorted(steps, key=lambda s: s.step_no):
        paths.setdefault(s.query_id, []).append(s)
    assert set(paths) == {r.query_id for r in found}
    for r in found:
        path = paths[r.query_id]
        assert [s.step_no for s in path] == list(range(len(path))) and path[-1].node == END_NODE
        total = min(c for q, n, c, e in starts if (q, n, e) == (r.query_id, path[0].node, path[0].edge_id))
        total += sum(weights[a.node, b.node, b.edge_id] for a, b in zip(path, path[1:-1]))
        total += min(c for q, n, c, e in ends if (q, n, e) == (r.query_id, path[-2].node, path[-1].edge_id))
        assert math.isclose(total, r.cost)


def test_cells_are_bounded_and_labels_are_components(case):
    arcs, _, _, index, _, _, frames = case
    sizes = index.cells.groupBy("cell").count().collect()
    assert sum(r["count"] for r in sizes) == frames[0].count()
    labels = {r.node_id: r.label for r in index.labels.collect()}
    assert all(labels[u] == labels[v] for u, v, *_ in arcs)
    assert {labels[n] for n in range(144)} == {0} and labels[144] == labels[146] == 144 and labels[149] == 149


def test_cells(spark):
    nodes = spark.createDataFrame([(i, 105.7, 10.0) for i in range(50)] + [(100 + i, 105.7 + i * 1e-4, 10.0) for i in range(50)], "node_id long, lng double, lat double")
    cells = assign_cells(nodes, 8)
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert sum(sizes) == 100 and max(sizes) < 25 and cells.select("node_id").distinct().count() == 100
    assert assign_cells(nodes.limit(0), 8).count() == 0


def test_long_chain_over_many_cells(spark):
    """150 edges in many cells; the labels and the landmarks come through all of them."""
    n = 150
    nodes = spark.createDataFrame([(i, 105.7 + i * 0.001, 10.0) for i in range(n + 1)], "node_id long, lng double, lat double")
    arcs = spark.createDataFrame([a for i in range(n) for a in ((i, i + 1, i, 1.0), (i + 1, i, i, 1.5))], ARC)
    index = build_road_index(arcs, nodes, cell_nodes=80, landmarks=2)
    assert index.labels.select("label").distinct().count() == 1
    marks = {r.node_id: sorted(zip(r.to, r["from"])) for r in index.marks.collect()}
    assert marks[0] == [(0.0, 0.0), (150.0, 225.0)] and marks[150] == [(0.0, 0.0), (225.0, 150.0)]
    starts, ends = (spark.createDataFrame([(1, a, 0.0, 500), (2, b, 0.0, 500), (3, 70, 0.0, 500)], LINK) for a, b in ((0, n), (n, 0)))
    found, state = indexed_paths(starts, ends, index)
    assert {r.query_id: r.cost for r in found.collect()} == {1: 150.0, 2: 225.0, 3: 0.0}
    assert trace_paths(found, state).where("query_id = 1").count() == n + 2


def test_empty_tables(spark):
    nodes, arcs = spark.createDataFrame([], "node_id long, lng double, lat double"), spark.createDataFrame([], ARC)
    links = spark.createDataFrame([(1, 3, 0.0, 1)], LINK)
    found, state = indexed_paths(links, links, build_road_index(arcs, nodes))
    assert found.count() == state.count() == 0
    index = build_road_index(spark.createDataFrame([(1, 2, 1, 1.0)], ARC), spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "node_id long, lng double, lat double"))
    assert indexed_paths(links.limit(0), links, index)[0].count() == 0
    assert component_labels(index.arcs.limit(0)).count() == 0
    assert index.cells.where(F.col("cell").isNull()).count() == 0


def test_rounds_follow_the_levels_not_the_cells(spark, caplog):
    """A road through some thirty cells, back and forth and with a shortcut, is searched in a few rounds."""
    n = 240
    nodes = spark.createDataFrame([(i, 105.7 + i * 0.001, 10.0) for i in range(n + 1)], "node_id long, lng double, lat double")
    rows = [a for i in range(n) for a in ((i, i + 1, i, 1.0), (i + 1, i, i, 1.5))] + [(10, 230, 900, 50.0)]
    with caplog.at_level("INFO", logger="placewise.operators.road_index"):
        index = build_road_index(spark.createDataFrame(rows, ARC), nodes, cell_nodes=8)
        starts, ends = (spark.createDataFrame([(1, a, 0.25, 500), (2, b, 0.5, 500), (3, 12, 0.0, 500)], LINK) for a, b in ((0, n), (n, 0)))
        found, state = indexed_paths(starts, ends, index)
        assert {r.query_id: r.cost for r in found.collect()} == {1: 70.5, 2: 361.0, 3: 0.0}
    assert index.cells.select("cell").distinct().count() > 30
    assert 0 < max(int(r.getMessage().split()[1].rstrip(":")) for r in caplog.records if r.getMessage().startswith("round")) < 10
    assert trace_paths(found, state).groupBy("query_id").count().orderBy("query_id").collect() == [(1, 23), (2, n + 2), (3, 2)]
