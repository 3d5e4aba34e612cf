import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from catalog.views import view
from placewise.operators import roads
from placewise.operators.relational import name_stops
from tests.conftest import SMALL

WAY = "gid long, source long, target long, cost double, reverse_cost double, length_m double, name string, tag_id int, geom string"


def way(gid, s, t, coords, length, cost=1.0, back=1.0, name="phố", tag=100):
    return (gid, s, t, cost, back, float(length), name, tag, '{"type":"LineString","coordinates":%s}' % [list(c) for c in coords])


def random_ways(seed, side=7):
    rng, ways = random.Random(seed), []
    for n in range(side * side):
        x, y = n % side, n // side
        for dx, dy in ((1, 0), (0, 1)):
            if x + dx < side and y + dy < side:
                a, b = (105.7 + x * 0.001, 10 + y * 0.001), (105.7 + (x + dx) * 0.001, 10 + (y + dy) * 0.001)
                bend = [((a[0] + b[0]) / 2 + dy * 0.0002, (a[1] + b[1]) / 2 + dx * 0.0002)] if rng.random() < 0.4 else []
                one_way = rng.random()
                ways.append(way(len(ways) + 1, n, n + dx + dy * side, [a, *bend, b], rng.randint(5, 40), -1.0 if one_way < 0.15 else 1.0, -1.0 if one_way > 0.8 else 1.0, f"phố {rng.randint(0, 3)}"))
    return ways


def cheapest(ways, starts, ends):
    """Heap search from the start links of one request to its end links."""
    arcs = {}
    for gid, s, t, cost, back, length, *_ in ways:
        if cost >= 0:
            arcs.setdefault(s, []).append((t, length))
        if back >= 0:
            arcs.setdefault(t, []).append((s, length))
    known, heap = {}, [(c, n) for n, c in starts]
    heapq.heapify(heap)
    while heap:
        cost, node = heapq.heappop(heap)
        if node in known:
            continue
        known[node] = cost
        for other, length in arcs.get(node, []):
            if other not in known:
                heapq.heappush(heap, (cost + length, other))
    reached = [known[n] + c for n, c in ends if n in known]
    return min(reached) if reached else None


@pytest.fixture(scope="module")
def routed(spark):
    rows = random_ways(3)
    ways = roads.load_ways(spark.createDataFrame(rows, WAY)).cache()
    rng = random.Random(4)
    asked = [(i, *[v for _ in "ab" for v in (105.7 + rng.random() * 0.006, 10 + rng.random() * 0.006)]) for i in range(40)]
    requests = spark.createDataFrame(asked, "query_id long, start_lng double, start_lat double, end_lng double, end_lat double")
    snapped = roads.snap_requests(requests, ways).cache()
    starts, ends = roads.virtual_links(snapped.where("start_edge_id <> end_edge_id"), ways)
    found, state = roads.shortest_paths(starts, ends, roads.build_road_graph(ways)[0], settle_every=2)
    steps = roads.trace_paths(found, state, unroll=3).cache()
    return rows, ways, snapped, starts.collect(), ends.collect(), found.collect(), steps


def test_costs(routed):
    rows, _, snapped, starts, ends, found, _ = routed
    got = {f.query_id: f.cost for f in found}
    for q in {s.query_id for s in starts}:
        want = cheapest(rows, [(s.node, s.cost) for s in starts if s.query_id == q], [(e.node, e.cost) for e in ends if e.query_id == q])
        assert (want is None and q not in got) or math.isclose(got[q], want)


def test_steps_are_connected(routed):
    rows, _, snapped, starts, ends, found, steps = routed
    edges = {r[0]: r for r in rows}
    paths = {}
    for s in sorted(steps.collect(), key=lambda s: s.step_no):
        paths.setdefault(s.query_id, []).append(s)
    at = {(r.query_id): (r.start_edge_id, r.end_edge_id) for r in snapped.collect()}
    assert set(paths) == {f.query_id for f in found}
    for q, path in paths.items():
        assert [s.step_no for s in path] == list(range(len(path)))
        assert (path[0].edge_id, path[-1].edge_id) == at[q] and path[-1].node == roads.END_NODE
        for before, after in zip(path, path[1:-1]):
            assert {before.node, after.node} == set(edges[after.edge_id][1:3])


def test_route_lines_join_up(routed):
    _, ways, snapped, _, _, _, steps = routed
    features = roads.assemble_routes(snapped, steps, ways)
    lines = {}
    for f in features.collect():
        lines.setdefault(f.query_id, []).append((f.feature_no, f.kind, [(p.lng, p.lat) for p in f.coords]))
    for r in snapped.collect():
        if r.query_id not in lines:
            continue
        parts = [c for _, _, c in sorted(lines[r.query_id])]
        assert parts[0][0] == (r.start_lng, r.start_lat) and parts[-1][-1] == (r.end_lng, r.end_lat)
        for a, b in zip(parts, parts[1:]):
            assert math.dist(a[-1], b[0]) < 1e-12


def test_same_edge_is_three_straight_lines(spark):
    ways = roads.load_ways(spark.createDataFrame([way(0, 1, 2, [(105.7, 10.0), (105.71, 10.0)], 100, back=-1.0)], WAY))
    ask = spark.createDataFrame([(1, 105.708, 10.001, 105.702, 10.001)], "query_id long, start_lng double, start_lat double, end_lng double, end_lat double")
    rows = roads.route_all(ask, ways).orderBy("feature_no").collect()
    assert [(r.kind, len(r.coords), r.edge_id) for r in rows] == [("virtual", 2, None), ("road", 2, 0), ("virtual", 2, None)]


def test_unreachable_has_no_route(spark):
    ways = roads.load_ways(spark.createDataFrame([
        way(1, 1, 2, [(105.7, 10.0), (105.71, 10.0)], 100), way(2, 3, 4, [(105.7, 10.1), (105.71, 10.1)], 100), way(3, 5, 6, [(105.7, 10.2), (105.71, 10.2)], 9, tag=114),
    ], WAY))
    ask = spark.createDataFrame([(1, 105.705, 10.0, 105.705, 10.1)], "query_id long, start_lng double, start_lat double, end_lng double, end_lat double")
    assert roads.route_all(ask, ways).count() == 0
    assert ways.count() == 2


def test_edge_ratio_is_the_share_of_the_whole_edge(spark):
    ways = roads.load_ways(spark.createDataFrame([way(1, 1, 2, [(105.7, 10.0), (105.701, 10.0), (105.704, 10.0)], 400)], WAY))
    ask = spark.createDataFrame([(1, 105.7025, 10.0, 105.7005, 10.0)], "query_id long, start_lng double, start_lat double, end_lng double, end_lat double")
    snapped = roads.snap_requests(ask, ways)
    assert math.isclose(snapped.first().start_ratio, 0.5, rel_tol=1e-6)
    fixed = roads._edge_ratio(snapped, ways).first()
    assert math.isclose(fixed.start_ratio, 0.625, rel_tol=1e-6) and math.isclose(fixed.end_ratio, 0.125, rel_tol=1e-6)


def test_turns(spark):
    p = lambda *c: [(float(x), float(y)) for x, y in c]
    rows = [
        (1, 1, "road", "A", 10.0, p((0, 0), (0, 1))), (1, 2, "road", "A", 5.0, p((0, 1), (0, 2))), (1, 3, "road", "B", 7.0, p((0, 2), (1, 2))),
        (1, 4, "road", "C", 1.0, p((1, 2), (1, 3))), (1, 5, "waypoint", "stop", 0.0, []), (1, 6, "road", "C", 2.0, p((1, 3), (1, 4))),
        (1, 7, "road", "D", 2.0, p((1, 4), (1, 3))), (1, 8, "destination", "đích", 0.0, []),
    ]
    steps = spark.createDataFrame(rows, "route_id int, step_no int, kind string, name string, length_m double, coords array<struct<lng:double,lat:double>>")
    got = [(r.name, r.turn, r.length_m, len(r.coords)) for r in roads.turn_by_turn(steps).orderBy("group_no").collect()]
    assert got == [
        ("A", "start", 15.0, 4), ("B", "right", 7.0, 2), ("C", "left", 1.0, 2), ("stop", "waypoint", 0.0, 0), ("C", "straight", 2.0, 2),
        ("D", "uturn", 2.0, 2), ("đích", "destination", 0.0, 0),
    ]


def test_legs_and_stop_names(spark):
    stops = spark.createDataFrame([(7, i, 105.7 + i, 10.0) for i in range(3)], "route_id long, stop_no int, lng double, lat double")
    legs = roads.route_legs(stops)
    assert [(r.leg_no, r.start_lng, r.end_lng) for r in legs.orderBy("leg_no").collect()] == [(0, 105.7, 106.7), (1, 106.7, 107.7)]
    stores = spark.createDataFrame([(2, "b", 106.7, 10.0), (1, "a", 106.7, 10.0)], "id long, name string, lng double, lat double")
    ends = legs.select("route_id", (F.col("leg_no") + 1).alias("stop_no"), (F.col("leg_no") == 1).alias("last"), F.col("end_lng").alias("lng"), F.col("end_lat").alias("lat"))
    assert {r.stop_no: r.stop_name for r in name_stops(ends, stores).collect()} == {1: "a", 2: "đích"}


def test_free_arcs_make_no_circle(spark):
    """Arcs without length next to each other: every path is traced to its start."""
    arcs = [(50, 10, 1, 5.0), (10, 3, 2, 0.0), (3, 10, 2, 0.0), (3, 20, 3, 5.0), (20, 21, 4, 0.0), (21, 20, 4, 0.0), (21, 3, 5, 5.0), (10, 50, 1, 5.0), (20, 3, 3, 5.0), (10, 4, 6, 0.0), (4, 3, 7, 0.0), (3, 4, 7, 0.0), (4, 10, 6, 0.0)]
    adjacency = spark.createDataFrame(arcs, "u long, v long, edge_id long, weight double")
    starts = spark.createDataFrame([("a", 50, 1.0, 9), ("b", 50, 1.0, 9)], "query_id string, node long, cost double, edge_id long")
    ends = spark.createDataFrame([("a", 21, 2.0, 8), ("b", 99, 2.0, 8)], "query_id string, node long, cost double, edge_id long")
    found, state = roads.shortest_paths(starts, ends, adjacency)
    assert [(r.query_id, r.cost) for r in found.collect()] == [("a", 13.0)]
    steps = roads.trace_paths(found, state).orderBy("step_no").collect()
    assert [r.node for r in steps] == [50, 10, 3, 20, 21, -2]


def test_a_circle_is_an_error(spark):
    found = spark.createDataFrame([("a", 1, 8, 3.0)], "query_id string, node long, edge_id long, cost double")
    state = spark.createDataFrame([("a", 1, 2, 5), ("a", 2, 1, 5)], "query_id string, node long, pred long, pred_edge long")
    with pytest.raises(RuntimeError, match="circle"):
        roads.trace_paths(found, state)


def test_requests_without_a_point_stay(spark):
    ways = roads.load_ways(view(spark, SMALL, "ways"))
    requests = spark.createDataFrame([(1, 105.70, 10.0, 105.702, 10.002), (2, None, 10.0, 105.7, 10.0)], "query_id long, start_lng double, start_lat double, end_lng double, end_lat double")
    assert {r.query_id: r.start_edge_id is None for r in roads.snap_requests(requests, ways).collect()} == {1: False, 2: True}
    assert {r.query_id for r in roads.route_all(requests, ways).collect()} == {1}


def test_paths_by_cells_are_those_of_relaxing(spark):
    """The same ways even where many cost the same, within one cell and over many."""
    from placewise.operators.road_index import build_road_index, indexed_paths

    rows = [(*w[:5], float(10 * (w[0] % 3)), *w[6:]) for w in random_ways(8, side=5)]  # equal lengths, some of them nothing
    ways = roads.load_ways(spark.createDataFrame(rows, WAY)).cache()
    rng = random.Random(9)
    asked = [(i, *[v for _ in "ab" for v in (105.7 + rng.random() * 0.006, 10 + rng.random() * 0.006)]) for i in range(8)]
    asked = spark.createDataFrame(asked, "query_id long, start_lng double, start_lat double, end_lng double, end_lat double")
    snapped = roads.snap_requests(asked, ways).cache()
    starts, ends = (links.cache() for links in roads.virtual_links(snapped.where("start_edge_id <> end_edge_id"), ways))
    graph = roads.build_road_graph(ways)

    def answer(found, state):
        return sorted(map(tuple, found.collect())), sorted(map(tuple, roads.trace_paths(found, state).collect()))

    want = answer(*roads.shortest_paths(starts, ends, graph[0]))
    assert want[0] and answer(*roads.cheapest_paths(starts, ends, *graph)) == want
    assert answer(*indexed_paths(starts, ends, build_road_index(*graph, cell_nodes=12, landmarks=0))) == want


def test_growing_sides_of_a_path_search_are_not_broadcast(spark, monkeypatch):
    """However high the planner's limit is, a search broadcasts only cells' numbers."""
    from placewise.operators import road_index

    plans, write = [], road_index.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df)

    monkeypatch.setattr(road_index, "materialize", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        adjacency = spark.range(30).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.col("id").alias("edge_id"), F.lit(1.0).alias("weight"))
        nodes = spark.range(31).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("lng"), F.lit(0.0).alias("lat"))
        link = lambda node: spark.createDataFrame([(1, node, 0.5, 0)], "query_id long, node long, cost double, edge_id long")
        index = road_index.build_road_index(adjacency, nodes, cell_nodes=8, landmarks=0)
        found, _ = road_index.indexed_paths(link(2), link(20), index)
        assert [r.cost for r in found.collect()] == [19.0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    broadcast = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert broadcast and all("[cell#" in line or "[level#" in line for line in broadcast)
