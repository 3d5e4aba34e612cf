"""Snapping, road graph, routes, turn-by-turn."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog.registry import bearing, haversine, query, r4, sql_r4
from catalog.store_queries import WAYS_PARSED
from placewise.functions.geo import parse_linestring
from placewise.operators import roads
from placewise.operators.relational import name_stops
from placewise.operators.road_index import build_road_index, indexed_paths
from placewise.operators.spatial import snap_to_edges, snap_within
from placewise.tables import materialize

_T = "CASE WHEN (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ((lng-ax)*(bx-ax)+(lat-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) END"
_USABLE = "SELECT * FROM w WHERE tag_id NOT IN (114, 117, 118, 119, 122)"
_SEGS = "SELECT gid, i - 1 AS seg, c[i][1] AS ax, c[i][2] AS ay, c[i+1][1] AS bx, c[i+1][2] AS by_ FROM (SELECT gid, c, unnest(range(1, len(c))) AS i FROM usable) x"


def _nearest(points: str, where: str = "") -> str:
    return f"""SELECT point_id, edge_id, seg, t, px, py, d2 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, edge_id, seg) AS n FROM (
 SELECT point_id, edge_id, seg, t, px, py, (lng - px) * (lng - px) + (lat - py) * (lat - py) AS d2 FROM (
  SELECT *, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py FROM (SELECT point_id, gid AS edge_id, seg, lng, lat, ax, ay, bx, by_, {_T} AS t FROM {points} CROSS JOIN segs {where}) a) b) c) d WHERE n = 1"""


_ROADS = {"w": WAYS_PARSED, "usable": _USABLE, "segs": _SEGS}


def _ways(d):
    return roads.load_ways(d.ways)


@query(
    "j4_g13_snap_to_edges",
    f"""SELECT s.point_id, edge_id, CAST(seg AS INTEGER) AS seg, {sql_r4('t')} AS ratio, {sql_r4(haversine('p.lng', 'p.lat', 's.px', 's.py'))} AS error_m FROM snapped s JOIN points p ON p.point_id = s.point_id""",
    "points ways", {**_ROADS, "snapped": _nearest("points")},
)
def _(d):
    from placewise.functions.geo import haversine_m

    snapped = snap_to_edges(d.points, _ways(d)).join(d.points, "point_id")
    error = haversine_m(F.col("lng"), F.col("lat"), F.col("proj_lng"), F.col("proj_lat"))
    return snapped.select("point_id", "edge_id", "seg", r4("ratio").alias("ratio"), r4(error).alias("error_m"))


_BOXED = "SELECT gid, list_min(list_transform(c, lambda p: p[1])) AS x1, list_max(list_transform(c, lambda p: p[1])) AS x2, list_min(list_transform(c, lambda p: p[2])) AS y1, list_max(list_transform(c, lambda p: p[2])) AS y2 FROM usable"


@query(
    "j5_snap_within",
    f"""SELECT point_id, edge_id, {sql_r4('t')} AS ratio FROM near UNION ALL SELECT point_id, edge_id, {sql_r4('t')} FROM anywhere WHERE point_id NOT IN (SELECT point_id FROM near)""",
    "points ways", {
        **_ROADS, "boxed": _BOXED, "anywhere": _nearest("points"),
        "pairs": "SELECT p.*, b.gid AS bgid FROM points p JOIN boxed b ON b.x1 <= p.lng + CAST(0.001 AS DOUBLE) AND b.x2 >= p.lng - CAST(0.001 AS DOUBLE) AND b.y1 <= p.lat + CAST(0.001 AS DOUBLE) AND b.y2 >= p.lat - CAST(0.001 AS DOUBLE)",
        "near": _nearest("pairs", "WHERE gid = bgid").replace("CROSS JOIN segs WHERE gid = bgid", "JOIN segs ON gid = bgid"),
    },
)
def _(d):
    return snap_within(d.points, _ways(d)).select("point_id", "edge_id", r4("ratio").alias("ratio"))


_ADJ = "SELECT source AS u, target AS v, gid AS edge_id, length_m AS weight FROM usable WHERE cost >= 0 UNION ALL SELECT target, source, gid, length_m FROM usable WHERE reverse_cost >= 0"


@query("g4_adjacency", "SELECT * FROM adj", "ways", {**_ROADS, "adj": _ADJ})
def _(d):
    return roads.build_road_graph(_ways(d))[0]


@query(
    "g4_adjacency_by_cost",
    "SELECT source AS u, target AS v, gid AS edge_id, CAST(cost AS DOUBLE) AS weight FROM usable WHERE cost >= 0 UNION ALL SELECT target, source, gid, CAST(cost AS DOUBLE) FROM usable WHERE reverse_cost >= 0",
    "ways", {"w": WAYS_PARSED, "usable": _USABLE},
)
def _(d):
    return roads.build_road_graph(_ways(d), weight="cost")[0]


@query(
    "g4_nodes", "SELECT node_id, max_by(x, gid) AS lng, max_by(y, gid) AS lat FROM (SELECT source AS node_id, gid, c[1][1] AS x, c[1][2] AS y FROM usable UNION ALL SELECT target, gid, c[-1][1], c[-1][2] FROM usable) n GROUP BY node_id",
    "ways", {"w": WAYS_PARSED, "usable": _USABLE},
)
def _(d):
    return roads.build_road_graph(_ways(d))[1]


_REQUEST_SNAPS = {
    **_ROADS,
    "ends": "SELECT query_id * 2 AS point_id, start_lng AS lng, start_lat AS lat FROM route_requests UNION ALL SELECT query_id * 2 + 1, end_lng, end_lat FROM route_requests",
    "snapped": _nearest("ends"),
    "sides": "SELECT r.query_id, a.edge_id AS e1, a.t AS t1, b.edge_id AS e2, b.t AS t2 FROM route_requests r JOIN snapped a ON a.point_id = r.query_id * 2 JOIN snapped b ON b.point_id = r.query_id * 2 + 1",
    "starts": "SELECT query_id, target AS node, length_m * (1 - t1) AS cost, gid AS edge_id FROM sides JOIN usable u ON gid = e1 WHERE e1 <> e2 AND u.cost >= 0 UNION ALL SELECT query_id, source, length_m * t1, gid FROM sides JOIN usable u ON gid = e1 WHERE e1 <> e2 AND reverse_cost >= 0",
    "finals": "SELECT query_id, source AS node, length_m * t2 AS cost, gid AS edge_id FROM sides JOIN usable u ON gid = e2 WHERE e1 <> e2 AND u.cost >= 0 UNION ALL SELECT query_id, target, length_m * (1 - t2), gid FROM sides JOIN usable u ON gid = e2 WHERE e1 <> e2 AND reverse_cost >= 0",
}


def _links(d):
    ways = _ways(d)
    snapped = materialize(roads.snap_requests(d.route_requests, ways))
    return roads.virtual_links(snapped.where("start_edge_id <> end_edge_id"), ways), snapped, ways


@query(
    "g5_virtual_links",
    f"SELECT 'start' AS side, query_id, node, {sql_r4('cost')} AS cost, edge_id FROM starts UNION ALL SELECT 'end', query_id, node, {sql_r4('cost')}, edge_id FROM finals",
    "route_requests ways", _REQUEST_SNAPS,
)
def _(d):
    (starts, ends), _, _ = _links(d)
    both = starts.withColumn("side", F.lit("start")).unionByName(ends.withColumn("side", F.lit("end")))
    return both.select("side", "query_id", "node", r4("cost").alias("cost"), "edge_id")


# Cheapest costs by recursion; no route of this table is longer than the bound, so cutting there changes nothing.
_COSTS = {
    **_REQUEST_SNAPS, "adj": _ADJ,
    "firsts": "SELECT query_id, node, min(cost) AS cost FROM starts GROUP BY ALL",
}
_COST_SQL = f"""SELECT f.query_id, {sql_r4('min(d.cost + f.cost)')} AS cost FROM dist d JOIN finals f ON f.query_id = d.query_id AND f.node = d.node GROUP BY f.query_id"""
_DIST = """dist(query_id, node, cost) USING KEY (query_id, node) AS (SELECT query_id, node, cost FROM firsts UNION
 SELECT n.query_id, n.node, n.cost FROM (SELECT d.query_id, a.v AS node, min(d.cost + a.weight) AS cost FROM dist d JOIN adj a ON a.u = d.node WHERE d.cost + a.weight <= 6000 GROUP BY ALL) n
 LEFT JOIN recurring.dist r ON r.query_id = n.query_id AND r.node = n.node WHERE r.cost IS NULL OR n.cost < r.cost)"""


def _searched(d):
    (starts, ends), snapped, ways = _links(d)
    adjacency, nodes = roads.build_road_graph(ways)
    found, state = roads.cheapest_paths(starts, ends, adjacency, nodes)
    return found, state, starts, ends, adjacency


@query("g6_shortest_paths", _COST_SQL, "route_requests ways", _COSTS)
def _(d):
    return _searched(d)[0].select("query_id", r4("cost").alias("cost"))


@query("g6_indexed_paths", _COST_SQL, "route_requests ways", _COSTS)
def _(d):
    """The same costs with an index of cells and component labels."""
    (starts, ends), _, ways = _links(d)
    index = build_road_index(*roads.build_road_graph(ways), landmarks=0)
    return indexed_paths(starts, ends, index)[0].select("query_id", r4("cost").alias("cost"))


def _wide(ctes: dict[str, str]) -> dict[str, str]:
    """The same for long requests on the roads with an island."""
    return {n: re.sub(r"\bways\b", "wide_ways", text.replace("route_requests", "long_requests")) for n, text in ctes.items()}


@query("g6_long_routes", _COST_SQL, "long_requests wide_ways", _wide(_COSTS))
def _(d):
    """Routes through the whole grid with landmarks; those to the island have no row."""
    ways = roads.load_ways(d.wide_ways)
    snapped = materialize(roads.snap_requests(d.long_requests, ways))
    starts, ends = roads.virtual_links(snapped.where("start_edge_id <> end_edge_id"), ways)
    index = build_road_index(*roads.build_road_graph(ways), cell_nodes=500)
    return indexed_paths(starts, ends, index)[0].select("query_id", r4("cost").alias("cost"))


@query("g7_traced_costs", _COST_SQL, "route_requests ways", _COSTS)
def _(d):
    """The cost of every traced path, added up step by step."""
    found, state, starts, ends, adjacency = _searched(d)
    steps = roads.trace_paths(found, state)
    last = steps.groupBy("query_id").agg(F.max("step_no").alias("last_no"))
    steps = steps.join(last, "query_id")
    middle = steps.where("step_no > 0 and step_no < last_no").join(adjacency.groupBy("edge_id").agg(F.min("weight").alias("cost")), "edge_id")
    first = steps.where("step_no = 0").join(starts, ["query_id", "node", "edge_id"])
    before = steps.select("query_id", (F.col("step_no") + 1).alias("step_no"), F.col("node").alias("at"))
    final = steps.where("step_no = last_no").join(before, ["query_id", "step_no"]).select("query_id", "edge_id", F.col("at").alias("node")).join(ends, ["query_id", "node", "edge_id"])
    parts = [p.select("query_id", "cost") for p in (first, middle, final)]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id").agg(F.sum("cost").alias("cost"))
    # Sums in another order differ in the last bits only.
    return total.select("query_id", r4(F.round("cost", 7)).alias("cost"))


def _use_recursion(name: str) -> None:
    from catalog.registry import ORACLES

    text = ORACLES[name]
    cut = text.rindex("\nSELECT f.query_id")
    dist = _DIST if name != "g6_long_routes" else _DIST.replace(" WHERE d.cost + a.weight <= 6000", "")
    ORACLES[name] = "WITH RECURSIVE " + text[len("WITH "):cut] + ", " + dist + text[cut:]


for _name in ("g6_shortest_paths", "g6_indexed_paths", "g6_long_routes", "g7_traced_costs"):
    _use_recursion(_name)


def _line(coords) -> F.Column:
    return F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", F.format_string("%.6f", p["lng"]), F.format_string("%.6f", p["lat"]))), ",")


@query("g8_g9_g11_routes")
def _(d):
    features = roads.route_all(d.route_requests, _ways(d))
    return features.select("query_id", "feature_no", "kind", "edge_id", "name", "length_m", _line(F.col("coords")).alias("line"))


@query(
    "g9_same_edge",
    """SELECT s.query_id, s.e1 AS edge_id, CAST(3 AS BIGINT) AS features FROM sides s WHERE e1 = e2""", "route_requests ways", _REQUEST_SNAPS,
)
def _(d):
    ways = _ways(d)
    snapped = materialize(roads.snap_requests(d.route_requests, ways))
    no_steps = snapped.select("query_id", F.lit(0).alias("step_no"), F.col("start_edge_id").alias("edge_id"), F.lit(-2).cast("bigint").alias("node")).limit(0)
    features = roads.assemble_routes(snapped, no_steps, ways)
    return features.groupBy("query_id").agg(F.max("edge_id").alias("edge_id"), F.count("*").alias("features")).where("features = 3")


def _stops(d):
    """Three stops per customer: start and end of the request, and the start of the customer one row further."""
    r = d.route_requests
    nxt = r.select((F.col("query_id") - 40).alias("query_id"), F.col("start_lng").alias("n_lng"), F.col("start_lat").alias("n_lat"))
    rows = r.join(nxt, "query_id").select(F.col("query_id").alias("route_id"), F.inline(F.array(
        F.struct(F.lit(0).alias("stop_no"), F.col("start_lng").alias("lng"), F.col("start_lat").alias("lat")),
        F.struct(F.lit(1).alias("stop_no"), F.col("end_lng").alias("lng"), F.col("end_lat").alias("lat")),
        F.struct(F.lit(2).alias("stop_no"), F.col("n_lng").alias("lng"), F.col("n_lat").alias("lat")),
    )))
    return rows


@query(
    "g10_route_legs",
    f"""SELECT r.query_id AS route_id, CAST(leg AS INTEGER) AS leg_no, {sql_r4('CASE leg WHEN 0 THEN r.start_lng ELSE r.end_lng END')} AS start_lng, {sql_r4('CASE leg WHEN 0 THEN r.end_lng ELSE n.start_lng END')} AS end_lng
FROM route_requests r JOIN route_requests n ON n.query_id = r.query_id + 40 CROSS JOIN (SELECT 0 AS leg UNION ALL SELECT 1) l""", "route_requests",
)
def _(d):
    legs = roads.route_legs(_stops(d))
    return legs.select("route_id", "leg_no", r4("start_lng").alias("start_lng"), r4("end_lng").alias("end_lng"))


@query("g10_g12_turn_by_turn")
def _(d):
    legs = materialize(roads.route_legs(_stops(d)))
    features = roads.route_all(legs, _ways(d))
    closing = legs.select("route_id", "leg_no", (F.col("leg_no") + 1).alias("stop_no"), (F.col("leg_no") == 1).alias("last"), F.col("end_lng").alias("lng"), F.col("end_lat").alias("lat"))
    steps = roads.leg_steps(legs, features, name_stops(closing, d.stores).select("route_id", "leg_no", "stop_name", "last"))
    turns = roads.turn_by_turn(steps)
    return turns.select("route_id", "group_no", "kind", "name", "turn", "length_m", _line(F.col("coords")).alias("line"))


# A drive along every row of the grid: some edges lie across it, so there are turns.
_STEPS = """SELECT CAST(floor(source / 40) AS BIGINT) AS route_id, gid AS step_no, CASE WHEN gid % 17 = 3 THEN 'waypoint' ELSE 'road' END AS kind,
 concat('Phố ', CAST(CAST(floor(gid / 4) AS BIGINT) % 3 AS STRING)) AS name, length_m, c FROM w"""


@query(
    "w3_g12_merge_steps",
    f"""SELECT route_id, CAST(g AS BIGINT) AS group_no, any_value(kind) AS kind, min_by(name, step_no) AS name, min_by(turn, step_no) AS turn, sum(CASE WHEN kind = 'road' THEN length_m ELSE 0 END) AS length_m FROM (
 SELECT *, sum(CASE WHEN kind = 'road' AND pk = 'road' AND pn = name THEN 0 ELSE 1 END) OVER (PARTITION BY route_id ORDER BY step_no ROWS UNBOUNDED PRECEDING) - 1 AS g,
  CASE WHEN kind <> 'road' THEN kind WHEN pk IS NULL THEN 'start' WHEN pk <> 'road' THEN 'straight' WHEN abs(diff) < 25 THEN 'straight'
   WHEN abs(diff) <= 100 THEN CASE WHEN diff > 0 THEN 'right' ELSE 'left' END WHEN abs(diff) < 170 THEN CASE WHEN diff > 0 THEN 'hard-right' ELSE 'hard-left' END ELSE 'uturn' END AS turn
 FROM (SELECT *, CASE WHEN raw > 180 THEN raw - 360 ELSE raw END AS diff FROM (SELECT *, ({bearing('c[1][1]', 'c[1][2]', 'c[2][1]', 'c[2][2]')} - {bearing('pc[-2][1]', 'pc[-2][2]', 'pc[-1][1]', 'pc[-1][2]')} + 360) % 360 AS raw
  FROM (SELECT *, lag(kind) OVER o AS pk, lag(name) OVER o AS pn, lag(c) OVER o AS pc FROM steps WINDOW o AS (PARTITION BY route_id ORDER BY step_no)) a) b) e) f GROUP BY route_id, g""",
    "ways", {"w": WAYS_PARSED, "steps": _STEPS},
)
def _(d):
    return roads.turn_by_turn(_drive(d)).select("route_id", "group_no", "kind", "name", "turn", "length_m")


def _drive(d):
    stop = F.col("gid") % 17 == 3
    c = parse_linestring(F.col("geom"))
    return d.ways.select(
        F.floor(F.col("source") / 40).alias("route_id"), F.col("gid").alias("step_no"), F.when(stop, "waypoint").otherwise("road").alias("kind"),
        F.concat(F.lit("Phố "), (F.floor(F.col("gid") / 4) % 3).cast("string")).alias("name"), F.when(stop, 0.0).otherwise(F.col("length_m")).alias("length_m"), c.alias("coords"),
    )


@query("a8_route_length", "SELECT route_id, sum(CASE WHEN kind = 'road' THEN length_m ELSE 0 END) AS length_m FROM steps GROUP BY route_id", "ways", {"w": WAYS_PARSED, "steps": _STEPS})
def _(d):
    return roads.route_length(_drive(d))
