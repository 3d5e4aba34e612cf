"""Road graph, shortest paths for a table of requests, route geometry and turn-by-turn steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geo import (
    bearing, first_coord, haversine_m, last_coord, parse_linestring, project_to_segment, turn_type,
)
from placewise.operators.road_index import RoadIndex, build_road_index, indexed_paths
from placewise.operators.spatial import snap_to_edges
from placewise.tables import by_shuffle, materialize

# --- Fixed values -------------------------------------------------------------------------------------------
EXCLUDED_TAGS = [114, 117, 118, 119, 122]
CITY_BBOX = (105.6717, 9.9679, 105.8697, 10.0708)
NO_NAME = "Không tên"
START_NODE, END_NODE = -1, -2
# ------------------------------------------------------------------------------------------------------------


def load_ways(ways: DataFrame, bbox: tuple[float, float, float, float] | None = None, excluded_tags: list[int] = EXCLUDED_TAGS) -> DataFrame:
    """Usable road edges with parsed ``coords``; with a bbox those whose own box overlaps it.

    Stored min/max columns (min_lng, ...) are used when the table has them, so the filter reaches the scan.
    """
    kept = ways.where(~F.col("tag_id").isin(excluded_tags))
    if "coords" not in kept.columns:
        kept = kept.withColumn("coords", parse_linestring(F.col("geom"))).drop("geom")
    if bbox is None:
        return kept
    bounds = {}
    for n in ("lng", "lat"):
        for side, pick in (("min", F.array_min), ("max", F.array_max)):
            name = f"{side}_{n}"
            bounds[name] = F.col(name) if name in kept.columns else pick(F.col("coords")[n])
    return kept.where(
        (bounds["min_lng"] <= bbox[2]) & (bounds["max_lng"] >= bbox[0]) & (bounds["min_lat"] <= bbox[3]) & (bounds["max_lat"] >= bbox[1])
    )


def build_road_graph(ways: DataFrame, weight: str = "length_m") -> tuple[DataFrame, DataFrame]:
    """(adjacency u, v, edge_id, weight; nodes node_id, lng, lat). A negative cost closes a direction."""
    forward = F.when(F.col("cost") >= 0, F.struct(F.col("source").alias("u"), F.col("target").alias("v")))
    backward = F.when(F.col("reverse_cost") >= 0, F.struct(F.col("target").alias("u"), F.col("source").alias("v")))
    arcs = F.filter(F.array(forward, backward), lambda a: a.isNotNull())
    adjacency = ways.select(F.col("gid").alias("edge_id"), F.col(weight).cast("double").alias("weight"), F.explode(arcs).alias("a")).select(
        "a.u", "a.v", "edge_id", "weight"
    )
    ends = F.array(
        F.struct(F.col("source").alias("node_id"), first_coord(F.col("coords")).alias("p")),
        F.struct(F.col("target").alias("node_id"), last_coord(F.col("coords")).alias("p")),
    )
    nodes = ways.select(F.col("gid"), F.explode(ends).alias("e")).groupBy("e.node_id").agg(F.max_by("e.p", "gid").alias("p"))
    return adjacency, nodes.select("node_id", "p.lng", "p.lat")


def snap_requests(requests: DataFrame, ways: DataFrame) -> DataFrame:
    """Snap both ends of (query_id, start_lng, start_lat, end_lng, end_lat) to edges; each distinct point is
    snapped once. Adds edge, ratio, projection and snap error in metres for ``start`` and ``end``."""
    ends = [requests.select(F.col(f"{e}_lng").alias("lng"), F.col(f"{e}_lat").alias("lat")) for e in ("start", "end")]
    points = ends[0].unionByName(ends[1]).where("lng is not null and lat is not null").distinct()
    points = points.withColumn("point_id", F.concat_ws(",", "lng", "lat"))
    snapped = points.join(by_shuffle(snap_to_edges(points, ways)), "point_id").withColumn(
        "error_m", haversine_m(F.col("lng"), F.col("lat"), F.col("proj_lng"), F.col("proj_lat"))
    )
    df = requests
    for e in ("start", "end"):
        side = snapped.select(
            F.col("lng").alias(f"{e}_lng"), F.col("lat").alias(f"{e}_lat"),
            *[F.col(c).alias(f"{e}_{c}") for c in ("edge_id", "ratio", "proj_lng", "proj_lat", "error_m")],
        )
        df = df.join(by_shuffle(side), [f"{e}_lng", f"{e}_lat"], "left")  # a request without a point keeps its row
    return df


def _edge_ratio(snapped: DataFrame, ways: DataFrame) -> DataFrame:
    """Replace the segment-local ratio by the share of the whole edge's length before the projection."""
    lengths = ways.select("gid", "coords")
    for e in ("start", "end"):
        geo = lengths.select(F.col("gid").alias(f"{e}_edge_id"), F.col("coords").alias("_c"))
        spot = F.struct(F.col(f"{e}_proj_lng").alias("lng"), F.col(f"{e}_proj_lat").alias("lat"))
        at = _segment_of(F.col("_c"), spot)

        def metres(coords: Column) -> Column:
            steps = F.transform(F.sequence(F.lit(0), F.size(coords) - 2), lambda i: haversine_m(
                F.get(coords, i)["lng"], F.get(coords, i)["lat"], F.get(coords, i + 1)["lng"], F.get(coords, i + 1)["lat"]))
            return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

        before = metres(F.concat(F.slice("_c", F.lit(1), at + 1), F.array(spot)))
        snapped = snapped.join(geo, f"{e}_edge_id").withColumn(f"{e}_ratio", before / metres(F.col("_c"))).drop("_c")
    return snapped


def virtual_links(snapped: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts: query_id, node, cost, edge_id; ends alike): the links of both virtual nodes to the graph."""

    def links(end: str, toward: bool) -> DataFrame:
        edge = ways.select(F.col("gid").alias(f"{end}_edge_id"), "source", "target", "cost", "reverse_cost", F.col("length_m").cast("double").alias("_len"))
        df = snapped.select("query_id", f"{end}_edge_id", F.col(f"{end}_ratio").alias("_r")).join(by_shuffle(edge), f"{end}_edge_id")
        part, rest = F.col("_len") * F.col("_r"), F.col("_len") * (1 - F.col("_r"))
        ahead = F.struct(F.col("source" if toward else "target").alias("node"), (part if toward else rest).alias("cost"))
        back = F.struct(F.col("target" if toward else "source").alias("node"), (rest if toward else part).alias("cost"))
        options = F.filter(
            F.array(F.when(F.col("cost") >= 0, ahead), F.when(F.col("reverse_cost") >= 0, back)), lambda o: o.isNotNull()
        )
        return df.select("query_id", F.col(f"{end}_edge_id").alias("edge_id"), F.explode(options).alias("o")).select(
            "query_id", "o.node", "o.cost", "edge_id"
        )

    return links("start", False), links("end", True)


def shortest_paths(
    starts: DataFrame, ends: DataFrame, adjacency: DataFrame, max_rounds: int = 100000, settle_every: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Cheapest paths of all requests at once: (found: query_id, node, edge_id, cost; state).

    ``starts`` and ``ends`` are link tables (query_id, node, cost, edge_id). Every round relaxes the arcs of
    the nodes improved in the round before; a node costlier than the best known arrival of its request is
    dropped, so a request explores only the surroundings of its path. Equal costs: fewest free arcs since the last
    one with a length (so free arcs can make no circle), then smallest (pred, edge).
    ``state`` keeps cost, free, pred and pred_edge per (query_id, node). Every ``settle_every`` rounds the rows of
    finished requests are set aside, so that later rounds rewrite only those still searching.
    """
    state = starts.groupBy("query_id", "node").agg(
        F.min(F.struct("cost", F.lit(0).alias("free"), F.lit(START_NODE).cast("bigint").alias("pred"), F.col("edge_id").alias("pred_edge"))).alias("b")
    ).select("query_id", "node", "b.*", F.lit(0).alias("round"))
    ends, adjacency = materialize(ends), materialize(adjacency)
    state, settled = materialize(state), []
    for step in range(1, max_rounds + 1):
        arrival = _arrivals(state, ends).groupBy("query_id").agg(F.min("cost").alias("_best"))
        frontier = state.where(F.col("round") == step - 1).select("query_id", F.col("node").alias("u"), F.col("cost").alias("_cost"), F.col("free").alias("_free"))
        moved = frontier.join(adjacency, "u").join(arrival, "query_id", "left")
        cost = F.col("_cost") + F.col("weight")
        moved = moved.where(F.col("_best").isNull() | (cost < F.col("_best"))).select(
            "query_id", F.col("v").alias("node"), cost.alias("cost"), F.when(F.col("weight") > 0, 0).otherwise(F.col("_free") + 1).alias("free"), F.col("u").alias("pred"),
            F.col("edge_id").alias("pred_edge"), F.lit(step).alias("round"),
        )
        merged = state.unionByName(moved).groupBy("query_id", "node").agg(
            F.min(F.struct("cost", "free", "pred", "pred_edge")).alias("b"),
            F.min(F.when(F.col("round") < step, F.struct("cost", "round"))).alias("old"),
        )
        improved = F.col("old").isNull() | (F.col("b.cost") < F.col("old.cost"))
        state = materialize(merged.select(
            "query_id", "node", "b.*", F.when(improved, F.lit(step)).otherwise(F.col("old.round")).alias("round")
        ))
        if state.where(F.col("round") == step).isEmpty():
            break
        if step % settle_every == 0:
            searching = materialize(state.where(F.col("round") == step).select("query_id").distinct())
            settled.append(materialize(state.join(searching, "query_id", "left_anti")))
            state = materialize(state.join(searching, "query_id", "left_semi"))
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    state = reduce(lambda a, b: a.unionByName(b), settled, state)
    found = _arrivals(state, ends).groupBy("query_id").agg(F.min(F.struct("cost", "node", "edge_id")).alias("b"))
    return found.select("query_id", "b.node", "b.edge_id", "b.cost"), state


def cheapest_paths(starts: DataFrame, ends: DataFrame, adjacency: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paths of ``shortest_paths``, searched cell by cell with an index of cells and component labels.

    ``shortest_paths`` shuffles and writes every node that a request has seen in every round; here only entries into cells and paths are written.
    """
    return indexed_paths(starts, ends, build_road_index(adjacency, nodes, landmarks=0))


def _arrivals(state: DataFrame, ends: DataFrame) -> DataFrame:
    links = ends.select("query_id", "node", F.col("cost").alias("_last"), "edge_id")
    return state.join(links, ["query_id", "node"]).select(
        "query_id", "node", "edge_id", (F.col("cost") + F.col("_last")).alias("cost")
    )


def trace_paths(found: DataFrame, state: DataFrame, unroll: int = 8) -> DataFrame:
    """Steps (query_id, step_no, edge_id, node) of every path in travel order, the last one to ``END_NODE``.

    Walks all paths back in parallel, ``unroll`` joins per written table. A path has at most as many steps as its
    request has nodes; a longer walk means that the state has a circle, which is an error.
    """
    most = state.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    links = state.select("query_id", F.col("node").alias("_at"), "pred", "pred_edge")
    steps = found.select("query_id", F.lit(0).alias("back"), "edge_id", F.lit(END_NODE).cast("bigint").alias("node"), F.col("node").alias("_at"))
    written, walking = [], materialize(steps)
    while True:
        written.append(walking.drop("_at"))
        tail = []
        current = walking if len(written) == 1 else walking.where(F.col("back") == F.lit((len(written) - 1) * unroll))
        for _ in range(unroll):
            current = current.where(F.col("_at") != START_NODE).join(links, ["query_id", "_at"]).select(
                "query_id", (F.col("back") + 1).alias("back"), F.col("pred_edge").alias("edge_id"),
                F.col("_at").alias("node"), F.col("pred").alias("_at"),
            )
            tail.append(current)
        block = tail[0]
        for part in tail[1:]:
            block = block.unionByName(part)
        walking = materialize(block)
        if walking.isEmpty():
            break
        if (len(written) - 1) * unroll > most:
            raise RuntimeError("a path goes in a circle")
    all_steps = written[0]
    for part in written[1:]:
        all_steps = all_steps.unionByName(part)
    length = all_steps.groupBy("query_id").agg(F.max("back").alias("_n"))
    return all_steps.join(length, "query_id").select(
        "query_id", (F.col("_n") - F.col("back")).alias("step_no"), "edge_id", "node"
    )


def _segment_of(coords: Column, spot: Column) -> Column:
    """Index of the first segment nearest to ``spot``."""
    options = F.transform(F.sequence(F.lit(0), F.size(coords) - 2), lambda i: F.struct(
        project_to_segment(
            spot["lng"], spot["lat"], F.get(coords, i)["lng"], F.get(coords, i)["lat"], F.get(coords, i + 1)["lng"], F.get(coords, i + 1)["lat"]
        )["d2"].alias("d2"), i.alias("i")))
    return F.array_min(options)["i"]


def _toward(coords: Column, spot: Column, to_first: Column) -> Column:
    """Line from ``spot`` along the edge to its first or last point."""
    at = _segment_of(coords, spot)
    back = F.reverse(F.slice(coords, F.lit(1), at + 1))
    ahead = F.slice(coords, at + 2, F.greatest(F.size(coords) - at - 1, F.lit(0)))
    return F.concat(F.array(spot), F.when(to_first, back).otherwise(ahead))


def assemble_routes(snapped: DataFrame, steps: DataFrame, ways: DataFrame, oriented: bool = True) -> DataFrame:
    """Features (query_id, feature_no, kind, edge_id, name, length_m, coords) of every found route.

    Connectors from and to the asked points are ``virtual``; the first and last edge are cut at the
    projections, their ``length_m`` stays that of the whole edge. Both ends on one edge give three straight
    lines, whatever the direction. ``oriented`` turns every edge into travel direction.
    """
    spot = {
        k: F.struct(F.col(f"{k}_lng").alias("lng"), F.col(f"{k}_lat").alias("lat")) for k in ("start", "start_proj", "end", "end_proj")
    }
    ends = snapped.select("query_id", *[v.alias(k) for k, v in spot.items()], (F.col("start_edge_id") == F.col("end_edge_id")).alias("same"), "start_edge_id")
    order = Window.partitionBy("query_id").orderBy("step_no")
    walked = steps.withColumns({
        "_from": F.lag("node").over(order), "_last": F.lead("step_no").over(order).isNull(),
    })
    edge = ways.select(F.col("gid").alias("edge_id"), "source", "target", "name", F.col("length_m").cast("double").alias("length_m"), "coords")
    walked = walked.join(edge, "edge_id").join(ends.drop("start_edge_id"), "query_id").where(~F.col("same"))
    head = _toward(F.col("coords"), F.col("start_proj"), F.col("source") == F.col("node"))
    tail = _toward(F.col("coords"), F.col("end_proj"), F.col("source") == F.col("_from"))
    through = F.when((F.col("target") == F.col("node")) | F.lit(not oriented), F.col("coords")).otherwise(F.reverse("coords"))
    line = F.when(F.col("step_no") == 0, head).when(F.col("_last"), F.reverse(tail) if oriented else tail).otherwise(through)
    roads = walked.select(
        "query_id", (F.col("step_no") + 1).cast("int").alias("feature_no"), F.lit("road").alias("kind"), "edge_id",
        F.coalesce("name", F.lit(NO_NAME)).alias("name"), "length_m", line.alias("coords"),
    )
    none = {"name": F.lit(None).cast("string"), "length_m": F.lit(None).cast("double")}

    def feature(no: Column, kind: str, edge_id: Column, *points: str) -> Column:
        return F.struct(
            no.cast("int").alias("feature_no"), F.lit(kind).alias("kind"), edge_id.cast("bigint").alias("edge_id"),
            *[v.alias(k) for k, v in none.items()], F.array(*[F.col(p) for p in points]).alias("coords"),
        )

    null = F.lit(None)
    counts = steps.groupBy("query_id").agg((F.max("step_no") + 2).alias("_n"))
    normal = ends.where(~F.col("same")).join(counts, "query_id").select("query_id", F.inline(F.array(
        feature(F.lit(0), "virtual", null, "start", "start_proj"), feature(F.col("_n"), "virtual", null, "end_proj", "end"))))
    short = ends.where("same").select("query_id", F.inline(F.array(
        feature(F.lit(0), "virtual", null, "start", "start_proj"),
        feature(F.lit(1), "road", F.col("start_edge_id"), "start_proj", "end_proj"),
        feature(F.lit(2), "virtual", null, "end_proj", "end"))))
    return roads.unionByName(normal).unionByName(short)


def route_all(requests: DataFrame, ways: DataFrame, ratio: str = "segment", index: RoadIndex | None = None) -> DataFrame:
    """Features of the routes of all requests; unreachable ones have none.

    ``ratio='segment'`` uses the position within the snapped segment as a share of the whole edge;
    ``ratio='edge'`` uses the true share of the edge. Requests are searched cell by cell; without an ``index`` of these ways one without landmarks is built, and one with landmarks pays
    where routes are long or it is used again.
    """
    snapped = materialize(snap_requests(requests, ways))
    if ratio == "edge":
        snapped = materialize(_edge_ratio(snapped, ways))
    starts, ends = virtual_links(snapped.where("start_edge_id <> end_edge_id"), ways)
    found, state = indexed_paths(starts, ends, index) if index else cheapest_paths(starts, ends, *build_road_graph(ways))
    return assemble_routes(snapped, trace_paths(found, state), ways)


def route_legs(stops: DataFrame) -> DataFrame:
    """Requests of multi-stop routes: stops (route_id, stop_no, lng, lat) to one request per leg."""
    order = Window.partitionBy("route_id").orderBy("stop_no")
    legs = stops.withColumns({"end_lng": F.lead("lng").over(order), "end_lat": F.lead("lat").over(order), "leg_no": F.row_number().over(order) - 1})
    return legs.where("end_lng is not null").select(
        "route_id", "leg_no", F.concat_ws("/", F.col("route_id").cast("string"), F.col("leg_no").cast("string")).alias("query_id"),
        F.col("lng").alias("start_lng"), F.col("lat").alias("start_lat"), "end_lng", "end_lat",
    )


def leg_steps(legs: DataFrame, features: DataFrame, stop_names: DataFrame) -> DataFrame:
    """Steps of whole routes: the road features of every leg, each leg closed by its stop.

    ``stop_names`` is (route_id, leg_no, stop_name, last).
    """
    roads = features.where("kind = 'road' and size(coords) >= 2").join(legs.select("route_id", "leg_no", "query_id"), "query_id").select(
        "route_id", "leg_no", F.col("feature_no").alias("part_no"), F.lit("road").alias("kind"),
        F.coalesce("name", F.lit("Đường không tên")).alias("name"), F.coalesce("length_m", F.lit(0.0)).alias("length_m"), "coords",
    )
    stops = stop_names.select(
        "route_id", "leg_no", F.lit((1 << 31) - 1).alias("part_no"), F.when(F.col("last"), "destination").otherwise("waypoint").alias("kind"),
        F.col("stop_name").alias("name"), F.lit(0.0).alias("length_m"), F.array().cast("array<struct<lng:double,lat:double>>").alias("coords"),
    )
    order = Window.partitionBy("route_id").orderBy("leg_no", "part_no")
    return roads.unionByName(stops).withColumn("step_no", F.row_number().over(order)).drop("leg_no", "part_no")


def turn_by_turn(steps: DataFrame) -> DataFrame:
    """Merge consecutive steps with one name and add the turn into each group.

    ``steps`` is (route_id, step_no, kind, name, length_m, coords), kind road, waypoint or destination. Stops
    stay alone and break a group. Group number, summed length, joined coords, turn.
    """
    order = Window.partitionBy("route_id").orderBy("step_no")
    was = {c: F.lag(c).over(order) for c in ("kind", "name", "coords")}
    joins = (F.col("kind") == "road") & (was["kind"] == "road") & was["name"].eqNullSafe(F.col("name"))
    p, q = was["coords"], F.col("coords")
    from_a, from_b, to_a, to_b = F.try_element_at(p, F.lit(-2)), F.try_element_at(p, F.lit(-1)), F.get(q, F.lit(0)), F.get(q, F.lit(1))
    # Bearings are columns of their own, so that the turn class does not repeat their trigonometry.
    marked = steps.withColumns({
        "_new": (~F.coalesce(joins, F.lit(False))).cast("int"), "_was": was["kind"],
        "_bent": (F.size(p) >= 2) & (F.size(q) >= 2),
        "_in": bearing(from_a["lng"], from_a["lat"], from_b["lng"], from_b["lat"]),
        "_out": bearing(to_a["lng"], to_a["lat"], to_b["lng"], to_b["lat"]),
    })
    marked = marked.withColumn(
        "turn",
        F.when(F.col("kind") != "road", F.col("kind"))
        .when(F.col("_was").isNull(), "start")
        .when((F.col("_was") != "road") | ~F.col("_bent"), "straight")
        .otherwise(turn_type(F.col("_in"), F.col("_out"))),
    )
    marked = marked.withColumn("group_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    grouped = marked.groupBy("route_id", "group_no").agg(
        F.min_by(F.struct("kind", "name", "turn"), "step_no").alias("f"), F.sum("length_m").alias("length_m"),
        F.array_sort(F.collect_list(F.struct("step_no", "coords"))).alias("_c"),
    )
    return grouped.select(
        "route_id", "group_no", "f.kind", "f.name", "f.turn", "length_m", F.flatten(F.transform("_c", lambda x: x["coords"])).alias("coords")
    )


def route_length(steps: DataFrame) -> DataFrame:
    """Total metres per route."""
    return steps.groupBy("route_id").agg(F.sum("length_m").alias("length_m"))
