"""Radius joins, snapping points to road edges, point-in-polygon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geo import haversine_m, project_to_segment
from placewise.operators.nearest import nearest_candidates
from placewise.tables import by_shuffle, materialize, shuffle_width

_METRES_PER_DEGREE = 111000.0  # a little less than the true value, so cells are a little too large
_HOT_CELL = 500
_MOST_TILES = 12  # a row is written once for each tile it meets, so what is shuffled grows with the rows and not with their square


def _row_height(radius: float) -> float:
    return radius / _METRES_PER_DEGREE


def _lng_reach(radius: float, lat: Column) -> Column:
    """Degrees of longitude that ``radius`` can span at a latitude."""
    return F.lit(_row_height(radius)) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.9))))


def _cell_width(radius: float, row: Column) -> Column:
    height = _row_height(radius)
    return _lng_reach(radius, F.greatest(F.abs(row * height), F.abs((row + 1) * height)))


def _tiles(rows: Column, hot_cell: int) -> Column:
    """The number of tile rows (or columns) for so many rows of a side in one cell."""
    return F.least(F.ceil(rows / hot_cell).cast("long"), F.lit(_MOST_TILES).cast("long"))


def radius_join(
    left: DataFrame, right: DataFrame, radius: float, self_id: str | None = None, hot_cell: int = _HOT_CELL,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All pairs within ``radius`` metres: ``l_*`` and ``r_*`` columns and ``distance``.

    Both sides need ``lng`` and ``lat``. With ``self_id`` the sides are the same table and each pair appears
    once, smaller id on the left. Cells are at least ``radius`` high and wide, so a point meets the 3 rows of
    cells around it. A cell that more than ``hot_cell`` rows of either side meet is cut into tiles: its left and right rows are spread over
    tile rows and columns, so a tile has about ``hot_cell`` rows of each side, or a 12th of the cell's if that is more. (A stream on the left cannot be counted; then right rows alone decide.)
    ``keep`` is a filter of the caller's on neighbouring cells' pairs, cheaper than a distance and therefore taken before it.
    """
    height = _row_height(radius)
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).where("l_lng is not null and l_lat is not null")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where("r_lng is not null and r_lat is not null")

    r = r.withColumn("_row", F.floor(F.col("r_lat") / height).cast("long"))
    r = r.withColumn("_col", F.floor(F.col("r_lng") / _cell_width(radius, F.col("_row"))).cast("long"))
    own_row = F.floor(F.col("l_lat") / height).cast("long")

    def around(points: DataFrame) -> DataFrame:
        points = points.withColumn("_row", F.explode(F.sequence(own_row - 1, own_row + 1)))
        width, reach = _cell_width(radius, F.col("_row")), _lng_reach(radius, F.abs(F.col("l_lat")) + height)
        return points.withColumn("_col", F.explode(F.sequence(
            F.floor((F.col("l_lng") - reach) / width).cast("long"), F.floor((F.col("l_lng") + reach) / width).cast("long")
        )))

    def hot(rows: DataFrame, tiles: str) -> DataFrame:
        counted = rows.groupBy("_row", "_col").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_cell)
        return counted.select("_row", "_col", _tiles(F.col("_n"), hot_cell).alias(tiles))

    tiles = {"_tr_n": hot(r, "_tr_n")}
    if not left.isStreaming:
        tiles["_tl_n"] = hot(around(l.select("l_lng", "l_lat")), "_tl_n")
    l = around(l)

    def tiled(side: DataFrame, prefix: str, own: str, other: str) -> DataFrame:
        for counts in tiles.values():
            side = side.join(by_shuffle(counts), ["_row", "_col"], "left")
        counts = {n: F.coalesce(n, F.lit(1)) if n in tiles else F.lit(1).cast("long") for n in ("_tl_n", "_tr_n")}
        mark = F.xxhash64(*[c for c in side.columns if c.startswith(prefix)])
        return side.withColumns({
            own: F.pmod(mark, counts[f"{own}_n"]), other: F.explode(F.sequence(F.lit(0).cast("long"), counts[f"{other}_n"] - 1)),
        }).drop(*tiles)

    # Rows are few bytes but pairs are scored later, so the join keeps all its partitions; tiles bound what one key can hold.
    keys = ["_row", "_col", "_tl", "_tr"]
    parts = shuffle_width(left.sparkSession)
    sides = [side.repartition(parts, *keys) for side in (tiled(l, "l_", "_tl", "_tr"), tiled(r, "r_", "_tr", "_tl"))]
    pairs = sides[0].join(by_shuffle(sides[1]), keys)
    if self_id:
        pairs = pairs.where(F.col(f"l_{self_id}") < F.col(f"r_{self_id}"))
    if keep:
        pairs = keep(pairs)
    pairs = pairs.withColumn("distance", haversine_m(F.col("l_lng"), F.col("l_lat"), F.col("r_lng"), F.col("r_lat")))
    return pairs.where(F.col("distance") <= radius).drop(*keys)


def _segments(ways: DataFrame) -> DataFrame:
    """(gid, seg, ax, ay, bx, by) of every segment of every edge."""
    last = F.size("coords") - 1
    seg = F.when(last >= 1, F.sequence(F.lit(0), last - 1))
    a, b = F.get("coords", F.col("seg")), F.get("coords", F.col("seg") + 1)
    return ways.select("gid", "coords", F.explode(seg).alias("seg")).select(
        "gid", "seg", a["lng"].alias("ax"), a["lat"].alias("ay"), b["lng"].alias("bx"), b["lat"].alias("by")
    )


def _best_projection(candidates: DataFrame, points: DataFrame, reach: float | None = None) -> DataFrame:
    """Least squared distance per point, ``reach`` at most; ties go to the smallest (gid, seg)."""
    at = project_to_segment(*[F.col(c) for c in ("lng", "lat", "ax", "ay", "bx", "by")])
    if "lng" not in candidates.columns:
        candidates = candidates.join(by_shuffle(points.select("point_id", "lng", "lat")), "point_id")
    scored = candidates.withColumn("_p", at)
    if reach is not None:
        scored = scored.where(F.col("_p.d2") <= reach * reach)
    best = scored.groupBy("point_id").agg(
        F.min(F.struct(F.col("_p.d2").alias("d2"), "gid", "seg", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), F.col("_p.t").alias("t"))).alias("b")
    )
    return best.select(
        "point_id", F.col("b.gid").alias("edge_id"), F.col("b.seg").alias("seg"), F.col("b.x").alias("proj_lng"),
        F.col("b.y").alias("proj_lat"), F.col("b.t").alias("ratio"), F.col("b.d2").alias("d2"),
    )


def snap_to_edges(points: DataFrame, ways: DataFrame, piece: float = 0.001) -> DataFrame:
    """Nearest road edge of every point (point_id, lng, lat), planar squared degrees.

    Segments are cut into pieces of at most ``piece`` degrees. A piece is listed in the cells that its box, widened by
    half a piece, meets; a point meets the pieces of its own cell, and a segment found within half a piece is surely the
    nearest. Points without one take the exact nearest join, equal ones once: the nearest pieces by midpoint, widened by
    half a piece, hold the nearest segment. ``ratio`` is the position within the winning segment.
    """
    # Spread first: a few compressed files hold many rows, and every row becomes many.
    segments = materialize(_segments(ways).repartition(shuffle_width(ways.sparkSession), "gid"))
    reach = piece / 2
    home = {"_x": F.floor(F.col("lng") / piece).cast("long"), "_y": F.floor(F.col("lat") / piece).cast("long")}
    listed = segments.withColumn("_at", F.explode(_cells_near(piece, reach))).select("gid", "seg", "ax", "ay", "bx", "by", "_at._x", "_at._y")
    asked = points.select("point_id", "lng", "lat").withColumns(home)
    # What is out of reach goes before the grouping, which sorts its rows.
    near = materialize(_best_projection(asked.join(by_shuffle(listed), ["_x", "_y"]).drop("_x", "_y"), points, reach))
    rest = materialize(points.select("point_id", "lng", "lat").join(by_shuffle(near.select("point_id")), "point_id", "left_anti"))
    if rest.isEmpty():
        return near
    spots = materialize(rest.groupBy("lng", "lat").agg(F.min("point_id").alias("point_id")))
    pieces = segments.withColumn("_m", F.explode(_midpoints(piece))).select(*segments.columns, "_m.mx", "_m.my")
    # Written before the next step, so that no task holds the sorts of the search and of the grouping together.
    candidates = materialize(nearest_candidates(
        spots.select("point_id", F.col("lng").alias("mx"), F.col("lat").alias("my")), pieces, "point_id", ["mx", "my"], low=-180.0, span=360.0, slack=piece * _HALF_DIAGONAL
    ).select("point_id", *segments.columns).distinct())
    best = materialize(_best_projection(candidates, spots))
    at_spot = spots.join(by_shuffle(best), "point_id").drop("point_id")
    far = materialize(rest.join(by_shuffle(at_spot), ["lng", "lat"]).select(*near.columns))
    return near.unionByName(far)


_HALF_DIAGONAL = 0.7072  # a little more than half the diagonal of the unit square


def _pieces(piece: float) -> Column:
    """The number of pieces of at most ``piece`` degrees that a segment (ax, ay, bx, by) is cut into."""
    return F.greatest(
        F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / piece).cast("long"), F.lit(1)
    )


def _midpoints(piece: float) -> Column:
    """The midpoints (mx, my) of the pieces of a segment."""
    count = _pieces(piece)
    shares = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: (i + 0.5) / count)
    return F.transform(shares, lambda share: F.struct(
        (F.col("ax") + share * (F.col("bx") - F.col("ax"))).alias("mx"), (F.col("ay") + share * (F.col("by") - F.col("ay"))).alias("my")))


def _cells_near(piece: float, reach: float) -> Column:
    """The distinct cells (_x, _y) of ``piece`` degrees that hold all points within ``reach`` of a segment.

    They are made distinct in the segment's own row, so nothing is kept over rows.
    """
    count, reach = _pieces(piece), reach + 1e-9  # more than coordinates lose by rounding

    def span(i: Column, a: str, b: str) -> Column:
        ends = [F.col(a) + (i + n) / count * (F.col(b) - F.col(a)) for n in (0, 1)]
        return F.sequence(F.floor((F.least(*ends) - reach) / piece).cast("long"), F.floor((F.greatest(*ends) + reach) / piece).cast("long"))

    def cells(i: Column) -> Column:
        return F.flatten(F.transform(span(i, "ax", "bx"), lambda x: F.transform(span(i, "ay", "by"), lambda y: F.struct(x.alias("_x"), y.alias("_y")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), cells)))


def snap_within(points: DataFrame, ways: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Nearest edge among those whose bounding box meets the point's +-``tolerance`` box; if there is none,
    the nearest of all.

    An edge is listed at the grid level whose cells are as large as its box, so in at most 4 cells; a point
    looks at every level.
    """
    levels = [tolerance * 4**i for i in range(10)]
    ways = materialize(ways.select("gid", "coords").repartition(shuffle_width(ways.sparkSession), "gid"))
    boxed = ways.select(
        "gid", "coords",
        *[f(F.col("coords")[n]).alias(f"{k}_{n}") for n in ("lng", "lat") for k, f in (("lo", F.array_min), ("hi", F.array_max))],
    )
    extent = F.greatest(F.col("hi_lng") - F.col("lo_lng"), F.col("hi_lat") - F.col("lo_lat"))
    level = F.coalesce(*[F.when(extent <= size, F.lit(i)) for i, size in enumerate(levels)])
    size = F.lit(tolerance) * F.pow(F.lit(4.0), F.col("_level"))

    def covering(df: DataFrame, lo: dict[str, Column], hi: dict[str, Column]) -> DataFrame:
        for n in ("lng", "lat"):
            df = df.withColumn(f"_{n}", F.explode(F.sequence(F.floor(lo[n] / size).cast("long"), F.floor(hi[n] / size).cast("long"))))
        return df

    axes = ("lng", "lat")
    listed = covering(
        boxed.withColumn("_level", level), {n: F.col(f"lo_{n}") for n in axes}, {n: F.col(f"hi_{n}") for n in axes}
    ).drop("coords")
    looking = covering(
        points.select("point_id", "lng", "lat", F.explode(F.array(*[F.lit(i) for i in range(len(levels))])).alias("_level")),
        {n: F.col(n) - tolerance for n in axes}, {n: F.col(n) + tolerance for n in axes},
    )
    near = looking.join(by_shuffle(listed), ["_level", "_lng", "_lat"]).where(
        (F.col("lo_lng") <= F.col("lng") + tolerance) & (F.col("hi_lng") >= F.col("lng") - tolerance)
        & (F.col("lo_lat") <= F.col("lat") + tolerance) & (F.col("hi_lat") >= F.col("lat") - tolerance)
    ).select("point_id", "gid").distinct()
    found = materialize(_best_projection(near.join(by_shuffle(_segments(ways)), "gid"), points))
    rest = materialize(points.join(by_shuffle(found.select("point_id")), "point_id", "left_anti"))
    return found if rest.isEmpty() else found.unionByName(snap_to_edges(rest, ways))


def clip_to_ring(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points (lng, lat) inside a closed ring of (lng, lat) corners, by ray casting.

    The ring is one boundary, so its edges are literals in a single expression; no join is needed. A ring without corners holds nothing.
    """
    if not ring:
        return points.limit(0)
    edges = F.array(*[
        F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a, *b))])
        for a, b in zip(ring, [*ring[1:], ring[0]]) if a != b
    ])
    x, y = F.col("lng"), F.col("lat")

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (
            x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        )

    inside = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    # The ring's own box as a plain filter first, so that a scan can skip files.
    boxed = points.where(x.between(min(p[0] for p in ring), max(p[0] for p in ring)) & y.between(min(p[1] for p in ring), max(p[1] for p in ring)))
    return boxed.where(inside)
