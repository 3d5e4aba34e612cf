"""Exact k-nearest join by descending a grid of occupied cells; only equi-joins.

Every round replaces a query's candidate cells by their occupied children (8 times smaller) and drops the cells
that cannot hold one of the ``k`` nearest items: their least distance is larger than a distance within which
``k`` items are certain. A query therefore meets the items of a few smallest cells only, however far away they
are and however many items exist. The work per query is bounded by the number of children of a few cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.tables import by_shuffle, materialize, materialize_split

_SPLIT = 8  # children per axis and round
_ROUNDS = 6
_FEW_CELLS = 100_000  # of a level that may be broadcast, about 10 MB in memory


def unit_sphere(lng: Column, lat: Column) -> dict[str, Column]:
    """Coordinates whose straight-line order is the great-circle order."""
    return {
        "x": F.cos(F.radians(lat)) * F.cos(F.radians(lng)),
        "y": F.cos(F.radians(lat)) * F.sin(F.radians(lng)),
        "z": F.sin(F.radians(lat)),
    }


def cell_columns(axes: list[str], low: float, span: float, rounds: int = _ROUNDS) -> dict[str, Column]:
    """Columns ``_c0``, ``_c1`` .. with the smallest cell of a row, after ``rounds`` splits of the range."""
    finest = span / _SPLIT**rounds
    return {f"_c{i}": F.floor((F.col(a) - low) / finest).cast("long") for i, a in enumerate(axes)}


def nearest_candidates(
    queries: DataFrame,
    items: DataFrame,
    query_id: str,
    axes: list[str],
    low: float,
    span: float,
    k: int = 1,
    key: list[str] | None = None,
    slack: float = 0.0,
) -> DataFrame:
    """Rows (query_id, item columns) that contain the ``k`` nearest items of every query.

    ``queries`` and ``items`` carry the ``axes`` (within ``low`` .. ``low + span``) and the ``key`` columns;
    only items with the same key are considered. ``slack`` widens every bound, for items that stand for
    something up to ``slack`` away from their position. The caller ranks the rows by its own distance.
    """
    key = key or []
    cells = [f"_c{i}" for i in range(len(axes))]
    placed = materialize(items.withColumns(cell_columns(axes, low, span)))
    occupied = placed.groupBy(*key, *cells).agg(F.count("*").alias("_n"))
    chosen = nearest_cells(queries, occupied, query_id, axes, low, span, k, key, slack)
    return chosen.join(by_shuffle(placed.drop(*axes)), [*key, *cells]).drop(*cells)


def nearest_cells(
    queries: DataFrame,
    occupied: DataFrame,
    query_id: str,
    axes: list[str],
    low: float,
    span: float,
    k: int = 1,
    key: list[str] | None = None,
    slack: float = 0.0,
    rounds: int = _ROUNDS,
) -> DataFrame:
    """Rows (query_id, key, _c0, _c1 ..): the smallest cells that can hold one of a query's ``k`` nearest items.

    ``occupied`` has the cells of ``cell_columns`` with the number ``_n`` of items in each; the items themselves are not needed.
    """
    key = key or []
    cells = [f"_c{i}" for i in range(len(axes))]
    tolerance = slack + span * 1e-9

    queries = materialize(queries.select(query_id, *key, *axes))
    # The occupied cells of all levels, counted in one pass and written per level: their true sizes let the
    # planner broadcast a level while it is small, and their numbers say how long it may.
    at_level = F.struct(F.col("_up").alias("_level"), *[
        F.floor(F.col(c) / F.pow(F.lit(float(_SPLIT)), F.lit(rounds) - F.col("_up"))).cast("long").alias(c) for c in cells
    ])
    spread = occupied.withColumn("_up", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).select(*key, "_n", at_level.alias("_at"))
    counted = spread.groupBy(*key, "_at").agg(F.sum("_n").alias("_n")).select(*key, "_at.*", "_n")
    levels = materialize_split(counted, "_level", list(range(1, rounds + 1)))

    # One shuffle by query; while the cells are broadcast, the windows of all rounds reuse it.
    root = [F.least(F.floor((F.col(a) - low) / span).cast("long"), F.lit(0)).alias(f"_p{i}") for i, a in enumerate(axes)]
    frontier = queries.repartition(query_id).select(query_id, *key, *axes, *root)
    for level in range(1, rounds + 1):
        size = span / _SPLIT**level
        children = levels[level].withColumns(
            {f"_p{i}": F.floor(F.col(c) / _SPLIT).cast("long") for i, c in enumerate(cells)}
        )
        if level == 1:  # the upper edge of the range falls into a cell of its own
            children = children.withColumns({f"_p{i}": F.lit(0).cast("long") for i in range(len(axes))})
        if not key and level <= 2:
            # At most 9 ** axes cells at level 1 and 65 ** axes (sphere: its surface only) at level 2.
            children = F.broadcast(children)
        elif levels[level].count() > _FEW_CELLS:  # their files can be a hundredth of what they take in memory
            children = by_shuffle(children)
        joined = frontier.join(children, [*key, *[f"_p{i}" for i in range(len(axes))]])
        below = [F.greatest(F.lit(0.0), F.col(c) * size + low - F.col(a), F.col(a) - (F.col(c) + 1) * size - low) for c, a in zip(cells, axes)]
        above = [F.greatest(F.abs(F.col(a) - F.col(c) * size - low), F.abs((F.col(c) + 1) * size + low - F.col(a))) for c, a in zip(cells, axes)]
        least = F.sqrt(reduce(lambda s, d: s + d, [d * d for d in below]))
        most = F.sqrt(reduce(lambda s, d: s + d, [d * d for d in above]))
        bounded = joined.withColumns({"_least": least, "_most": most})
        whole = Window.partitionBy(query_id)
        if k == 1:
            certain = F.min("_most").over(whole)
        else:
            running = Window.partitionBy(query_id).orderBy("_most").rowsBetween(Window.unboundedPreceding, 0)
            bounded = bounded.withColumn("_within", F.sum("_n").over(running))
            certain = F.min(F.when(F.col("_within") >= k, F.col("_most"))).over(whole)
        bounded = bounded.withColumn("_certain", F.coalesce(certain, F.lit(float("inf"))))
        kept = bounded.where(F.col("_least") <= F.col("_certain") + tolerance)
        frontier = kept.select(query_id, *key, *axes, *[F.col(c).alias(f"_p{i}") for i, c in enumerate(cells)])

    return frontier.select(query_id, *key, *[F.col(f"_p{i}").alias(c) for i, c in enumerate(cells)])
