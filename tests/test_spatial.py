import math
import random
import time

import pytest
from pyspark.sql import functions as F

from catalog.views import view
from placewise.functions.geo import haversine_m
from placewise.operators.nearest import nearest_candidates, unit_sphere
from placewise.operators.spatial import _tiles, clip_to_ring, radius_join, snap_to_edges, snap_within
from placewise.operators.substring import contains_join
from placewise.functions.text import name_profile, score_bound, shared_parts, similarity, weighted_score
from placewise.plans.dedupe import candidate_pairs, check_duplicates, find_duplicate_pairs, overall_decisions, place_members, places
from placewise.tables import materialize
from tests.conftest import SMALL


def metres(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("hot_cell, lat", [(20000, 10.0), (7, 10.0), (3, -65.0)])
def test_radius_join_with_a_hot_point(spark, hot_cell, lat):
    rng = random.Random(5)
    points = [(i, 105.7 + rng.random() * 0.002, lat + rng.random() * 0.002) for i in range(300)]
    points += [(1000 + i, 105.7005, lat + 0.0005 + rng.random() * 1e-5) for i in range(150)]  # a third on one spot
    df = spark.createDataFrame(points, "id long, lng double, lat double")
    got = {(r.l_id, r.r_id) for r in radius_join(df, df, 15.0, self_id="id", hot_cell=hot_cell).collect()}
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and metres(a[1:], b[1:]) <= 15}
    assert got == want


def test_no_nested_loop_in_radius_join(spark):
    df = view(spark, SMALL, "stores").select("id", "lng", "lat")
    plan = spark._jvm.PythonSQLUtils.explainString(radius_join(df, df, 15.0, self_id="id")._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_on_the_sphere(spark, k):
    rng = random.Random(k)
    items = [(i, "ab"[i % 2], rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(200)]
    items += [(500 + i, "a", 105.7 + rng.random() * 0.01, 10 + rng.random() * 0.01) for i in range(200)]
    asked = [(i, "ab"[i % 2], rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(40)] + [(99, "a", 105.705, 10.005), (100, "a", 0.0, 90.0)]
    schema = "n long, key string, lng double, lat double"
    left = spark.createDataFrame(asked, schema).withColumns(unit_sphere(F.col("lng"), F.col("lat")))
    right = spark.createDataFrame(items, schema).withColumns(unit_sphere(F.col("lng"), F.col("lat"))).withColumnsRenamed({"n": "item", "lng": "i_lng", "lat": "i_lat"})
    found = nearest_candidates(left, right, "n", ["x", "y", "z"], -1.0, 2.0, k=k, key=["key"]).drop("key")
    got = {}
    for r in found.join(left.select("n", "lng", "lat"), "n").collect():
        got.setdefault(r.n, []).append((metres((r.lng, r.lat), (r.i_lng, r.i_lat)), r.item))
    for n, key, lng, lat in asked:
        want = sorted((metres((lng, lat), i[2:]), i[0]) for i in items if i[1] == key)[:k]
        assert [x[1] for x in sorted(got[n])[:k]] == [x[1] for x in want]


def line(*coords):
    return [{"lng": float(x), "lat": float(y)} for x, y in coords]


def brute_snap(point, ways):
    best = None
    for gid, coords in ways:
        for seg in range(len(coords) - 1):
            (ax, ay), (bx, by) = coords[seg], coords[seg + 1]
            dx, dy = bx - ax, by - ay
            t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((point[0] - ax) * dx + (point[1] - ay) * dy) / (dx * dx + dy * dy)))
            d = (point[0] - ax - t * dx) ** 2 + (point[1] - ay - t * dy) ** 2
            if best is None or d < best[0] - 1e-18:
                best = (d, gid)
    return best


def test_snap_matches_brute_force(spark):
    rng = random.Random(11)
    ways = [(g, [(105.7 + rng.random() * 0.1, 10 + rng.random() * 0.1)]) for g in range(1, 80)]
    for g, coords in ways:
        for _ in range(rng.randint(1, 4)):
            coords.append((coords[-1][0] + rng.uniform(-0.01, 0.01), coords[-1][1] + rng.uniform(-0.01, 0.01)))
    points = [(i, 105.7 + rng.random() * 0.1, 10 + rng.random() * 0.1) for i in range(60)] + [(100, 20.0, 50.0), (101, -70.0, -33.0), (102, 106.5, 9.0)]
    w = spark.createDataFrame([(g, line(*c)) for g, c in ways], "gid long, coords array<struct<lng:double,lat:double>>")
    p = spark.createDataFrame(points, "point_id long, lng double, lat double")
    got = {r.point_id: (r.d2, r.edge_id) for r in snap_to_edges(p, w).collect()}
    inside = {r.point_id: (r.d2, r.edge_id) for r in snap_within(p, w).collect()}
    assert set(got) == set(inside) == {q[0] for q in points}
    for n, x, y in points:
        want = brute_snap((x, y), ways)
        assert got[n][1] == want[1] and math.isclose(got[n][0], want[0], rel_tol=1e-6, abs_tol=1e-15)
        assert inside[n][0] >= want[0] - 1e-12


def test_contains_join(spark):
    texts = ["cà phê sữa", "ab", "a", "xin chào", "", "phê"]
    needles = ["phê", "a", "ab", "à", "chào", "zzz", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    got = {(r.n, r.i) for r in contains_join(n, t, "n", "t").collect()}
    assert got == {(x, i) for x in needles if x for i, y in enumerate(texts) if x in y}


def test_ring(spark):
    points = spark.createDataFrame([(1, 0.4, 0.5), (2, 1.5, 0.5), (3, 0.5, -0.1), (4, 0.9, 0.95), (5, 0.9, 0.5)], "id int, lng double, lat double")
    triangle = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert {r.id for r in clip_to_ring(points, triangle).collect()} == {5}


def test_copies_are_one_place(spark):
    rows = [(i, "Phở 24", 105.7, 10.0) for i in range(50)] + [(100, "PHO 24h", 105.7, 10.00001), (200, "PHỞ 24", 105.8, 10.0), (300, " ", 105.7, 10.0)]
    stores = spark.createDataFrame(rows, "id long, name string, lng double, lat double")
    pairs = find_duplicate_pairs(stores).collect()
    assert [(p.place_a, p.place_b, p.copies_a, p.decision) for p in pairs] == [(0, 100, 50, "reject")]
    members = {r.id: r.place_id for r in place_members(stores).collect()}
    assert members[49] == 0 and members[200] == 200
    asked = spark.createDataFrame([(1, "pho 24", 105.7, 10.0), (2, "", 105.7, 10.0), (3, "pho 24", None, None), (4, "xyz", 105.7, 10.0)], "candidate_id long, name string, lng double, lat double")
    matches = check_duplicates(asked, stores)
    assert [(r.store_id, r.copies, r["rank"]) for r in matches.where("candidate_id = 1").orderBy("rank").collect()] == [(0, 50, 1), (100, 1, 2), (300, 1, 3)]
    verdicts = {r.candidate_id: r.decision for r in overall_decisions(asked, matches).collect()}
    assert verdicts == {1: "reject", 2: "accept", 3: "accept", 4: "accept"}


def test_haversine_degenerate(spark):
    row = spark.range(1).select(haversine_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))).first()
    assert row[0] == 0.0


def _names(n, seed):
    """Names of few letters and words, so that many are alike; runs of one letter, repeated words, one-letter names and blank ones too."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeo1") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["aaaaaaaaaa", "quan", "b"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n - 6)]
    return [*names, "quan quan quan quan", "aaaaaaaa aaaaaaaa", "b", " - ", None, "Quán Quan"]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.88])
def test_bound_loses_no_similar_pair(spark, least):
    """All pairs of names on one spot: a bound is never below the score, and few of the other pairs are scored."""
    stores = spark.createDataFrame([(i, name, 105.7, 10.0) for i, name in enumerate(_names(250, 2))], "id long, name string, lng double, lat double")
    want = {(r.place_a, r.place_b): r.score for r in find_duplicate_pairs(stores).collect() if r.score >= least}
    got = find_duplicate_pairs(stores, least=least).collect()
    assert {(r.place_a, r.place_b): r.score for r in got} == want and len(got) == len(want) > 20
    profiles = places(stores).where("norm <> ''").select("place_id", "norm", name_profile(F.col("norm")).alias("profile")).cache()
    a, b = (profiles.select(*[F.col(c).alias(f"{p}_{c}") for c in profiles.columns]) for p in "ab")
    pairs = a.crossJoin(b).withColumn("s", shared_parts(F.col("a_profile"), F.col("b_profile")))
    pairs = pairs.select(score_bound(F.col("a_profile"), F.col("b_profile"), F.col("s")).alias("bound"), weighted_score(similarity(F.col("a_norm"), F.col("b_norm"))).alias("score"))
    assert pairs.where("bound < score - 1e-9").count() == 0


def test_matches_with_a_least_score(spark):
    names = _names(80, 5)
    stores = spark.createDataFrame([(i, name, 105.7 + i % 3 * 1e-5, 10.0) for i, name in enumerate(names)], "id long, name string, lng double, lat double")
    asked = spark.createDataFrame([(i, name, 105.7 if i % 9 else None, 10.0) for i, name in enumerate(_names(40, 6) + names[:9])], "candidate_id long, name string, lng double, lat double")
    kept = check_duplicates(asked, stores).where("score >= 0.7001").drop("rank").collect()
    got = check_duplicates(asked, stores, least=0.7001).drop("rank").collect()
    assert sorted(got) == sorted(kept) and got
    assert check_duplicates(asked.limit(0), stores, least=0.7).count() == check_duplicates(asked, stores.limit(0), least=0.7).count() == 0


def test_few_pairs_of_a_dense_spot_are_scored(spark):
    """5,000 different names on one spot: all but some hundredths of the pairs end at the bound."""
    shops = places(view(spark, SMALL, "market"))
    rows = shops.crossJoin(spark.range(34).withColumnRenamed("id", "again")).select(F.col("place_id") * 100 + F.col("again"), F.expr("translate(md5(concat(norm, again)), '0123456789', 'aeiouymnpt')").alias("h"), "lng", "lat")
    many = rows.toDF("place_id", "h", "lng", "lat").select("place_id", F.concat(F.substring("h", 1, 7), F.lit(" "), F.substring("h", 11, 6)).alias("norm"), "lng", "lat")
    n = many.count()
    assert n >= 5000
    assert candidate_pairs(many, many, 15.0, 0.7, self_id="place_id").count() < 0.1 * n * n / 2


def test_an_edit_distance_leaves_few_pairs(spark):
    """Some in ten thousand pairs of different names are scored, and no bound with the edit distance is below its score."""
    names = spark.range(600).select("id", F.expr("translate(md5(cast(id as string)), '0123456789', 'aeiouymnpt')").alias("h"))
    spot = names.select(F.col("id").alias("place_id"), F.concat(F.substring("h", 1, 7), F.lit(" "), F.substring("h", 11, 6)).alias("norm"), F.lit(105.7).alias("lng"), F.lit(10.0).alias("lat"))
    assert candidate_pairs(spot, spot, 15.0, 0.7, self_id="place_id").count() < 0.005 * 600 * 600 / 2
    stores = spark.createDataFrame([(i, n, 105.7, 10.0) for i, n in enumerate(_names(80, 7))], "id long, name string, lng double, lat double")
    profiles = places(stores).where("norm <> ''").select("norm", name_profile(F.col("norm")).alias("profile")).cache()
    a, b = (profiles.select(*[F.col(c).alias(f"{p}_{c}") for c in profiles.columns]) for p in "ab")
    pairs = a.crossJoin(b).withColumn("s", shared_parts(F.col("a_profile"), F.col("b_profile"))).withColumn("edits", F.levenshtein("a_norm", "b_norm"))
    bound = score_bound(F.col("a_profile"), F.col("b_profile"), F.col("s"), F.col("edits"))
    pairs = pairs.select(bound.alias("bound"), weighted_score(similarity(F.col("a_norm"), F.col("b_norm"))).alias("score"))
    assert pairs.where("bound < score - 1e-9").count() == 0


def test_cells_are_cut_by_either_side(spark):
    one = spark.createDataFrame([(1, 105.7, 10.0)], "id long, lng double, lat double")
    many = spark.createDataFrame([(i, 105.7, 10.0 + i * 1e-8) for i in range(900)], "id long, lng double, lat double")
    for left, right in ((one, many), (many, one), (many, many.limit(40))):
        got = radius_join(left, right, 15.0, hot_cell=50)
        assert got.count() == got.select("l_id", "r_id").distinct().count() == left.count() * right.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_few_however_many_rows(spark):
    """What a spot's join shuffles grows with its rows: each is written once for each tile it meets."""
    counts = spark.createDataFrame([(501,), (6000,), (900_000,)], "n long").select(_tiles(F.col("n"), 500).alias("t"))
    assert [r.t for r in counts.collect()] == [2, 12, 12]
    spot = spark.range(300).select("id", F.lit(105.8).alias("lng"), F.lit(10.0).alias("lat"))
    assert radius_join(spot, spot, 10, self_id="id", hot_cell=2).select("l_id", "r_id").distinct().count() == 300 * 299 // 2


def test_many_cells_are_not_broadcast(spark, monkeypatch):
    from placewise.operators import nearest

    items = spark.range(400).select(F.col("id").alias("item"), (F.col("id") % 20 * 0.9).alias("x"), (F.floor(F.col("id") / 20) * 0.9).alias("y"))
    asked = items.select(F.col("item").alias("q"), F.col("x").alias("x"), F.col("y").alias("y"))
    found = lambda: nearest_candidates(asked, items, "q", ["x", "y"], low=0.0, span=32.0)
    few = {(r.q, r.item) for r in found().collect()}
    monkeypatch.setattr(nearest, "_FEW_CELLS", 300)
    many = found()
    assert {(r.q, r.item) for r in many.collect()} == few and {(i, i) for i in range(400)} <= few
    plan = many._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and plan.count("SortMergeJoin") >= 4


def test_radius_join_never_broadcasts(spark):
    """The planner's sizes are those of compressed files, so even tables that look small are shuffled."""
    stores = spark.range(50).selectExpr("id", "105.7 + id * 0.00001 AS lng", "10.0D AS lat")
    assert "Broadcast" not in _plan(radius_join(stores, stores, 15.0, self_id="id"))


def test_shuffles_are_freed(spark):
    """A written step leaves no shuffle files behind, and the session's setting is as before."""
    def files():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}

    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    written = materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert written.count() == 7 and spark.conf.get(name) == setting
    for _ in range(50):
        if not (left := {x for x in files() - before if x.endswith(".data")}):
            break
        time.sleep(0.1)
    assert len(left) <= 1  # the count's own


def test_snap_within_never_broadcasts_what_grows(spark, monkeypatch):
    from placewise.operators import spatial

    written = []
    monkeypatch.setattr(spatial, "materialize", lambda df: written.append(_plan(df)) or df)
    ways = spark.range(20).selectExpr("id AS gid", "array(named_struct('lng', 105.7 + id * 0.001D, 'lat', 10.0D), named_struct('lng', 105.701 + id * 0.001D, 'lat', 10.0D)) AS coords")
    points = spark.range(20).selectExpr("id AS point_id", "105.7 + id * 0.001D AS lng", "10.0001D AS lat")
    assert spatial.snap_within(points, ways).count() == 20
    assert spatial.snap_to_edges(points, ways).count() == 20
    assert not [plan for plan in written if "Broadcast" in plan]


def test_snap_searches_equal_far_points_once(spark, monkeypatch):
    from placewise.operators import spatial

    asked = []
    search = spatial.nearest_candidates
    monkeypatch.setattr(spatial, "nearest_candidates", lambda queries, *rest, **more: asked.append(queries.count()) or search(queries, *rest, **more))
    ways = spark.range(5).selectExpr("id AS gid", "array(named_struct('lng', 105.7 + id * 0.001D, 'lat', 10.0D), named_struct('lng', 105.701 + id * 0.001D, 'lat', 10.0D)) AS coords")
    points = spark.range(30).selectExpr("id AS point_id", "20.0D + id % 2 AS lng", "50.0D AS lat")
    got = snap_to_edges(points, ways).collect()
    assert asked == [2]
    assert sorted(r.point_id for r in got) == list(range(30)) and {r.edge_id for r in got} == {0}


def test_cells_near_hold_all_points_in_reach(spark):
    from placewise.operators.spatial import _cells_near

    rng = random.Random(5)
    lines = [(i, *[rng.uniform(-0.003, 0.003) for _ in range(4)]) for i in range(40)] + [(40, 0.001, 0.001, 0.001, 0.001), (41, -0.002, 0.0, 0.002, 0.0)]
    cells = spark.createDataFrame(lines, "id int, ax double, ay double, bx double, by double").select("id", _cells_near(0.001, 0.0005).alias("c"))
    listed = {r.id: {tuple(c) for c in r.c} for r in cells.collect()}
    for i, ax, ay, bx, by in lines:
        for _ in range(50):
            t, turn = rng.random(), rng.uniform(0, 2 * math.pi)
            x, y = (a + t * (b - a) + 0.0005 * f(turn) for a, b, f in ((ax, bx, math.cos), (ay, by, math.sin)))
            assert (math.floor(x / 0.001), math.floor(y / 0.001)) in listed[i]
