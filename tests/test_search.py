"""Smart search and facets against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.operators.search import CATEGORY_SYNONYMS, address_facets, smart_search
from placewise.operators.substring import contains_join

STORE = "id long, name string, address string, category_name string, lng double, lat double"
QUERY = "query_id long, keyword string, lng double, lat double"


def km(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plain_search(stores, queries, k=10):
    out = {}
    for query_id, keyword, lng, lat in queries:
        if not (keyword or "").strip():
            continue
        word = keyword.lower()
        for phrase in ("gần đây", "gan day", "ở đâu"):
            word = word.replace(phrase, "", 1)
        word = word.strip()
        implied = {c.lower() for c, synonyms in CATEGORY_SYNONYMS.items() if any(s in word for s in synonyms)}
        hits = [
            s for s in stores
            if not word or any(word in (t or "").lower() for t in s[1:4]) or (s[3] or "").lower() in implied
        ]
        if lng is None or lat is None:
            found = [(None, s[0]) for s in sorted(hits, key=lambda s: s[0])[:k]]
        else:
            found = sorted((round(km((lng, lat), s[4:6]), 9), s[0]) for s in hits if s[4] is not None and s[5] is not None)[:k]
        if found:
            out[query_id] = found
    return out


def searched(spark, stores, queries):
    rows = smart_search(spark.createDataFrame(stores, STORE), spark.createDataFrame(queries, QUERY)).orderBy("query_id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.km, r.store_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_smart_search(spark):
    rng = random.Random(7)
    words = ["phở", "cafe", "Nhà Thuốc", "tiệm", "x", "quán ăn", "bún", "áo"]
    categories = ["Ẩm Thực", "Đồ Uống", "Y Tế & Sức Khỏe", None, "Lưu Trú"]
    stores = []
    for i in range(1500):
        # A third of all stores stands on one point, others in the city, a few far away, some nowhere.
        at = (105.78, 10.03) if i % 3 == 0 else (105.7 + rng.randint(0, 900) / 5000, 10 + rng.randint(0, 900) / 5000)
        at = (-70.0 + i % 7, 179.0 / 9 - i % 5) if i % 101 == 5 else (None, 10.0) if i % 97 == 3 else at
        name = None if i % 89 == 1 else " ".join(rng.choice(words) for _ in range(3))
        stores.append((i, name, None if i % 53 == 2 else f"{i % 40} Mậu Thân", categories[i % 5], *at))
    asked = ["gần đây", "Cafe", "phở bún", "khách sạn ở đâu", "mậu thân", "x", "áo", "zzz", " ", None, "cafe gan day", "thuốc", "tiệm x"]
    queries = []
    for i in range(160):
        at = (None, None) if i % 5 == 4 else (105.78, 10.03) if i % 3 == 0 else (105.6 + rng.randint(0, 40) / 100, 9.9 + rng.randint(0, 40) / 100)
        queries.append((i, asked[i % len(asked)], *(at if i % 31 else (None, 10.0))))
    got, want = searched(spark, stores, queries), plain_search(stores, queries)
    assert got.keys() == want.keys()
    for key, found in want.items():
        assert len(got[key]) == len(found)
        for (a, _), (b, _) in zip(got[key], found):
            assert a is b is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
        if all(a[0] is None or b[0] - a[0] > 1e-7 or b[0] == a[0] == 0 for a, b in zip(found, found[1:])):
            assert [s for _, s in got[key]] == [s for _, s in found]


def test_smart_search_on_empty_tables(spark):
    store, query = (1, "phở", "a", None, 105.7, 10.0), (1, "phở", 105.7, 10.0)
    assert searched(spark, [], [query]) == {}
    assert searched(spark, [store], []) == {}
    assert searched(spark, [store], [query, (2, "gần đây", None, None), (3, "none", None, None)]) == {1: [(0.0, 1)], 2: [(None, 1)]}


def test_substring_join_runs_nothing_while_planned(spark):
    needles = spark.range(4).select(F.element_at(F.array(F.lit("ab"), F.lit("abcd"), F.lit("x"), F.lit("")), (F.col("id") + 1).cast("int")).alias("n"))
    failing = needles.where(F.when(F.col("n") == "x", F.raise_error(F.lit("ran")).cast("boolean")).otherwise(True))
    texts = spark.createDataFrame([(1, "abcde"), (2, "xab"), (3, None)], "i int, t string")
    joined = contains_join(failing, texts, "n", "t")  # a job would fail here
    with pytest.raises(Exception, match="ran"):
        joined.collect()
    assert sorted((r.n, r.i) for r in contains_join(needles, texts, "n", "t").collect()) == [("ab", 1), ("ab", 2), ("abcd", 1), ("x", 2)]


def test_facets_stand_in_vietnamese_order(spark):
    streets = ["Ân Thi", "An Dương", "Ăn Quả", "Đề Thám", "Duy Tân", "Em Ba", "Ơn Nghĩa", "Ô Môn", "Oanh Kiều", "Á Châu"]
    stores = spark.createDataFrame([(f"{n} Đường {s}, Phường Tân An, Quận Ninh Kiều",) for n, s in enumerate(streets * 2)], "address string")
    rows = address_facets(stores).where("facet = 'street'").orderBy("position").collect()
    order = ["Á Châu", "An Dương", "Ăn Quả", "Ân Thi", "Duy Tân", "Đề Thám", "Em Ba", "Oanh Kiều", "Ô Môn", "Ơn Nghĩa"]
    assert [(r.position, r.value) for r in rows] == [(n + 1, f"Đường {s}") for n, s in enumerate(order)]
