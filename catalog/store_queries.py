"""Scans, filters, search, joins, aggregates and rankings of the store tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    RATED, any_of, decision, haversine, norm, partial, query, r4, ratio, score, sql_exact, sql_r4, token_set,
)
from catalog.text_queries import NORMED, facet_address_ctes
from placewise.functions.columns import sealed
from placewise.functions.geo import parse_linestring, first_coord, last_coord
from placewise.functions.formats import round_exact
from placewise.functions.text import WARNING_AT, normalize_text, similarity, weighted_score
from placewise.operators import relational as R
from placewise.operators import search as S
from placewise.operators import spatial
from placewise.plans import dedupe
from placewise.sources.dumps import parse_address_dump
from placewise.sources.geojson import from_features, to_geojson
from placewise.sources.photos import GPS_PATTERNS, scan_gps_text
from placewise.sources.stores import load_stores
from placewise.tables import shuffle_width


def rated(d):
    return R.with_category(R.rating_summary(d.stores, d.reviews), d.categories)


# --- sources ------------------------------------------------------------------------------------------------
@query(
    "s1_load_stores",
    "SELECT s.id, 'S' || CAST(s.id AS VARCHAR) AS store_id, s.name AS brand, c.name AS category, address, coalesce(phone, '') AS phone, lat, lng AS lon FROM stores s JOIN categories c ON c.id = s.category_id",
    "stores categories",
)
def _(d):
    return load_stores(d.stores, d.categories)


@query(
    "s4_s5_geojson_round_trip",
    "SELECT s.id, s.category_id, s.name, c.name AS category_name, address, phone, email, state, lng, lat FROM stores s JOIN categories c ON c.id = s.category_id",
    "stores categories",
)
def _(d):
    features = to_geojson(R.with_category(d.stores, d.categories))
    return from_features(features).select("id", "category_id", "name", "category_name", "address", "phone", "email", "state", "lng", "lat")


_DUMP = "CASE id % 50 WHEN 0 THEN '-----------' WHEN 1 THEN '(206 rows)' WHEN 2 THEN '' WHEN 3 THEN '       address        ' WHEN 4 THEN concat('﻿ ', address, ' ') ELSE concat(' ', address, ' ') END"


@query("s6_address_dump", "SELECT trim(address) AS address FROM stores WHERE id % 50 >= 4", "stores")
def _(d):
    return parse_address_dump(d.stores.select(F.expr(_DUMP).alias("value")))


_PHOTO = "CASE page_id % 4 WHEN 0 THEN concat(html, '<exif:GPSLatitude>10.5</exif:GPSLatitude>') WHEN 1 THEN concat('gps:Longitude=105', html, 'GPSLongitude') ELSE html END"


@query(
    "s9_scan_gps_text",
    f"""SELECT url AS path, pattern, decode(encode(content)[greatest(pos - 50, 1):pos + 99], 'ignore') AS snippet FROM (
 SELECT url, content, pattern, strlen(content) - strlen(substr(content, instr(content, pattern))) + 1 AS pos
 FROM (SELECT url, {_PHOTO} AS content FROM pages) p, (VALUES {', '.join(f"('{p}')" for p in GPS_PATTERNS)}) AS v(pattern) WHERE contains(content, pattern)) x""",
)
def _(d):
    return scan_gps_text(d.pages.select(F.col("url").alias("path"), F.expr(_PHOTO).cast("binary").alias("content")))


# --- filters and search -------------------------------------------------------------------------------------
@query("f1_visible_stores", "SELECT id, name, rating_avg, rating_count FROM rated WHERE state = 'active'", "stores reviews categories", {"rated": RATED})
def _(d):
    return S.visible_stores(rated(d), is_staff=False).select("id", "name", "rating_avg", "rating_count")


@query("f2_in_bbox", "SELECT id, name FROM stores WHERE lng BETWEEN 105.72 AND 105.8 AND lat BETWEEN 10.0 AND 10.0003", "stores")
def _(d):
    return S.in_bbox(d.stores, (105.72, 10.0, 105.8, 10.0003)).select("id", "name")


@query("f3_filter_by", "SELECT id, store_id, user_id, rating FROM reviews WHERE rating = 5 AND user_id = 7", "reviews")
def _(d):
    return S.filter_by(d.reviews, rating=5, user_id=7, store_id=None).select("id", "store_id", "user_id", "rating")


@query(
    "f4_search",
    """SELECT id, name FROM stores WHERE (contains(lower(name), 'ring') OR contains(lower(address), 'ring') OR contains(lower("describe"), 'ring')) AND (contains(lower(name), 'mậu') OR contains(lower(address), 'mậu') OR contains(lower("describe"), 'mậu'))""",
    "stores",
)
def _(d):
    return S.search(d.stores, "Ring MẬU", ["name", "address", "describe"]).select("id", "name")


@query(
    "f5_order_page", "SELECT id, rating_avg, rating_count FROM rated ORDER BY rating_count DESC, id LIMIT 10 OFFSET 20",
    "stores reviews categories", {"rated": RATED},
)
def _(d):
    page = S.order_page(rated(d), "rating_count", ["rating_avg", "rating_count", "name"], page=3, desc=True)
    return page.select("id", "rating_avg", "rating_count")


# Prices of every seventh store are missing.
_PRICED = "SELECT id, CASE WHEN id % 7 = 3 THEN NULL ELSE price END AS price FROM stores"


def _priced(d):
    return d.stores.select("id", F.when(F.col("id") % 7 != 3, F.col("price")).alias("price"))


@query("f5_next_page", "SELECT id, price FROM priced ORDER BY price DESC NULLS LAST, id LIMIT 25 OFFSET 40", "stores", {"priced": _PRICED})
def _(d):
    """The third page of 20 and a bit more, after the last row of the second one."""
    stores = _priced(d)
    last = S.order_page(stores, "price", ["price"], page=2, size=20, desc=True).collect()[-1]
    return S.order_page(stores, "price", ["price"], size=25, desc=True, after=(last.price, last.id)).select("id", "price")


@query("f5_null_pages", "SELECT id, price FROM priced ORDER BY price NULLS FIRST, id LIMIT 40 OFFSET 10", "stores", {"priced": _PRICED})
def _(d):
    """Pages that begin among the null keys and go on beyond them."""
    stores = _priced(d)
    last = S.order_page(stores, "price", ["price"], size=10).collect()[-1]
    return S.order_page(stores, "price", ["price"], size=40, after=(last.price, last.id)).select("id", "price")


def _without_first(x: str, phrase: str) -> str:
    return f"CASE WHEN instr({x}, '{phrase}') > 0 THEN substr({x}, 1, instr({x}, '{phrase}') - 1) || substr({x}, instr({x}, '{phrase}') + {len(phrase)}) ELSE {x} END"


SEARCH_CTES = {
    "q0": "SELECT *, lower(keyword) AS w0 FROM search_queries",
    "q1": f"SELECT *, {_without_first('w0', 'gần đây')} AS w1 FROM q0",
    "q2": f"SELECT *, {_without_first('w1', 'gan day')} AS w2 FROM q1",
    "q3": f"SELECT *, trim({_without_first('w2', 'ở đâu')}) AS word FROM q2",
    "st": "SELECT s.id, s.lng, s.lat, lower(s.name) AS n, lower(s.address) AS a, lower(c.name) AS c FROM stores s JOIN categories c ON c.id = s.category_id",
    "words": "SELECT DISTINCT word FROM q3",
    "implied": "SELECT word, c FROM words, (VALUES " + ", ".join(f"('{c.lower()}', '{s}')" for c, syns in S.CATEGORY_SYNONYMS.items() for s in syns) + ") AS v(c, syn) WHERE contains(word, syn) GROUP BY ALL",
    "hits": """SELECT DISTINCT w.word, s.id, s.lng, s.lat FROM words w JOIN st s ON w.word = '' OR contains(s.n, w.word) OR contains(s.a, w.word) OR contains(s.c, w.word)
 OR EXISTS (SELECT 1 FROM implied i WHERE i.word = w.word AND i.c = s.c)""",
}


@query(
    "f6_w1_smart_search",
    f"""SELECT query_id, store_id, {sql_r4('km')} AS km, CAST(rank AS INTEGER) AS rank FROM (
 SELECT q.query_id, h.id AS store_id, CASE WHEN q.lng IS NULL THEN NULL ELSE {haversine('q.lng', 'q.lat', 'h.lng', 'h.lat', 6371.0)} END AS km,
  row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN q.lng IS NULL THEN NULL ELSE floor({haversine('q.lng', 'q.lat', 'h.lng', 'h.lat', 6371.0)} * 1e9) END, h.id) AS rank
 FROM q3 q JOIN hits h ON h.word = q.word) x WHERE rank <= 10""",
    "search_queries stores categories", SEARCH_CTES,
)
def _(d):
    found = S.smart_search(R.with_category(d.stores, d.categories), d.search_queries)
    return found.select("query_id", "store_id", r4("km").alias("km"), "rank")


@query(
    "f7_implied_categories",
    "SELECT q.query_id, coalesce(string_agg(i.c, '|' ORDER BY i.c), '') AS categories FROM q3 q LEFT JOIN implied i ON i.word = q.word GROUP BY q.query_id",
    "search_queries", {k: v for k, v in SEARCH_CTES.items() if k not in ("st", "hits")},
)
def _(d):
    implied = S.implied_categories(S.search_word(F.col("keyword")))
    return d.search_queries.select("query_id", F.array_join(F.array_sort(implied), "|").alias("categories"))


@query(
    "f8_display_filter",
    """SELECT s.id, s.name FROM stores s JOIN f_out f ON f.id = s.id WHERE f.district = 'Quận Ninh Kiều' AND f.ward = 'Phường Tân An'
 AND (f.street_name = 'Đường 30 Tháng 4' OR contains(lower(f.street), 'đường 30 tháng 4'))
 AND s.category_id IN (1, 2, 3, 4, 5, 6) AND s.id IN (SELECT store_id FROM favorites WHERE user_id % 5 = 2)""",
    "stores favorites", facet_address_ctes(),
)
def _(d):
    # One shared list: the favourites of a group of users under one id.
    shared = d.favorites.where("user_id % 5 = 2").withColumn("user_id", F.lit(7).cast("bigint"))
    shown = S.display_filter(
        d.stores, shared, user_id=7, district="Quận Ninh Kiều", ward="Phường Tân An", street="Đường 30 Tháng 4",
        categories=[1, 2, 3, 4, 5, 6], favorites_only=True,
    )
    return shown.select("id", "name")


@query(
    "f9_address_facets",
    """SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY value COLLATE vi, value) AS INTEGER) AS position FROM (SELECT DISTINCT facet, value FROM (SELECT 'district' AS facet, district AS value FROM f_out UNION ALL SELECT 'ward', ward FROM f_out WHERE district = 'Quận Ninh Kiều'
 UNION ALL SELECT 'street', street_name FROM f_out WHERE district = 'Quận Ninh Kiều' AND ward = 'Phường Tân An') x WHERE value <> '') y""",
    "stores", facet_address_ctes(),
)
def _(d):
    return S.address_facets(d.stores, "Quận Ninh Kiều", "Phường Tân An")


@query(
    "f10_public_images",
    """SELECT s.id, coalesce(string_agg(CAST(i.id AS VARCHAR) || ':' || i.image, '|' ORDER BY i.id), '') AS images
FROM stores s LEFT JOIN (SELECT * FROM images WHERE state = 'public') i ON i.store_id = s.id GROUP BY s.id""", "stores images",
)
def _(d):
    nested = S.with_public_images(d.stores, d.images)
    shown = F.transform("images", lambda i: F.concat(i["id"].cast("string"), F.lit(":"), i["image"]))
    return nested.select("id", F.array_join(shown, "|").alias("images"))


@query(
    "f10_public_images_flat",
    "SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY id, image) - 1 AS INTEGER) AS position, id, image FROM images WHERE state = 'public'", "images",
)
def _(d):
    return S.public_images(d.images).select("store_id", "position", "id", "image")


@query("f11_pending", "SELECT id, store_id, CAST(date_up AS TIMESTAMP) AS date_up FROM approvals WHERE status = 'pending'", "approvals")
def _(d):
    return S.pending(d.approvals).select("id", "store_id", "date_up")


@query(
    "f12_for_user", "SELECT h.id, h.user_id, h.keyword FROM search_history h JOIN users u ON u.id = h.user_id WHERE u.is_active", "search_history users",
)
def _(d):
    return S.for_user(d.search_history, d.users, "created_at").select("id", "user_id", "keyword")


@query(
    "f15_a3_map_tiers",
    f"""WITH lv AS (SELECT r.*, CASE WHEN {any_of('lower(category_name)', S.MAP_LEVELS[1])} THEN 1 WHEN {any_of('lower(category_name)', S.MAP_LEVELS[2])} THEN 2
  WHEN {any_of('lower(category_name)', S.MAP_LEVELS[3])} THEN 3 ELSE 4 END AS level, rating_avg >= 3.5 AND rating_count >= 1 AS high_quality,
  row_number() OVER (PARTITION BY category_id ORDER BY (id * 17) % 13 DESC, id) = 1 AS representative FROM rated r)
SELECT id, CAST(level AS INTEGER) AS level, high_quality, representative,
 CAST((CASE WHEN high_quality OR representative THEN 100 ELSE 50 END - level * 10) AS BIGINT) * 100000 + id AS priority
FROM lv WHERE level <= 3 AND (high_quality OR representative)""".replace("WITH lv AS (", "SELECT * FROM (WITH lv AS (", 1) + ") y",
    "stores reviews categories", {"rated": RATED},
)
def _(d):
    tiers = S.map_tiers(rated(d).withColumn("seq", F.col("id")), zoom=12.5)
    return tiers.select("id", "level", "high_quality", "representative", "priority")


_TIERS = f"""SELECT r.*, CASE WHEN {any_of('lower(category_name)', S.MAP_LEVELS[1])} THEN 1 WHEN {any_of('lower(category_name)', S.MAP_LEVELS[2])} THEN 2
 WHEN {any_of('lower(category_name)', S.MAP_LEVELS[3])} THEN 3 ELSE 4 END AS level, rating_avg >= 3.5 AND rating_count >= 1 AS high_quality,
 row_number() OVER (PARTITION BY category_id ORDER BY (id * 17) % 13 DESC, id) = 1 AS representative FROM rated r"""
_FOCUS = "(id IN (3, 50, 77) OR EXISTS (SELECT 1 FROM stores t WHERE t.id = 120 AND t.lng = lv.lng AND t.lat = lv.lat))"
_PRIORITY = "CAST((CASE WHEN high_quality OR representative THEN 100 ELSE 50 END - level * 10) AS BIGINT) * 100000 + id"


@query(
    "f15_map_tiers_focus",
    f"""SELECT id, CAST(level AS INTEGER) AS level, CASE WHEN {_FOCUS} THEN 99999999 ELSE {_PRIORITY} END AS priority FROM lv
 WHERE {_FOCUS} OR (level <= 1 AND (high_quality OR representative))""",
    "stores reviews categories", {"rated": RATED, "lv": _TIERS},
)
def _(d):
    spot = d.stores.where("id = 120").select("lng", "lat").first()
    tiers = S.map_tiers(rated(d).withColumn("seq", F.col("id")), zoom=11.0, selected=[3, 50], hovered=[77], route_points=[(spot.lng, spot.lat)] if spot else [])
    return tiers.select("id", "level", "priority")


@query(
    "f15_map_tiers_filtered", f"SELECT id, CAST(level AS INTEGER) AS level, {_PRIORITY} AS priority FROM lv",
    "stores reviews categories", {"rated": RATED, "lv": _TIERS},
)
def _(d):
    return S.map_tiers(rated(d).withColumn("seq", F.col("id")), zoom=11.0, filtered=True).select("id", "level", "priority")


_MINE = "s.id IN (SELECT store_id FROM favorites WHERE user_id % 5 = 2)"
for _name, _where, _options in (
    ("f8_favorites_alone", _MINE, {"favorites_only": True}),
    ("f8_categories_alone", "s.category_id IN (1, 2, 3)", {"categories": [1, 2, 3]}),
    ("f8_favorites_and_categories", f"s.category_id IN (1, 2, 3) AND {_MINE}", {"categories": [1, 2, 3], "favorites_only": True}),
    ("f8_no_filter", "TRUE", {}),
):

    @query(_name, f"SELECT s.id, s.name FROM stores s WHERE {_where}", "stores favorites")
    def _(d, options=_options):
        shared = d.favorites.where("user_id % 5 = 2").withColumn("user_id", F.lit(7).cast("bigint"))
        return S.display_filter(d.stores, shared, user_id=7, **options).select("id", "name")


@query(
    "a3_category_representatives",
    "SELECT category_id, id AS store_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY (id * 17) % 13 DESC, id) AS n FROM stores) x WHERE n = 1", "stores",
)
def _(d):
    return S.category_representatives(d.stores.withColumn("seq", F.col("id")))


# --- joins --------------------------------------------------------------------------------------------------
@query("j1_with_category", "SELECT s.id, s.name, c.name AS category_name FROM stores s JOIN categories c ON c.id = s.category_id", "stores categories")
def _(d):
    return R.with_category(d.stores, d.categories).select("id", "name", "category_name")


@query(
    "j2_labels",
    """SELECT a.id, s.name AS store_name, s.address AS store_address, u.username AS submitter_name, a.status FROM approvals a
LEFT JOIN stores s ON s.id = a.store_id LEFT JOIN users u ON u.id = a.submitter_id""", "approvals stores users",
)
def _(d):
    df = R.with_label(d.approvals, d.stores, "store_id", "name", "store_name")
    df = R.with_label(df, d.stores, "store_id", "address", "store_address")
    return R.with_label(df, d.users, "submitter_id", "username", "submitter_name").select("id", "store_name", "store_address", "submitter_name", "status")


@query(
    "j3_radius_join",
    f"""SELECT id_a, id_b, {sql_exact('m', 2)} AS distance_m FROM (SELECT a.id AS id_a, b.id AS id_b, {haversine('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS m
FROM stores a JOIN stores b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001) x WHERE m <= 15""", "stores",
)
def _(d):
    points = d.stores.select("id", "lng", "lat")
    pairs = spatial.radius_join(points, points, 15.0, self_id="id")
    return pairs.select(F.col("l_id").alias("id_a"), F.col("r_id").alias("id_b"), round_exact(F.col("distance"), 2).alias("distance_m"))


_CATEGORY_TEXT = "CASE conv_id % 5 WHEN 0 THEN 'y tế' WHEN 1 THEN 'Đồ Uống' WHEN 2 THEN 'Công' WHEN 3 THEN 'nothing' ELSE 'Giáo Dục' END"


@query(
    "j6_category_by_name",
    f"""SELECT x.conv_id, x.turn, min(c.id) AS category_id FROM (SELECT conv_id, turn, {_CATEGORY_TEXT} AS category FROM conversations) x
LEFT JOIN categories c ON contains(lower(c.name), lower(x.category)) GROUP BY x.conv_id, x.turn""", "categories",
)
def _(d):
    asked = d.conversations.select("conv_id", "turn", F.expr(_CATEGORY_TEXT).alias("category"))
    return R.first_category_containing(asked, "category", d.categories).select("conv_id", "turn", "category_id")


@query(
    "j7_name_stops",
    """SELECT p.query_id AS route_id, CASE WHEN s.name IS NOT NULL THEN s.name WHEN p.query_id % 2 = 0 THEN 'đích' ELSE 'Điểm dừng ' || CAST(p.query_id % 9 AS VARCHAR) END AS stop_name
FROM (SELECT query_id, CASE WHEN query_id % 4 = 1 THEN start_lng ELSE b.lng END AS lng, CASE WHEN query_id % 4 = 1 THEN start_lat ELSE b.lat END AS lat
 FROM route_requests r JOIN stores b ON b.id = r.query_id) p
LEFT JOIN (SELECT lng, lat, min_by(name, id) AS name FROM stores GROUP BY lng, lat) s ON s.lng = p.lng AND s.lat = p.lat""",
    "route_requests stores",
)
def _(d):
    here = d.stores.select(F.col("id").alias("query_id"), "lng", "lat")
    moved = F.col("query_id") % 4 == 1
    stops = d.route_requests.join(here, "query_id").select(
        F.col("query_id").alias("route_id"), (F.col("query_id") % 9).alias("stop_no"), (F.col("query_id") % 2 == 0).alias("last"),
        F.when(moved, F.col("start_lng")).otherwise(F.col("lng")).alias("lng"), F.when(moved, F.col("start_lat")).otherwise(F.col("lat")).alias("lat"),
    )
    return R.name_stops(stops, d.stores).select("route_id", "stop_name")


@query(
    "j8_favorite_flag", "SELECT s.id, s.id IN (SELECT store_id FROM favorites WHERE user_id = 11) AS is_favorite FROM stores s", "stores favorites",
)
def _(d):
    return S.favorite_flag(d.stores, d.favorites, 11).select("id", "is_favorite")


@query(
    "j9_exclude_at",
    """SELECT s.id FROM stores s WHERE NOT EXISTS (SELECT 1 FROM stores p WHERE p.state = 'inactive' AND abs(p.lat - s.lat) < 1e-5 AND abs(p.lng + 0.000004 - s.lng) < 1e-5)""",
    "stores",
)
def _(d):
    pins = d.stores.where("state = 'inactive'").select((F.col("lng") + 0.000004).alias("lng"), "lat")
    return R.exclude_at(d.stores, pins).select("id")


# --- aggregates, windows ------------------------------------------------------------------------------------
@query("a1_rating_summary", f"SELECT id, {sql_r4('rating_avg')} AS rating_avg, rating_count FROM rated", "stores reviews categories", {"rated": RATED})
def _(d):
    return R.rating_summary(d.stores, d.reviews).select("id", r4("rating_avg").alias("rating_avg"), "rating_count")


@query("a2_image_counts", "SELECT s.id, count(i.id) AS image_count FROM stores s LEFT JOIN images i ON i.store_id = s.id GROUP BY s.id", "stores images")
def _(d):
    return R.image_counts(d.stores, d.images)


@query("a4_label_counts", "SELECT p_type AS label, count(*) AS rows FROM part GROUP BY p_type")
def _(d):
    return R.label_counts(d.part.select(F.col("p_name").alias("text"), F.col("p_type").alias("label")))


EVALUATED = f"""SELECT {score('p', 't', 'l')} AS s FROM (SELECT {partial('na', 'nb')} AS p, {token_set('na', 'nb')} AS t, {ratio('na', 'nb')} AS l FROM n) m"""


def _scored_pairs(d):
    # Each store's name against a worn copy of itself: upper case, a third of them backwards.
    worn = F.when(F.col("id") % 3 == 0, F.reverse(F.upper("name"))).otherwise(F.upper("name"))
    # Spread first: a few compressed files hold many rows. Each name is normalised and each pair compared once, also below a filter on the score.
    stores = d.stores.select("id", "name").repartition(shuffle_width(d.spark))
    pairs = stores.select("id", worn.alias("worn"), sealed(normalize_text(F.col("name"))).alias("na")).select("id", "na", sealed(normalize_text(F.col("worn"))).alias("nb"))
    return pairs.select("id", "na", "nb", sealed(weighted_score(similarity(F.col("na"), F.col("nb")))).alias("score"))


_WORN = "CASE WHEN id % 3 = 0 THEN reverse(upper(name)) ELSE upper(name) END"
WORN = {"n": f"SELECT id, {norm('name')} AS na, {norm(_WORN)} AS nb FROM stores"}


@query("a5_evaluate_pairs", f"SELECT count(*) FILTER (WHERE s >= 0.8) AS detected, count(*) FILTER (WHERE s < 0.8) AS missed, count(*) AS total FROM ({EVALUATED}) x", "stores", WORN)
def _(d):
    return R.evaluate_pairs(_scored_pairs(d), 0.8)


@query(
    "a5_missed_pairs",
    f"SELECT id, na, nb, {sql_r4('s')} AS score FROM (SELECT id, na, nb, {score(partial('na', 'nb'), token_set('na', 'nb'), ratio('na', 'nb'))} AS s FROM n) x WHERE s < 0.8", "stores", WORN,
)
def _(d):
    return R.missed_pairs(_scored_pairs(d), 0.8).select("id", "na", "nb", r4("score").alias("score"))


@query("a7_distinct_addresses", "SELECT address, count(*) AS stores FROM stores GROUP BY address", "stores")
def _(d):
    return R.distinct_addresses(d.stores)


@query(
    "w4_recent_searches",
    """SELECT user_id, id, keyword FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(keyword) ORDER BY created_at DESC, id DESC) AS n FROM search_history) x WHERE n = 1""",
    "search_history",
)
def _(d):
    return R.recent_searches(d.search_history).select("user_id", "id", "keyword")


@query(
    "w5_take_per_label", "SELECT label, text, seq FROM (SELECT p_brand AS label, p_name AS text, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) x WHERE n <= 20",
)
def _(d):
    return R.take_per_label(d.part.select(F.col("p_brand").alias("label"), F.col("p_name").alias("text"), F.col("p_partkey").alias("seq")), 20)


# Far more rows than a task's share, null and repeated orders' neighbours included, and an order that is text.
_LABELLED = """SELECT l_returnflag AS label, CASE WHEN l_orderkey % 1000 = 0 AND l_linenumber = 1 THEN NULL ELSE printf('%012d', l_orderkey * 10 + l_linenumber) END AS seq,
 l_orderkey * 10 + l_linenumber AS line FROM lineitem WHERE l_linenumber > 1 OR l_orderkey % 1000 <> 0 OR l_orderkey = 1000"""


@query(
    "w5_take_per_label_large",
    "SELECT label, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq NULLS FIRST) AS n FROM labelled) x WHERE n <= 5000", extra={"labelled": _LABELLED},
)
def _(d):
    rows = d.lineitem.where("l_linenumber > 1 or l_orderkey % 1000 <> 0 or l_orderkey = 1000")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    missing = (F.col("l_orderkey") % 1000 == 0) & (F.col("l_linenumber") == 1)
    rows = rows.select(F.col("l_returnflag").alias("label"), F.when(~missing, F.lpad(line.cast("string"), 12, "0")).alias("seq"), line.alias("line"))
    return R.take_per_label(rows, 5000)


@query("o1_order_by", "SELECT id, user_id, store_id, rating FROM reviews", "reviews")
def _(d):
    return S.order_by(d.reviews, "created_at", desc=True).select("id", "user_id", "store_id", "rating")


# --- duplicate check ----------------------------------------------------------------------------------------
_PLACES = f"SELECT norm, lng, lat, min(id) AS place_id, count(*) AS copies FROM (SELECT id, lng, lat, {norm('name')} AS norm FROM stores) x GROUP BY norm, lng, lat"


@query(
    "p1_duplicate_pairs",
    f"""SELECT place_a, place_b, copies_a, copies_b, {sql_exact('m', 2)} AS distance_m, {sql_r4('p')} AS partial_ratio, {sql_r4('t')} AS token_set_ratio,
 {sql_r4('l')} AS levenshtein_ratio, {sql_r4(score('p', 't', 'l'))} AS score, {decision(score('p', 't', 'l'))} AS decision
FROM (SELECT a.place_id AS place_a, b.place_id AS place_b, a.copies AS copies_a, b.copies AS copies_b, {haversine('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS m,
  {partial('a.norm', 'b.norm')} AS p, {token_set('a.norm', 'b.norm')} AS t, {ratio('a.norm', 'b.norm')} AS l
 FROM places a JOIN places b ON a.place_id < b.place_id AND abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001 WHERE a.norm <> '' AND b.norm <> '') x WHERE m <= 15""",
    "stores", {"places": _PLACES},
)
def _(d):
    pairs = dedupe.find_duplicate_pairs(d.stores)
    return pairs.select(
        "place_a", "place_b", "copies_a", "copies_b", round_exact(F.col("distance"), 2).alias("distance_m"),
        *[r4(c).alias(c) for c in ("partial_ratio", "token_set_ratio", "levenshtein_ratio", "score")], "decision",
    )


_SIMILAR = f"""SELECT a.place_id AS place_a, b.place_id AS place_b, {haversine('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS m,
  {partial('a.norm', 'b.norm')} AS p, {token_set('a.norm', 'b.norm')} AS t, {ratio('a.norm', 'b.norm')} AS l
 FROM places a JOIN places b ON a.place_id < b.place_id AND abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001 WHERE a.norm <> '' AND b.norm <> ''"""


@query(
    "p1_similar_pairs",
    f"""SELECT place_a, place_b, {sql_r4(score('p', 't', 'l'))} AS score, {decision(score('p', 't', 'l'))} AS decision FROM ({_SIMILAR}) x
WHERE m <= 15 AND {score('p', 't', 'l')} >= CAST(0.7 AS DOUBLE)""", "stores", {"places": _PLACES},
)
def _(d):
    """Warnings and rejects only: a pair is scored only where a bound of its score reaches the threshold."""
    pairs = dedupe.find_duplicate_pairs(d.stores, least=WARNING_AT)
    return pairs.select("place_a", "place_b", r4("score").alias("score"), "decision")


# The comparison engine would need minutes for all pairs of names; tests compare with plain Python on a small table.
@query("p1_dense_spot")
def _(d):
    """Thousands of different names on one spot."""
    pairs = dedupe.find_duplicate_pairs(d.market, least=WARNING_AT)
    return pairs.select("place_a", "place_b", r4("score").alias("score"), "decision")


# Candidates: every second store's name, moved by about 4 m; some blank.
_CANDIDATES = "SELECT id * 2 AS candidate_id, CASE WHEN id % 41 = 0 THEN ' - ' ELSE concat(upper(name), CASE WHEN id % 3 = 0 THEN ' 2' ELSE '' END) END AS name, lng + 0.00003 AS lng, lat + 0.00002 AS lat FROM stores WHERE state = 'active'"
_MATCHES = f"""SELECT candidate_id, place_id AS store_id, copies, {sql_exact('m', 2)} AS distance_m, {sql_exact('p', 4)} AS partial_ratio, {sql_exact('t', 4)} AS token_set_ratio, {sql_exact('l', 4)} AS levenshtein_ratio,
 {sql_exact(score('p', 't', 'l'), 4)} AS score, {decision(score('p', 't', 'l'))} AS decision,
 CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY {sql_exact(score('p', 't', 'l'), 4)} DESC, m, place_id) AS INTEGER) AS rank
FROM (SELECT c.candidate_id, b.place_id, b.copies, {haversine('c.lng', 'c.lat', 'b.lng', 'b.lat')} AS m,
  CASE WHEN b.norm = '' THEN CAST(0 AS DOUBLE) ELSE {partial('c.norm', 'b.norm')} END AS p, CASE WHEN b.norm = '' THEN CAST(0 AS DOUBLE) ELSE {token_set('c.norm', 'b.norm')} END AS t, CASE WHEN b.norm = '' THEN CAST(0 AS DOUBLE) ELSE {ratio('c.norm', 'b.norm')} END AS l
 FROM (SELECT *, {norm('name')} AS norm FROM candidates) c JOIN places b ON abs(c.lat - b.lat) < 0.001 AND abs(c.lng - b.lng) < 0.001 WHERE c.norm <> '') x WHERE m <= 15"""


def _candidates(d):
    s = d.stores.where("state = 'active'")
    name = F.concat(F.upper("name"), F.when(F.col("id") % 3 == 0, " 2").otherwise(""))
    return s.select(
        (F.col("id") * 2).alias("candidate_id"), F.when(F.col("id") % 41 == 0, " - ").otherwise(name).alias("name"),
        (F.col("lng") + 0.00003).alias("lng"), (F.col("lat") + 0.00002).alias("lat"),
    )


@query("p1_w2_check_duplicates", "SELECT * FROM matches", "stores", {"places": _PLACES, "candidates": _CANDIDATES, "matches": _MATCHES})
def _(d):
    return dedupe.check_duplicates(_candidates(d), d.stores)


@query(
    "p1_similar_matches",
    f"""SELECT candidate_id, store_id, copies, score, decision, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY rank) AS INTEGER) AS rank FROM (SELECT *, {score('p', 't', 'l')} AS exact FROM scored) x WHERE exact >= CAST(0.7 AS DOUBLE)""",
    "stores", {"places": _PLACES, "candidates": _CANDIDATES, "scored": _MATCHES.replace("SELECT candidate_id, place_id AS store_id", "SELECT p, t, l, candidate_id, place_id AS store_id", 1)},
)
def _(d):
    matches = dedupe.check_duplicates(_candidates(d), d.stores, least=WARNING_AT)
    return matches.select("candidate_id", "store_id", "copies", "score", "decision", "rank")


@query(
    "p1_matched_stores",
    f"""SELECT m.candidate_id, s.id AS store_id, s.name AS store_name, s.address AS store_address, m.score, m.decision, m.rank FROM matches m
 JOIN (SELECT id AS place_id, {norm('name')} AS norm, lng, lat FROM stores) p ON p.place_id = m.store_id
 JOIN (SELECT *, {norm('name')} AS norm FROM stores) s ON s.norm = p.norm AND s.lng = p.lng AND s.lat = p.lat""",
    "stores", {"places": _PLACES, "candidates": _CANDIDATES, "matches": _MATCHES},
)
def _(d):
    found = dedupe.matched_stores(dedupe.check_duplicates(_candidates(d), d.stores), d.stores)
    return found.select("candidate_id", "store_id", "store_name", "store_address", "score", "decision", "rank")


@query(
    "p1_a6_overall_decisions",
    """SELECT c.candidate_id, CASE max(CASE m.decision WHEN 'reject' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'reject' WHEN 1 THEN 'warning' ELSE 'accept' END AS decision,
 count(m.store_id) AS matches FROM candidates c LEFT JOIN matches m ON m.candidate_id = c.candidate_id GROUP BY c.candidate_id""",
    "stores", {"places": _PLACES, "candidates": _CANDIDATES, "matches": _MATCHES},
)
def _(d):
    candidates = _candidates(d)
    return dedupe.overall_decisions(candidates, dedupe.check_duplicates(candidates, d.stores))


# --- road scans ---------------------------------------------------------------------------------------------
WAYS_PARSED = "SELECT * EXCLUDE (geom), CAST(json_extract(geom, '$.coordinates') AS DOUBLE[][]) AS c FROM ways"


@query(
    "s2_load_ways",
    """SELECT gid, source, target, len(c) AS points FROM w WHERE tag_id NOT IN (114, 117, 118, 119, 122) AND list_min(list_transform(c, lambda p: p[1])) <= 105.715
 AND list_max(list_transform(c, lambda p: p[1])) >= 105.705 AND list_min(list_transform(c, lambda p: p[2])) <= 10.02 AND list_max(list_transform(c, lambda p: p[2])) >= 10.005""",
    "ways", {"w": WAYS_PARSED},
)
def _(d):
    from placewise.operators.roads import load_ways

    ways = load_ways(d.ways, (105.705, 10.005, 105.715, 10.02))
    return ways.select("gid", "source", "target", F.size("coords").cast("bigint").alias("points"))


@query("s3_parse_linestring", "SELECT gid, c[1][1] AS first_lng, c[1][2] AS first_lat, c[-1][1] AS last_lng, c[-1][2] AS last_lat FROM w", "ways", {"w": WAYS_PARSED})
def _(d):
    w = d.ways.select("gid", parse_linestring(F.col("geom")).alias("c"))
    a, b = first_coord(F.col("c")), last_coord(F.col("c"))
    return w.select("gid", a["lng"].alias("first_lng"), a["lat"].alias("first_lat"), b["lng"].alias("last_lng"), b["lat"].alias("last_lat"))
