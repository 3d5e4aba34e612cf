"""Approvals, attachments, deletes, checks, knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, slug
from catalog.text_queries import kg_address_ctes, nine_district_ctes
from placewise.operators import kg
from placewise.operators import workflow as W
from placewise.operators.relational import with_category
from placewise.operators.spatial import clip_to_ring
from placewise.tables import materialize

_NOTES = "SELECT id, store_id, date_up, note FROM approvals WHERE status = 'approved' AND json_valid(note)"


def _latest(field: str, cte: str) -> str:
    return f"SELECT store_id, note->>'{field}' AS v FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY date_up DESC, id DESC) AS n FROM notes WHERE json_exists(note, '$.{field}')) x WHERE n = 1"


PATCHED_STORES = """SELECT s.id, CASE WHEN n.store_id IS NULL THEN s.name ELSE n.v END AS name, CASE WHEN p.store_id IS NULL THEN s.phone ELSE p.v END AS phone,
 CASE WHEN e.store_id IS NULL THEN s.email ELSE e.v END AS email, s.address, CASE WHEN g.store_id IS NULL THEN s.lat ELSE g.lat END AS lat,
 CASE WHEN g.store_id IS NULL THEN s.lng ELSE g.lng END AS lng, CASE WHEN c.store_id IS NULL THEN s.state ELSE 'active' END AS state
FROM stores s LEFT JOIN l_name n ON n.store_id = s.id LEFT JOIN l_phone p ON p.store_id = s.id LEFT JOIN l_email e ON e.store_id = s.id
LEFT JOIN l_point g ON g.store_id = s.id LEFT JOIN created c ON c.store_id = s.id"""
STORE_NOTES = {
    "notes": _NOTES, "l_name": _latest("name", ""), "l_phone": _latest("phone", ""), "l_email": _latest("email", ""),
    "l_point": """SELECT store_id, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY date_up DESC, id DESC) AS n FROM (
 SELECT store_id, id, date_up, TRY_CAST(note->>'latitude' AS DOUBLE) AS lat, TRY_CAST(note->>'longitude' AS DOUBLE) AS lng FROM notes) y WHERE lat IS NOT NULL AND lng IS NOT NULL) x WHERE n = 1""",
    "created": "SELECT DISTINCT store_id FROM notes WHERE note->>'action' = 'CREATE_NEW'",
}


@query("p9_patch_stores", PATCHED_STORES, "stores approvals", STORE_NOTES)
def _(d):
    return W.patch_stores(d.stores, d.approvals).select("id", "name", "phone", "email", "address", "lat", "lng", "state")


PATCHED_IMAGES = """SELECT i.id, i.store_id, CASE WHEN i.store_id IN (SELECT store_id FROM created) OR i.id IN (SELECT id FROM published) THEN 'public' ELSE i.state END AS state
FROM images i WHERE i.id NOT IN (SELECT id FROM deleted)"""
IMAGE_NOTES = {
    "notes": _NOTES, "created": "SELECT DISTINCT store_id FROM notes WHERE note->>'action' = 'CREATE_NEW'",
    "edits": "SELECT * FROM notes WHERE coalesce(note->>'action', '') <> 'CREATE_NEW'",
    "published": "SELECT unnest(CAST(note->'new_images' AS BIGINT[])) AS id FROM edits WHERE json_exists(note, '$.new_images')",
    "deleted": "SELECT unnest(CAST(note->'deleted_images' AS BIGINT[])) AS id FROM edits WHERE json_exists(note, '$.deleted_images')",
}


@query("p9_patch_images", PATCHED_IMAGES, "images approvals", IMAGE_NOTES)
def _(d):
    return W.patch_images(d.images, d.approvals).select("id", "store_id", "state")


# Every order priority clerk decides on the orders of the same number and on an earlier one.
_DECISIONS = """SELECT o_orderkey * 2 AS decision_id, o_orderkey AS approval_id, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'approved' END AS decision, o_custkey AS approver_id FROM orders
UNION ALL SELECT o_orderkey * 2 + 1, CAST(floor(o_orderkey / 2) AS BIGINT), 'rejected', o_custkey FROM orders"""
_CHECKED = """SELECT x.decision_id, x.approval_id, x.decision, x.approver_id, CASE WHEN a.id IS NULL THEN 'unknown approval' WHEN a.status <> 'pending' OR n > 1 THEN 'already decided'
 WHEN x.decision = 'approved' AND NOT json_valid(a.note) THEN 'unreadable note' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY decision_id) AS n FROM decisions) x LEFT JOIN approvals a ON a.id = x.approval_id"""


def _decided(d):
    from catalog.views import _at

    return W.decide_approvals(d.approvals, d.spark.sql(_at(_DECISIONS, d.folder)))


@query(
    "p10_decide_approvals", "SELECT a.id, coalesce(c.decision, a.status) AS status, c.approver_id FROM approvals a LEFT JOIN checked c ON c.approval_id = a.id AND c.reason IS NULL",
    "approvals", {"decisions": _DECISIONS, "checked": _CHECKED},
)
def _(d):
    return _decided(d)[0].select("id", "status", "approver_id")


@query("p10_refused_decisions", "SELECT decision_id, approval_id, decision, reason FROM checked WHERE reason IS NOT NULL", "approvals", {"decisions": _DECISIONS, "checked": _CHECKED})
def _(d):
    return _decided(d)[1]


_REQUESTS = "SELECT o_orderkey AS request_id, o_custkey AS store_id, concat(CAST(o_orderkey * 10 + 1 AS STRING), ', ', CAST(o_orderkey * 10 + 2 AS STRING), ',x,', CAST(o_orderkey * 10 - 9 AS STRING), ' ,') AS image_ids, concat('batch ', CAST(o_orderkey AS STRING)) AS txt, 'public' AS state FROM orders WHERE o_orderstatus = 'P'"


@query(
    "p11_attach_images",
    """SELECT i.id, coalesce(r.store_id, i.store_id) AS store_id, coalesce(r.txt, i."describe") AS caption, coalesce(r.state, i.state) AS state FROM images i LEFT JOIN (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY request_id DESC) AS n FROM (SELECT request_id, store_id, txt, state, TRY_CAST(trim(unnest(string_split(image_ids, ','))) AS BIGINT) AS id FROM req) x WHERE id IS NOT NULL) r ON r.id = i.id AND r.n = 1""",
    "images", {"req": _REQUESTS},
)
def _(d):
    from catalog.views import _at

    requests = d.spark.sql(_at(_REQUESTS, d.folder)).withColumnRenamed("txt", "describe")
    return W.attach_images(d.images, requests).select("id", "store_id", F.col("describe").alias("caption"), "state")


_GONE = "SELECT id FROM stores WHERE state = 'inactive' UNION SELECT id FROM stores WHERE category_id IN (3, 5)"


def _deleted(d):
    import functools

    inactive = d.stores.where("state = 'inactive'").select("id")
    doomed = d.categories.where("id in (3, 5)")
    gone = inactive.unionByName(W.delete_categories(d.stores, doomed))
    tables = {"stores": d.stores, "images": d.images, "approvals": d.approvals, "reviews": d.reviews, "favorites": d.favorites}
    left = W.delete_stores(tables, gone)
    users = d.users.where("not is_active").select("id")
    left["images"] = W.forget_users(left["images"], users, ["uploaded_by"])
    rows = [left["images"].select(F.lit("images").alias("tab"), "store_id", F.col("id"), F.col("uploaded_by").alias("ref"))]
    none = F.lit(None).cast("bigint")
    rows.append(left["stores"].select(F.lit("stores").alias("tab"), F.col("id").alias("store_id"), "id", none.alias("ref")))
    for name in ("approvals", "reviews"):
        rows.append(left[name].select(F.lit(name).alias("tab"), "store_id", "id", none.alias("ref")))
    rows.append(left["favorites"].select(F.lit("favorites").alias("tab"), "store_id", F.col("user_id").alias("id"), none.alias("ref")))
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "p12_delete_stores",
    """SELECT 'images' AS tab, store_id, id, CASE WHEN uploaded_by IN (SELECT id FROM users WHERE NOT is_active) THEN NULL ELSE uploaded_by END AS ref FROM images WHERE store_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'stores', id, id, NULL FROM stores WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'approvals', store_id, id, NULL FROM approvals WHERE store_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'reviews', store_id, id, NULL FROM reviews WHERE store_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'favorites', store_id, user_id, NULL FROM favorites WHERE store_id NOT IN (SELECT id FROM gone)""",
    "stores images approvals reviews favorites users", {"gone": _GONE},
)
def _(d):
    return _deleted(d)


@query("p13_check_reviews", "SELECT id, rating, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating must be 1 to 5' END AS reason FROM (SELECT id, rating + CAST(id % 3 AS INTEGER) AS rating FROM reviews) x", "reviews")
def _(d):
    shifted = d.reviews.select("id", (F.col("rating") + (F.col("id") % 3).cast("int")).alias("rating"))
    good, bad = W.check_reviews(shifted)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query(
    "p13_check_favorites",
    "SELECT id, user_id, store_id, CASE WHEN id > min(id) OVER (PARTITION BY user_id, store_id) THEN 'already a favourite' END AS reason FROM reviews", "reviews",
)
def _(d):
    good, bad = W.check_favorites(d.reviews.select("id", "user_id", "store_id"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("p13_check_categories", "SELECT p_partkey AS id, p_name AS slug FROM part QUALIFY p_partkey = min(p_partkey) OVER (PARTITION BY p_name)")
def _(d):
    return W.check_categories(d.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("slug")))[0]


# --- knowledge graph ----------------------------------------------------------------------------------------
_KG_ROWS = f"""SELECT s.id AS seq, 'Store:S' || CAST(s.id AS VARCHAR) AS st, 'S' || CAST(s.id AS VARCHAR) AS st_l,
 'Brand:' || {slug('s.name')} AS br, s.name AS br_l, 'Category:' || {slug('c.name')} AS ca, c.name AS ca_l, 'Address:' || {slug('s.address')} AS ad, s.address AS ad_l,
 CASE WHEN coalesce(s.phone, '') <> '' THEN 'Phone:' || {slug('s.phone')} END AS ph, s.phone AS ph_l,
 'Location:' || CAST(s.lat AS VARCHAR) || '_' || CAST(s.lng AS VARCHAR) AS lo, CAST(s.lat AS VARCHAR) || ', ' || CAST(s.lng AS VARCHAR) AS lo_l,
 CASE WHEN k.street <> '' THEN 'Street:' || {slug('k.street')} END AS sr, k.street AS sr_l, CASE WHEN k.ward <> '' THEN 'Ward:' || {slug('k.ward')} END AS wa, k.ward AS wa_l,
 'District:' || {slug('k.district')} AS di, k.district AS di_l, 'City:' || {slug('k.city')} AS ci, k.city AS ci_l
FROM stores s JOIN categories c ON c.id = s.category_id JOIN k_out k ON k.id = s.id"""
_KINDS = {"st": "Store", "br": "Brand", "ca": "Category", "ad": "Address", "ph": "Phone", "lo": "Location", "sr": "Street", "wa": "Ward", "di": "District", "ci": "City"}
_NODES = "SELECT node_id, max_by(label, seq) AS label, any_value(t) AS node_type FROM (" + " UNION ALL ".join(
    f"SELECT seq, {c} AS node_id, {c}_l AS label, '{t}' AS t FROM kg WHERE {c} IS NOT NULL" for c, t in _KINDS.items()) + ") x GROUP BY node_id"
_RULES = [
    ("st", "br", "HAS_BRAND", ""), ("st", "ca", "BELONGS_TO", ""), ("st", "ad", "LOCATED_AT", ""), ("st", "ph", "HAS_PHONE", ""), ("st", "lo", "HAS_GEO", ""),
    ("ad", "sr", "ON_STREET", ""), ("ad", "wa", "IN_WARD", ""), ("sr", "wa", "IN_WARD", ""), ("wa", "di", "IN_DISTRICT", ""), ("ad", "di", "IN_DISTRICT", "AND wa IS NULL"), ("di", "ci", "IN_CITY", ""),
]
_EDGES = "SELECT src, dst, max_by(relation, seq) AS relation FROM (" + " UNION ALL ".join(
    f"SELECT seq, {a} AS src, {b} AS dst, '{r}' AS relation FROM kg WHERE {a} IS NOT NULL AND {b} IS NOT NULL {w}" for a, b, r, w in _RULES) + ") x GROUP BY src, dst"
_KG = {**kg_address_ctes(), "kg": _KG_ROWS, "nodes": _NODES, "edges": _EDGES}


def _kg(d, **options):
    return kg.build_kg(with_category(d.stores, d.categories), **options)


def _stored_kg(d):
    """The graph as written tables, as a filter over a finished graph finds it."""
    nodes, edges = _kg(d)
    return materialize(nodes), materialize(edges)


@query("g1_kg_nodes", "SELECT node_id, label, node_type || ': ' || label AS title, node_type FROM nodes", "stores categories", _KG)
def _(d):
    return _kg(d)[0]


@query("g1_kg_edges", "SELECT * FROM edges", "stores categories", _KG)
def _(d):
    return _kg(d)[1]


_KG2_ROWS = f"""SELECT s.id AS seq, 'S' || CASE WHEN s.id < 1000 THEN lpad(CAST(s.id AS VARCHAR), 3, '0') ELSE CAST(s.id AS VARCHAR) END AS code, s.*, c.name AS category_name,
 n.street, n.district, n.city FROM stores s JOIN categories c ON c.id = s.category_id JOIN n_out n ON n.id = s.id"""
_EDGES2 = f"""SELECT src, dst, max_by(relation, seq) AS relation FROM (
SELECT seq, 'Store:' || code AS src, 'Brand:' || {slug('name')} AS dst, 'HAS_BRAND' AS relation FROM kg UNION ALL
SELECT seq, 'Store:' || code, 'Category:' || {slug('category_name')}, 'BELONGS_TO' FROM kg UNION ALL
SELECT seq, 'Store:' || code, 'Address:' || {slug('address')}, 'LOCATED_AT' FROM kg UNION ALL
SELECT seq, 'Store:' || code, 'Location:' || CAST(lat AS VARCHAR) || '_' || CAST(lng AS VARCHAR), 'HAS_GEO' FROM kg UNION ALL
SELECT seq, 'Store:' || code, 'Phone:' || {slug('trim(phone)')}, 'HAS_PHONE' FROM kg WHERE trim(coalesce(phone, '')) <> '' UNION ALL
SELECT seq, 'Store:' || code, 'Service:' || {slug('sv')}, 'PROVIDES' FROM (SELECT seq, code, trim(unnest(string_split("describe", ','))) AS sv FROM kg) v WHERE sv <> '' UNION ALL
SELECT seq, 'Address:' || {slug('address')}, 'Street:' || {slug('street')}, 'ON_STREET' FROM kg WHERE street <> '' UNION ALL
SELECT seq, 'Address:' || {slug('address')}, 'District:' || {slug('district')}, 'IN_DISTRICT' FROM kg WHERE district <> '' UNION ALL
SELECT seq, 'District:' || {slug('district')}, 'City:' || {slug('city')}, 'IN_CITY' FROM kg WHERE district <> '') x GROUP BY src, dst"""


@query("g2_kg_district_edges", "SELECT * FROM edges", "stores categories", {**nine_district_ctes(), "kg": _KG2_ROWS, "edges": _EDGES2})
def _(d):
    return _kg(d, variant="district")[1]


_FILTERED = {
    **_KG,
    "sw": "SELECT f.label AS s, max(t.label) AS w FROM edges e JOIN nodes f ON f.node_id = e.src AND f.node_type = 'Street' JOIN nodes t ON t.node_id = e.dst AND t.node_type = 'Ward' GROUP BY f.label",
    "wd": "SELECT f.label AS w, max(t.label) AS d FROM edges e JOIN nodes f ON f.node_id = e.src AND f.node_type = 'Ward' JOIN nodes t ON t.node_id = e.dst AND t.node_type = 'District' GROUP BY f.label",
    "und": "SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges",
    "near": "SELECT a, b FROM und UNION ALL SELECT x.a, y.b FROM und x JOIN und y ON y.a = x.b WHERE starts_with(x.b, 'Address:')",
    "att": "SELECT a, max(CASE WHEN node_type = 'District' THEN label END) AS d, max(CASE WHEN node_type = 'Ward' THEN label END) AS w, max(CASE WHEN node_type = 'Street' THEN label END) AS s FROM near JOIN nodes ON node_id = b GROUP BY a",
    "full1": "SELECT n.*, a.d, a.s, coalesce(a.w, sw.w) AS w FROM nodes n LEFT JOIN att a ON a.a = n.node_id LEFT JOIN sw ON sw.s = a.s",
    "full2": "SELECT f.node_id, f.label, f.node_type, coalesce(f.d, wd.d) AS d, f.w, f.s FROM full1 f LEFT JOIN wd ON wd.w = f.w",
}


@query(
    "g3_filter_kg",
    """SELECT f.node_id, f.label, f.node_type FROM full2 f LEFT JOIN sw ON sw.s = f.label AND f.node_type = 'Street' LEFT JOIN wd ON wd.w = CASE f.node_type WHEN 'Ward' THEN f.label ELSE sw.w END
WHERE f.node_type <> 'Phone' AND CASE f.node_type WHEN 'District' THEN f.label = 'Quận Ninh Kiều'
 WHEN 'Ward' THEN f.label = 'Phường Tân An' AND wd.d = 'Quận Ninh Kiều'
 WHEN 'Street' THEN f.label = 'Đường Mậu Thân' AND sw.w = 'Phường Tân An' AND (sw.w IS NULL OR wd.d = 'Quận Ninh Kiều')
 ELSE coalesce(f.d = 'Quận Ninh Kiều' AND f.w = 'Phường Tân An' AND f.s = 'Đường Mậu Thân', false) END""",
    "stores categories", _FILTERED,
)
def _(d):
    nodes, edges = _stored_kg(d)
    types = [t for t in kg.NODE_TYPES if t != "Phone"]
    return kg.filter_kg(nodes, edges, "Quận Ninh Kiều", "Phường Tân An", "Đường Mậu Thân", types).select("node_id", "label", "node_type")


RING = [(105.71, 9.9995), (105.75, 10.0), (105.8, 9.9999), (105.86, 10.0012), (105.8, 10.0021), (105.745, 10.0004), (105.72, 10.002), (105.71, 9.9995)]
_RING_SQL = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:]))


@query(
    "g14_clip_to_ring",
    f"""SELECT s.id FROM stores s JOIN (SELECT CAST(a AS DOUBLE) AS x1, CAST(b AS DOUBLE) AS y1, CAST(c AS DOUBLE) AS x2, CAST(d AS DOUBLE) AS y2 FROM (VALUES {_RING_SQL}) AS v(a, b, c, d)) e
ON (e.y1 > s.lat) <> (e.y2 > s.lat) AND s.lng < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY s.id HAVING count(*) % 2 = 1""",
    "stores",
)
def _(d):
    return clip_to_ring(d.stores, RING).select("id")
