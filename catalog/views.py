"""Domain views over the given tables, as SQL text that Spark and DuckDB both run.

Every view reads whole tables, so its size follows the scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from placewise.streaming.feeds import read_changes

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

GRID = 40  # nodes per row of the road grid

VIEWS: dict[str, str] = {}

VIEWS["categories"] = """
SELECT CAST(c.id AS BIGINT) AS id, c.name AS name, c.slug AS slug FROM (VALUES
 (1, 'Ẩm Thực', 'am-thuc'), (2, 'Đồ Uống', 'do-uong'), (3, 'Xe Cộ & Phương Tiện', 'xe-co'), (4, 'Mua Sắm', 'mua-sam'),
 (5, 'Công Nghệ & Điện Máy', 'cong-nghe'), (6, 'Siêu Thị & Tạp Hóa', 'sieu-thi'), (7, 'Y Tế & Sức Khỏe', 'y-te'),
 (8, 'Làm Đẹp & Spa', 'lam-dep'), (9, 'Giáo Dục', 'giao-duc'), (10, 'Lưu Trú', 'luu-tru'), (11, 'Giải Trí', 'giai-tri'),
 (12, 'Vận Tải & Kho Bãi', 'van-tai'), (13, 'Xây Dựng & Nội Thất', 'xay-dung'), (14, 'Hành Chính & Công Cộng', 'hanh-chinh'),
 (15, 'Tài Chính & Doanh Nghiệp', 'tai-chinh'), (16, 'Tôn Giáo', 'ton-giao'), (17, 'Nông Nghiệp & Thú Y', 'nong-nghiep')
) AS c(id, name, slug)"""

# Five stores share a block of about 18 m x 20 m; blocks lie on a 400-wide grid.
VIEWS["stores"] = """
SELECT p_partkey AS id, p_partkey % 17 + 1 AS category_id,
  concat(CASE p_partkey % 4 WHEN 0 THEN 'Cửa hàng ' WHEN 1 THEN 'CỬA HÀNG ' WHEN 2 THEN 'Tiệm ' ELSE '' END, p_name, ' ', p_brand) AS name,
  concat(
    CASE p_partkey % 13 WHEN 5 THEN '' WHEN 7 THEN concat('số ', CAST(p_size AS STRING), '/4A ') ELSE concat(CAST(p_size AS STRING), ' ') END,
    CASE p_partkey % 11 WHEN 0 THEN 'nguyen van cu' WHEN 1 THEN 'Đường 30/4' WHEN 2 THEN 'CMT8' WHEN 3 THEN 'Mậu Thân'
      WHEN 4 THEN 'hẻm Hòa Bình' WHEN 5 THEN 'Đường Đường Trần Phú' WHEN 6 THEN 'Nguyễn Văn Cừ nối dài' WHEN 7 THEN 'đường 3 tháng 2'
      WHEN 8 THEN 'phan bội châu' WHEN 9 THEN 'văn cự' ELSE 'Đ. Lê Lợi' END,
    CASE WHEN p_partkey % 19 = 3 THEN '' WHEN p_partkey % 23 = 4 THEN ' - Cái Răng' ELSE concat(', ',
      CASE p_partkey % 7 WHEN 0 THEN 'P.AN KHÁNH' WHEN 1 THEN 'Phường Tân An' WHEN 2 THEN 'xuan khanh' WHEN 3 THEN 'Cái Khế'
        WHEN 4 THEN 'p.ak' WHEN 5 THEN 'thiếu' ELSE 'Phường Phường Hưng Lợi' END) END,
    CASE p_partkey % 8 WHEN 0 THEN ', NK' WHEN 1 THEN '' WHEN 2 THEN ', Bình Thủy' ELSE ', Quận Ninh Kiều' END,
    CASE p_partkey % 6 WHEN 0 THEN ', TPCT' WHEN 1 THEN '' ELSE ', Thành phố Cần Thơ' END) AS address,
  CASE p_partkey % 5 WHEN 0 THEN concat('+84 9', CAST(10000000 + p_partkey AS STRING))
    WHEN 1 THEN concat('84.9', CAST(10000000 + p_partkey AS STRING), ' | 02923 ', CAST(100000 + p_partkey % 899999 AS STRING))
    WHEN 2 THEN '1900 1234 | 1900-1234' WHEN 3 THEN NULL ELSE concat('09', CAST(10000000 + p_partkey AS STRING), '|x12') END AS phone,
  CASE WHEN p_partkey % 3 = 0 THEN concat('s', CAST(p_partkey AS STRING), '@example.com') ELSE NULL END AS email,
  concat(p_type, ', ', p_brand) AS describe,
  CAST(10.0 + floor(floor(p_partkey / 5) / 400) * 0.0005 + (p_partkey * 31 % 5) * 0.00004 AS DOUBLE) AS lat,
  CAST(105.7 + (CAST(floor(p_partkey / 5) AS BIGINT) % 400) * 0.0005 + (p_partkey * 17 % 7) * 0.00003 AS DOUBLE) AS lng,
  CASE WHEN p_partkey % 10 = 9 THEN 'inactive' ELSE 'active' END AS state,
  '07:30' AS open_time, '21:00' AS close_time,
  p_retailprice AS price
FROM part"""

# All customers' shops on one spot: two invented words each, and a third that every other one has. Some names come in near versions.
VIEWS["market"] = """
SELECT c_custkey AS id, CAST(105.78 + c_custkey * 0 AS DOUBLE) AS lng, CAST(10.03 + c_custkey * 0 AS DOUBLE) AS lat,
  concat(substr(h, 1, 6 + c_custkey % 3), CASE WHEN c_custkey % 2 = 0 THEN ' quan ' ELSE ' ' END, substr(h, 11, 4 + c_custkey % 5)) AS name
FROM (SELECT c_custkey, translate(md5(CAST(c_custkey - CASE WHEN c_custkey % 90 < 3 THEN c_custkey % 90 ELSE 0 END AS STRING)), '0123456789', 'aeiouymnpt') AS h FROM customer) AS hashed"""

VIEWS["reviews"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS user_id, l_partkey AS store_id,
  CAST(l_quantity AS INT) % 5 + 1 AS rating, l_shipdate AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["favorites"] = """
SELECT DISTINCT o_custkey AS user_id, l_partkey AS store_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""

VIEWS["users"] = """
SELECT c_custkey AS id, c_name AS username, CASE c_mktsegment WHEN 'BUILDING' THEN 'ADMIN' ELSE 'USER' END AS role,
  c_acctbal > 0 AS is_active FROM customer"""

VIEWS["images"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS store_id, concat('stores/', CAST(l_orderkey AS STRING), '.jpg') AS image,
  concat('view ', CAST(l_linenumber AS STRING)) AS describe, l_suppkey AS uploaded_by,
  CASE l_returnflag WHEN 'R' THEN 'public' ELSE 'private' END AS state FROM lineitem"""

VIEWS["search_history"] = """
SELECT event_id AS id, user_id, ts AS created_at,
  CASE event_id % 6 WHEN 0 THEN 'Cafe' WHEN 1 THEN 'cafe' WHEN 2 THEN 'Nhà thuốc'
    WHEN 3 THEN 'khách sạn gần đây' WHEN 4 THEN 'widget' ELSE 'mậu thân' END AS keyword
FROM events"""

# The location of a search is where the event's user is; a quarter of the searches has none.
VIEWS["search_queries"] = """
SELECT event_id AS query_id,
  CASE event_id % 8 WHEN 0 THEN 'Cafe' WHEN 1 THEN 'gần đây' WHEN 2 THEN 'Nhà thuốc' WHEN 3 THEN 'khách sạn gần đây'
    WHEN 4 THEN 'widget' WHEN 5 THEN 'mậu thân ở đâu' WHEN 6 THEN concat('Brand#', CAST(event_id % 25 AS STRING)) ELSE 'tiệm' END AS keyword,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(105.7 + (user_id % 50) * 0.004 AS DOUBLE) END AS lng,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(10.0 + (user_id % 7) * 0.0003 AS DOUBLE) END AS lat
FROM events"""

VIEWS["approvals"] = """
SELECT o_orderkey AS id, o_custkey AS store_id, o_custkey * 7 % 1000 AS submitter_id,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  o_orderdate AS date_up,
  CASE WHEN o_orderkey % 11 = 5 THEN '{broken' ELSE
  concat('{"name":"store v', CAST(o_orderkey AS STRING), '","latitude":"10.05"',
    CASE WHEN o_orderkey % 3 = 0 THEN concat(',"longitude":"', CASE WHEN o_orderkey % 2 = 0 THEN '105.78' ELSE 'east' END, '"') ELSE '' END,
    CASE WHEN o_orderkey % 4 = 0 THEN ',"phone":null' ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN concat(',"email":"o', CAST(o_orderkey AS STRING), '@example.com"') ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0 THEN ',"action":"CREATE_NEW"' ELSE '' END,
    CASE WHEN o_orderkey % 9 = 0 THEN concat(',"new_images":[', CAST(o_orderkey * 10 + 1 AS STRING), ',', CAST(o_orderkey * 10 + 2 AS STRING),
      '],"deleted_images":[', CAST(o_orderkey * 10 + 3 AS STRING), ']') ELSE '' END, '}') END AS note
FROM orders"""

# Node n of the grid lies at (105.70 + column * 0.001, 10 + row * 0.001). Every fifth edge has a bend.
VIEWS["ways"] = f"""
SELECT gid, source, target, cost, reverse_cost, length_m, name, tag_id,
  concat('{{"type":"LineString","coordinates":[[', x1, ',', y1, '],',
    CASE WHEN gid % 5 = 0 THEN concat('[', xm, ',', ym, '],') ELSE '' END, '[', x2, ',', y2, ']]}}') AS geom
FROM (SELECT k.gid, k.node AS source, k.target, CAST(1 AS DOUBLE) AS cost,
  CAST(CASE WHEN k.gid % 7 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS reverse_cost,
  CAST(112 + (k.gid * 37) % 100 AS DOUBLE) AS length_m,
  CASE WHEN k.d = 0 THEN concat('Phố ', CAST(CAST(floor(k.node / {GRID}) AS BIGINT) AS STRING))
    ELSE concat('Hẻm ', CAST(k.node % {GRID} AS STRING)) END AS name,
  CASE WHEN k.gid % 31 = 0 THEN 114 ELSE 100 END AS tag_id,
  CAST(CAST(105.7 + (k.node % {GRID}) * 0.001 AS DECIMAL(9, 4)) AS STRING) AS x1,
  CAST(CAST(10 + floor(k.node / {GRID}) * 0.001 AS DECIMAL(9, 4)) AS STRING) AS y1,
  CAST(CAST(105.7 + (k.node % {GRID}) * 0.001 + CASE k.d WHEN 0 THEN 0.0005 ELSE 0.0001 END AS DECIMAL(9, 4)) AS STRING) AS xm,
  CAST(CAST(10 + floor(k.node / {GRID}) * 0.001 + CASE k.d WHEN 0 THEN 0.0001 ELSE 0.0005 END AS DECIMAL(9, 4)) AS STRING) AS ym,
  CAST(CAST(105.7 + (k.node % {GRID} + 1 - k.d) * 0.001 AS DECIMAL(9, 4)) AS STRING) AS x2,
  CAST(CAST(10 + (floor(k.node / {GRID}) + k.d) * 0.001 AS DECIMAL(9, 4)) AS STRING) AS y2
FROM (SELECT p_partkey AS node, 0 AS d, p_partkey * 2 AS gid, p_partkey + 1 AS target FROM part WHERE p_partkey % {GRID} < {GRID - 1}
  UNION ALL SELECT p_partkey AS node, 1 AS d, p_partkey * 2 + 1 AS gid, p_partkey + {GRID} AS target FROM part) k
JOIN part m ON m.p_partkey = k.target) AS edges"""

# Every customer asks for a route between two points a few blocks apart.
VIEWS["route_requests"] = f"""
SELECT c_custkey AS query_id,
  CAST(105.7 + (c_custkey % {GRID}) * 0.001 + 0.0003 AS DOUBLE) AS start_lng,
  CAST(10 + floor(c_custkey / {GRID}) * 0.001 + 0.0001 AS DOUBLE) AS start_lat,
  CAST(105.7 + least(c_custkey % {GRID} + c_custkey * 7 % 5, {GRID - 1}) * 0.001 + 0.0001 AS DOUBLE) AS end_lng,
  CAST(10 + (floor(c_custkey / {GRID}) + c_custkey * 11 % 4) * 0.001 + 0.0004 AS DOUBLE) AS end_lat
FROM customer"""

# The roads and, far from them, an island.
VIEWS["wide_ways"] = """
SELECT * FROM ways
UNION ALL
SELECT 900000000 + r_regionkey AS gid, 900000000 + r_regionkey AS source, 900000001 + r_regionkey AS target, CAST(1 AS DOUBLE) AS cost, CAST(1 AS DOUBLE) AS reverse_cost,
  CAST(100 AS DOUBLE) AS length_m, 'Đảo' AS name, 100 AS tag_id,
  concat('{"type":"LineString","coordinates":[[', CAST(CAST(106.2 + r_regionkey * 0.001 AS DECIMAL(9, 4)) AS STRING), ',10.0],[', CAST(CAST(106.201 + r_regionkey * 0.001 AS DECIMAL(9, 4)) AS STRING), ',10.0]]}') AS geom
FROM region"""

# From one end of the grid to the other; every fifth one to the island.
VIEWS["long_requests"] = f"""
SELECT CAST(n_nationkey AS BIGINT) AS query_id,
  CAST(105.7 + (n_nationkey * 7 % {GRID}) * 0.001 + 0.0003 AS DOUBLE) AS start_lng, CAST(10 + (n_nationkey % 4) * 0.001 + 0.0001 AS DOUBLE) AS start_lat,
  CAST(CASE WHEN n_nationkey % 5 = 4 THEN 106.2024 ELSE 105.7 + (n_nationkey * 11 % {GRID}) * 0.001 + 0.0001 END AS DOUBLE) AS end_lng,
  CAST(CASE WHEN n_nationkey % 5 = 4 THEN 10.0001 ELSE 10 + (last_row - 1 - n_nationkey % 3) * 0.001 + 0.0004 END AS DOUBLE) AS end_lat
FROM nation JOIN (SELECT CAST(floor(max(p_partkey) / {GRID}) AS BIGINT) AS last_row FROM part) AS m ON last_row >= 0"""

VIEWS["points"] = """
SELECT query_id AS point_id, start_lng AS lng, start_lat AS lat FROM route_requests
UNION ALL
SELECT s_suppkey + 1000000000 AS point_id, CAST(105.6 + (s_suppkey * 13 % 97) * 0.003 AS DOUBLE) AS lng,
  CAST(9.9 + (s_suppkey * 29 % 89) * 0.004 AS DOUBLE) AS lat FROM supplier"""

VIEWS["ocr_lines"] = """
SELECT conv_id AS image_id, turn AS line_no,
  CASE (conv_id + turn) % 9 WHEN 0 THEN concat('ĐT: 09', CAST(10000000 + conv_id AS STRING), ' - Fax: 0292 3 ', CAST(100000 + turn AS STRING))
    WHEN 1 THEN concat('Địa chỉ: ', CAST(turn + 1 AS STRING), ' Nguyễn Trãi, phường An Hội')
    WHEN 2 THEN 'NHÀ THUỐC HUỲNH LỘC' WHEN 3 THEN concat(CAST(conv_id AS STRING), ' đường Mậu Thân, quận Ninh Kiều')
    WHEN 4 THEN 'Hotline 1900 1234' WHEN 5 THEN concat('email: shop', CAST(conv_id AS STRING), 'Qgmail.com www.shop', CAST(conv_id AS STRING), '.vn')
    ELSE text END AS text,
  CAST(10 + (conv_id * 13 + turn * 7) % 40 AS DOUBLE) AS min_x, CAST(turn * 30 AS DOUBLE) AS min_y,
  CAST(10 + (conv_id * 13 + turn * 7) % 40 + 6 * length(text) AS DOUBLE) AS max_x,
  CAST(turn * 30 + 12 + (conv_id + turn) % 20 AS DOUBLE) AS max_y
FROM conversations"""

# Word boxes: each line of a sign is cut into boxes with jitter in height and position.
VIEWS["boxes"] = " UNION ALL ".join(f"""
SELECT conv_id AS sign_id, turn * 10 + {n} AS box_id,
  CAST({n} * 60 + (conv_id * 7 + turn * 11 + {n} * 5) % 37 AS DOUBLE) AS min_x,
  CAST(turn * 34 + (conv_id * 3 + turn * 5 + {n} * 7) % 15 AS DOUBLE) AS min_y,
  CAST({n} * 60 + (conv_id * 7 + turn * 11 + {n} * 5) % 37 + 30 + length(text) % 20 AS DOUBLE) AS max_x,
  CAST(turn * 34 + (conv_id * 3 + turn * 5 + {n} * 7) % 15 + 10 + (conv_id + turn * {n}) % 25 AS DOUBLE) AS max_y
FROM conversations WHERE {n} <= turn + 1""" for n in range(4))

VIEWS["detections"] = """
SELECT conv_id AS image_id, turn AS box_id, CAST((conv_id * 37 + turn * 61) % 100 AS DOUBLE) / 100 AS conf,
  CAST(turn * 10 AS INT) AS x1, CAST(turn * 5 AS INT) AS y1, CAST(turn * 10 + 90 AS INT) AS x2, CAST(turn * 5 + 40 AS INT) AS y2
FROM conversations"""

VIEWS["variants"] = " UNION ALL ".join(f"""
SELECT conv_id AS image_id, turn AS line_no, {n} AS variant_order,
  CAST((conv_id * 31 + turn * 17 + {n} * 23) % 41 + 60 AS DOUBLE) / 100 AS prob,
  CASE WHEN (conv_id + turn) % 13 = 0 THEN '…' ELSE concat(text, ' {n}') END AS text
FROM conversations""" for n in range(4))

VIEWS["extractions"] = """
SELECT conv_id AS sign_id, turn, concat('sign ', CAST(conv_id AS STRING)) AS remaining_text,
  CASE (conv_id + turn) % 6
    WHEN 0 THEN concat('Answer: {"BRAND": [" Shop ', CAST(conv_id AS STRING), ' ", "", "Shop ', CAST(conv_id AS STRING), '"], "SERVICE": ["a", "b", "a"], "O": []} done')
    WHEN 1 THEN '{"BRAND": "single", "SERVICE": [], "O": ["x"]}'
    WHEN 2 THEN '{"BRAND": [], "SERVICE": []}' WHEN 3 THEN 'no json at all' WHEN 4 THEN '{"BRAND": ["open"'
    ELSE '{"SERVICE": ["only service"]}' END AS answer
FROM conversations"""

_NEEDS = {"points": ["route_requests"], "wide_ways": ["ways"]}


def _with_needs(names: list[str]) -> list[str]:
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    return wanted


def sql_with(names: list[str], query: str) -> str:
    """A query preceded by the named views, for an engine that has only the given tables."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _with_needs(names)) + "\n" + query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame over the parquet files of ``sf_dir``."""
    text = _double_floor(sql_with(_NEEDS.get(name, []), f"SELECT * FROM ({VIEWS[name]}) AS v") if name in _NEEDS else VIEWS[name])
    # Qualify the given tables by their file, so nothing depends on registered names.
    return spark.sql(_at(text, sf_dir))


def _double_floor(text: str) -> str:
    """``floor`` gives a double as in the comparison engine; Spark's whole number would turn its products into exact decimals, other in the last bit."""
    return re.sub(r"\bfloor\(", "1D * floor(", text)


def _at(text: str, sf_dir: str) -> str:
    pattern = r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b"
    return re.sub(pattern, lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` {'' if _aliased(text, m.end()) else m[2]}", text)


def stream_view(spark: SparkSession, sf_dir: str, name: str, source: str) -> DataFrame:
    """A domain view over one given table, read as a stream."""
    changes = read_changes(spark, sf_dir, table(spark, sf_dir, source).schema, f"{source}.parquet")
    changes.createOrReplaceTempView(f"stream_of_{source}")
    return spark.sql(re.sub(rf"\bFROM {source}\b", f"FROM stream_of_{source}", _double_floor(VIEWS[name])))


def _aliased(text: str, end: int) -> bool:
    following = re.match(r"\s+(\w+)", text[end:])
    return bool(following) and following[1].upper() not in {"WHERE", "JOIN", "ON", "CROSS", "UNION", "GROUP", "ORDER"}
