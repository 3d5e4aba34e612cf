"""Sign reading, form filling, classification, corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, r4, sql_r4
from catalog.text_queries import _ordered_distinct
from placewise.functions import contact
from placewise.operators import ocr
from placewise.operators import search as S
from placewise.operators.relational import label_counts
from placewise.plans import corpus, signs


@query(
    "p3_w6_best_variant",
    """SELECT image_id, line_no, variant_order, prob, text FROM (
 SELECT *, row_number() OVER (PARTITION BY image_id, line_no ORDER BY prob DESC, variant_order) AS n FROM (
  SELECT v.*, min(CASE WHEN prob > 0.88 THEN variant_order END) OVER (PARTITION BY image_id, line_no) AS stop FROM variants v) x
 WHERE stop IS NULL OR variant_order <= stop) y WHERE n = 1 AND prob > 0.8 AND length(trim(text)) >= 2 AND regexp_matches(text, '[a-zA-Z0-9]')""",
    "variants",
)
def _(d):
    return ocr.best_variant(d.variants)


_RANKED = """SELECT image_id, box_id, conf, CAST(row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, box_id) - 1 AS INTEGER) AS sign_index,
 printf('%.1f%%', conf * 100) AS conf_pct, count(*) OVER (PARTITION BY image_id) > 1 AS multiple, count(*) OVER (PARTITION BY image_id) AS n
FROM detections WHERE conf > 0.6"""


@query("p4_rank_signs", "SELECT image_id, box_id, conf, sign_index, conf_pct, multiple FROM r", "detections", {"r": _RANKED})
def _(d):
    return ocr.rank_signs(d.detections).select("image_id", "box_id", "conf", "sign_index", "conf_pct", "multiple")


@query(
    "p4_choose_sign",
    "SELECT image_id, box_id FROM r WHERE sign_index = CASE WHEN image_id % 4 >= n THEN 0 ELSE image_id % 4 END", "detections", {"r": _RANKED},
)
def _(d):
    wishes = d.detections.select("image_id").distinct().withColumn("wanted", F.col("image_id") % 4)
    return ocr.choose_sign(ocr.rank_signs(d.detections), wishes).select("image_id", "box_id")


# The running means as a recursion over the boxes of a sign from top to bottom.
_BANDS = {
    "sized": "SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, max_y - min_y AS h, row_number() OVER (PARTITION BY sign_id ORDER BY (min_y + max_y) / 2, box_id) AS i FROM boxes",
    "band": """SELECT sign_id, i, CAST(0 AS BIGINT) AS band, cy AS scy, h AS sh, CAST(1 AS DOUBLE) AS n FROM sized WHERE i = 1
 UNION ALL SELECT s.sign_id, s.i, CASE WHEN j THEN band ELSE band + 1 END, CASE WHEN j THEN scy ELSE 0 END + cy, CASE WHEN j THEN sh ELSE 0 END + h, CASE WHEN j THEN n ELSE 0 END + 1
 FROM (SELECT s.sign_id, s.i, s.cy, s.h, b.band, b.scy, b.sh, b.n, abs(s.cy - b.scy / b.n) <= greatest(s.h, b.sh / b.n) * CAST(0.6 AS DOUBLE) AS j
  FROM band b JOIN sized s ON s.sign_id = b.sign_id AND s.i = b.i + 1) s""",
    "banded": "SELECT s.*, b.band FROM sized s JOIN band b ON b.sign_id = s.sign_id AND b.i = s.i",
    "lagged": "SELECT *, lag(h) OVER w AS ph, lag(max_x) OVER w AS px FROM banded WINDOW w AS (PARTITION BY sign_id, band ORDER BY cx, cy, box_id)",
    "cutted": "SELECT *, CASE WHEN ph IS NOT NULL AND (greatest(h, ph) / (least(h, ph) + CAST(1e-5 AS DOUBLE)) > 2 OR min_x - px > (h + ph) / 2 * CAST(1.2 AS DOUBLE)) THEN 1 ELSE 0 END AS cut FROM lagged",
    "pieces": "SELECT *, sum(cut) OVER (PARTITION BY sign_id, band ORDER BY cx, cy, box_id ROWS UNBOUNDED PRECEDING) AS piece FROM cutted",
}


@query(
    "p2_w7_group_ocr_lines",
    "SELECT sign_id, CAST(dense_rank() OVER (PARTITION BY sign_id ORDER BY band, piece) - 1 AS INTEGER) AS line_no, box_id, min_x FROM pieces", "boxes", _BANDS,
)
def _(d):
    return ocr.group_ocr_lines(d.boxes).select("sign_id", "line_no", "box_id", "min_x")


@query("t16_read_lines")
def _(d):
    read = ocr.read_lines(d.ocr_lines)
    return read.select("image_id", "line_no", F.array_join("phones", "|").alias("phones"), "address", "rest")


def _answers(d):
    # One answer per image: that of its first turn.
    first = d.extractions.groupBy("sign_id").agg(F.min_by("answer", "turn").alias("answer"))
    return first.withColumnRenamed("sign_id", "image_id")


def _assembled(d):
    return signs.assemble_signs(d.ocr_lines, _answers(d))


@query("p5_assemble_signs")
def _(d):
    lists = [F.array_join(c, "|").alias(c) for c in ("brand", "service", "other", "address", "phone", "email", "website")]
    return _assembled(d).select("image_id", *lists, "class_text")


_LISTS = """SELECT conv_id, turn, list_filter(string_split(text, '.'), lambda v: trim(v) <> '') AS other, CASE WHEN turn % 3 = 0 THEN ['0912345678', '12/4 le loi'] WHEN turn % 3 = 1 THEN ['nguyễn trãi shop', ''] ELSE ['phố 12/3', text] END AS raw FROM conversations"""
_LIKE = rf"regexp_matches(trim(v), '{contact.PHONE_LIKE}') OR regexp_matches(trim(v), '(?i)\d+/\d*|\b(?:{'|'.join(contact.ADDRESS_WORDS_LEFT + contact.ADDRESS_WORDS_RIGHT)})\b')"


@query(
    "f13_name_suggestions",
    f"""SELECT conv_id, turn, array_to_string(list_filter(u, lambda v: v <> '0912345678' AND NOT ({_LIKE})), '|') AS names
FROM (SELECT conv_id, turn, list_filter(l, lambda v, i: v <> '' AND list_position(l, v) = i) AS u FROM (SELECT conv_id, turn, list_concat(other, raw) AS l FROM x) y) z""",
    extra={"x": _LISTS},
)
def _(d):
    t = F.col("turn") % 3
    raw = (
        F.when(t == 0, F.array(F.lit("0912345678"), F.lit("12/4 le loi"))).when(t == 1, F.array(F.lit("nguyễn trãi shop"), F.lit("")))
        .otherwise(F.array(F.lit("phố 12/3"), F.col("text")))
    )
    other = F.filter(F.split("text", r"\."), lambda v: F.trim(v) != "")
    names = S.name_suggestions(other, raw, F.array(F.lit("0912345678")), F.array().cast("array<string>"))
    return d.conversations.select("conv_id", "turn", F.array_join(names, "|").alias("names"))


@query(
    "f14_prefill",
    """SELECT id, CASE WHEN trim(coalesce(email, '')) <> '' THEN email ELSE coalesce(nullif(CASE WHEN id % 2 = 0 THEN 'a@b.vn' END, ''), email) END AS email,
 CASE WHEN trim(CASE WHEN id % 5 = 0 THEN '  ' ELSE address END) <> '' THEN address ELSE coalesce(CASE WHEN id % 10 = 0 THEN 'sign' END, 'gps') END AS address FROM stores""",
    "stores",
)
def _(d):
    email = S.prefill(F.col("email"), F.when(F.col("id") % 2 == 0, "a@b.vn"))
    old = F.when(F.col("id") % 5 == 0, "  ").otherwise(F.col("address"))
    return d.stores.select("id", email.alias("email"), S.prefill(old, F.when(F.col("id") % 10 == 0, "sign"), F.lit("gps")).alias("address"))


def _vocabulary(d):
    """Keywords are part names, prefixes their types, suffixes their brands; the label is the part's size class."""
    p = d.part.withColumn("label", F.concat(F.lit("size "), (F.col("p_size") % 17).cast("string")))
    return p.groupBy("label").agg(
        F.array_sort(F.collect_set("p_name")).alias("keywords"), F.array_sort(F.collect_set("p_type")).alias("prefixes"),
        F.array_sort(F.collect_set("p_brand")).alias("suffixes"),
    )


@query("p7_generate_corpus")
def _(d):
    return corpus.generate_corpus(_vocabulary(d), ["An", "Bình", "Cường"], per_label=300)


@query("p7_a4_corpus_labels", "SELECT DISTINCT 'size ' || CAST(p_size % 17 AS VARCHAR) AS label, CAST(300 AS BIGINT) AS rows FROM part")
def _(d):
    return label_counts(corpus.generate_corpus(_vocabulary(d), ["An", "Bình", "Cường"], per_label=300))


@query("p6_classify_signs")
def _(d):
    # Train on the parts: the label is the last word of the name, to be learned from name and type.
    words = d.part.select(F.concat_ws(" ", "p_name", "p_type").alias("text"), F.substring_index("p_name", " ", -1).alias("label"))
    model = signs.train_categories(words)
    asked = d.part.select(
        F.col("p_partkey").alias("image_id"), F.when(F.col("p_partkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("texts"),
        F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("class_text"),
    )
    return signs.classify(asked, model).select("image_id", "category")
