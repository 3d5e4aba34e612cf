"""Sign reading after recognition: choose variants and signs, group boxes, pick phones and addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from placewise.functions.formats import percent_text
from placewise.functions.text import is_valid_ocr_text

# --- Fixed values -------------------------------------------------------------------------------------------
STOP_PROB, KEEP_PROB, SIGN_CONF = 0.88, 0.8, 0.6
BAND_SHARE, SIZE_RATIO, GAP_SHARE = 0.6, 2.0, 1.2
PHONE_LABELS = (
    r"(?:điện thoại(?: liên hệ| di động)?|di động|dđ|tổng đài|cskh|chăm sóc khách hàng|tel|hotline|sđt|sdt|đt|phone"
    r"|zalo|call|liên hệ|mobi|fax)"
)
PHONE = (
    r"(?iuU)(?:" + PHONE_LABELS + r"\s*[:\-\.]?\s*)?((?:\+84|0|1800|1900|\(\s*\d{2,5}\s*\))"
    r"(?:(?!\s*[\-,\./]\s*(?:\+84|0|1800|1900)(?:[\s\.\-]*\d){7})[ \-\.\d]){4,15})(?=\b|[^\d])"
)
ADDRESS_LABELS = (
    r"(?:đ[iị]a ch[iỉ](?:\s*(?:đkkd|đăng ký kinh doanh|liên hệ|giao dịch))?|đ/c|đc|add(?:ress)?|trụ sở(?: chính)?"
    r"|cơ sở\s*\d+|chi nhánh\s*\d+|cn[\.\s]*\d+)"
)
REMOVED_LABELS = (
    r"(?iuU)^(?:đ[iị]a ch[iỉ](?:\s*(?:đkkd|đăng ký kinh doanh|liên hệ|giao dịch))?|đ/c|đc|add(?:ress)?)\s*[:\-]*\s*"
)
BRANCH_LABELS = r"(?iuU)^(cn[\.\s]*\d+|cơ sở\s*\d+|chi nhánh\s*\d+)\s*[:\-]+\s*"
ADMIN_WORDS = (
    r"\b(phường|quận|huyện|tỉnh|thành phố|thị xã|thị trấn|tp\.|q\.|p\.|tx\.|h\.|khu phố|kp\.|thôn|ấp|đường|quốc lộ"
    r"|ql\d*|đại lộ|khu vực|kv|ninh kiều|bình thủy|cái răng|ô môn|thốt nốt|phong điền|cờ đỏ|thới lai|vĩnh thạnh)\b"
)
CITY_WORDS = r"(?iuU)\b(tỉnh|thành phố|tp\.)\b"
SHORT_ADDRESS = (
    r"(?iuU)^\s*(?:số|lô|kiot|ki-ốt|quầy|tầng|lầu\s+)?(?:[a-zA-Z]+\d+|\d+[a-zA-Z]*)(?:/\d{1,4}[a-zA-Z]?)?"
    r"\s+[^\W\d_]+\s+[^\W\d_]+"
)
BUSINESS_STARTS = (
    "công ty|cty|dntn|doanh nghiệp|nhà thuốc|siêu thị|tạp hóa|trái cây|cửa hàng|đại lý|quán|nhà hàng|trung tâm|bệnh viện"
    "|trường|salon|spa|chuyên|phòng khám|shop|store|gara|garage|hotel|khách sạn|nhà nghỉ|văn phòng|vpgd|showroom|kho|xưởng"
    "|ủy ban|ubnd|sở|ban|bộ|ngân hàng|doanh trại|tiệm|htx|nha khoa|răng hàm mặt|thẩm mỹ|viện|trạm|chợ|bánh mì|bánh tráng"
    "|cơ sở|tòa án|công an|chi cục|tổng cục|đài|nhà văn hóa|đảng bộ|chi bộ|hội đồng|đoàn"
)
# ------------------------------------------------------------------------------------------------------------


def best_variant(variants: DataFrame) -> DataFrame:
    """Best recognition per (image_id, line_no): variants up to the first one above the stop probability; the
    greatest probability wins, the earliest on ties; kept if good enough and valid text."""
    line = ["image_id", "line_no"]
    stop = variants.where(F.col("prob") > STOP_PROB).groupBy(*line).agg(F.min("variant_order").alias("_stop"))
    tried = variants.join(stop, line, "left").where(F.col("_stop").isNull() | (F.col("variant_order") <= F.col("_stop")))
    best = tried.groupBy(*line).agg(
        F.max_by(F.struct("variant_order", "prob", "text"), F.struct("prob", -F.col("variant_order"))).alias("b")
    ).select(*line, "b.*")
    return best.where((F.col("prob") > KEEP_PROB) & is_valid_ocr_text(F.col("text")))


def rank_signs(detections: DataFrame, min_conf: float = SIGN_CONF) -> DataFrame:
    """Signs above ``min_conf`` per image by confidence: index, percent text, are there several."""
    image = Window.partitionBy("image_id")
    kept = detections.where(F.col("conf") > min_conf).withColumn("conf", F.round("conf", 4))
    return kept.withColumns({
        "sign_index": F.row_number().over(image.orderBy(F.col("conf").desc(), "box_id")) - 1,
        "conf_pct": percent_text(F.col("conf")),
        "multiple": F.count("*").over(image) > 1,
    })


def choose_sign(ranked: DataFrame, wishes: DataFrame) -> DataFrame:
    """The sign each image asks for (image_id, wanted); an index out of range means the first."""
    per_image = ranked.withColumn("_n", F.count("*").over(Window.partitionBy("image_id")))
    picked = F.when(F.col("wanted") >= F.col("_n"), 0).otherwise(F.col("wanted"))
    return per_image.join(wishes, "image_id").where(F.col("sign_index") == picked).drop("_n", "wanted")


def _number_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``band`` to boxes sorted by stretch and vertical centre; a band keeps running means of centre and height.

    Only the sums of the current band are carried, also from one batch to the next. A box without a centre is a band of its own.
    """
    key, band, sum_cy, sum_h, n = None, -1, 0.0, 0.0, 0
    for batch in batches:
        bands = []
        for sign, stretch, cy, h in zip(*[batch.column(c).to_pylist() for c in ("sign_id", "_stretch", "cy", "h")]):
            if (sign, stretch) != key:
                key, band, n = (sign, stretch), -1, 0
            joins = n and cy is not None and abs(cy - sum_cy / n) <= max(h, sum_h / n) * BAND_SHARE
            if joins:
                sum_cy, sum_h, n = sum_cy + cy, sum_h + h, n + 1
            else:
                band += 1
                sum_cy, sum_h, n = (cy, h, 1) if cy is not None else (0.0, 0.0, 0)
            bands.append(band)
        yield batch.append_column("band", pa.array(bands, pa.int32()))


def group_ocr_lines(boxes: DataFrame) -> DataFrame:
    """Boxes (sign_id, box_id, min_x, min_y, max_x, max_y) with the text line they belong to.

    The running means need an ordered pass. A vertical gap larger than any possible tolerance on the sign
    surely ends a band, so the pass runs on the short stretches between such gaps, not on whole signs. It reads the sorted rows of a
    partition as a stream, so a long stretch takes time in proportion and no memory.
    """
    whole = Window.partitionBy("sign_id")
    down = whole.orderBy("cy", "box_id")
    sized = boxes.withColumns({
        "cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2,
        "h": F.col("max_y") - F.col("min_y"),
    })
    cut = (F.col("cy") - F.lag("cy").over(down)) > F.max("h").over(whole) * BAND_SHARE
    sized = sized.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(0)))
    sized = sized.withColumn("_stretch", F.sum("_cut").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = sized.drop("_cut").repartition("sign_id", "_stretch").sortWithinPartitions("sign_id", "_stretch", "cy", "box_id")
    banded = ordered.mapInArrow(_number_bands, StructType([*ordered.schema, StructField("band", IntegerType())]))
    across = Window.partitionBy("sign_id", "_stretch", "band").orderBy("cx", "cy", "box_id")
    before = {k: F.lag(k).over(across) for k in ("h", "max_x")}
    ratio = F.greatest("h", before["h"]) / (F.least(F.col("h"), before["h"]) + 1e-5)
    gap = F.col("min_x") - before["max_x"]
    split = (ratio > SIZE_RATIO) | (gap > (F.col("h") + before["h"]) / 2 * GAP_SHARE)
    marked = banded.withColumn("_split", F.coalesce(split.cast("int"), F.lit(0)))
    marked = marked.withColumn("_piece", F.sum("_split").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.dense_rank().over(Window.partitionBy("sign_id").orderBy("_stretch", "band", "_piece")) - 1
    return marked.withColumn("line_no", number).select("sign_id", "line_no", "box_id", "min_x", "min_y", "max_x", "max_y")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def read_lines(lines: DataFrame) -> DataFrame:
    """Phones and address candidate of every OCR line (image_id, line_no, text, min_y, max_y).

    Adds ``phones`` (digits), ``address`` (cleaned, or null) and ``rest`` (text left for extraction, or null).
    """
    sign = Window.partitionBy("image_id")
    df = lines.withColumns({"_h": F.col("max_y") - F.col("min_y"), "_text": _strip(F.col("text"))})
    df = df.withColumns({"_sign_y": F.max("max_y").over(sign), "_sign_h": F.max("_h").over(sign)})

    full, number = F.regexp_extract_all("_text", F.lit(PHONE), F.lit(0)), F.regexp_extract_all("_text", F.lit(PHONE), F.lit(1))
    df = df.withColumn("_found", F.arrays_zip(full.alias("full"), number.alias("number")))
    df = df.withColumn("_found", F.filter("_found", lambda m: (
        F.length(F.regexp_replace(m["number"], r"[^\d+]", "")) >= 8) | m["full"].rlike(f"(?iu){PHONE_LABELS}")))
    df = df.withColumns({
        "phones": F.transform("_found", lambda m: F.regexp_replace(m["number"], r"[^\d+]", "")),
        "_left": F.aggregate("_found", F.col("_text"), lambda text, m: _strip(F.replace(text, m["full"], F.lit("")))),
    })
    df = df.withColumn("_left", _strip(F.regexp_replace("_left", rf"(?iuU)^{PHONE_LABELS}?\s*[:\-\.]*\s*$", "")))

    left = F.col("_left")
    labelled = left.rlike(rf"(?iuU)^{ADDRESS_LABELS}\s*[:\-]*\s*")
    admin = F.size(F.regexp_extract_all(left, F.lit("(?iuU)" + ADMIN_WORDS), F.lit(1)))
    placed = (F.col("_h") <= F.col("_sign_h") * 0.6) | ((F.col("min_y") + F.col("max_y")) / 2 >= F.col("_sign_y") * 0.5)
    specific = left.rlike(r"(?U)\d") | F.contains(left, F.lit(",")) | (admin >= 2) | left.rlike(CITY_WORDS)
    business = left.rlike(rf"(?iuU)^(?:{BUSINESS_STARTS})\b")
    df = df.withColumns({
        "_labelled": labelled,
        "_likely": (left != "") & (labelled | ((left.rlike(SHORT_ADDRESS) | ((admin > 0) & specific & placed)) & ~business)),
    })
    # The first likely line sets the height that later unlabelled lines must be near to.
    first = F.first(F.when(F.col("_likely"), F.col("_h")), ignorenulls=True).over(
        sign.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("_first_h", first)
    near = F.col("_first_h").isNull() | F.col("_h").between(F.col("_first_h") * 0.5, F.col("_first_h") * 1.8)
    df = df.withColumn("_is_address", F.col("_likely") & (F.col("_labelled") | near))

    clean = _strip(F.regexp_replace("_left", REMOVED_LABELS, ""))
    clean = F.btrim(F.regexp_replace(clean, rf"(?iu){PHONE_LABELS}.*$", ""), F.lit(" ,.-"))
    clean = F.regexp_replace(clean, BRANCH_LABELS, "$1: ")
    return df.select(
        "image_id", "line_no", "text", "phones",
        F.when(F.col("_is_address"), F.nullif(clean, F.lit(""))).alias("address"),
        F.when(~F.col("_is_address") & (left != ""), left).alias("rest"),
    )


def merge_addresses(addresses: Column) -> Column:
    """Join the addresses of a sign with ', ', dropping those contained in another (case-insensitive)."""

    def add(kept: Column, address: Column) -> Column:
        low = F.lower(address)
        # Position of the first kept address that contains this one or is contained in it.
        at = F.array_position(
            F.transform(kept, lambda k: F.contains(F.lower(k), low) | F.contains(low, F.lower(k))), True
        )
        longer = ~F.contains(F.lower(F.get(kept, (at - 1).cast("int"))), low)
        return (
            F.when(at == 0, F.concat(kept, F.array(address)))
            .when(longer, F.transform(kept, lambda k, i: F.when(i == at - 1, address).otherwise(k)))
            .otherwise(kept)
        )

    return F.array_join(F.aggregate(addresses, F.array().cast("array<string>"), add), ", ")


def read_signs(lines: DataFrame) -> DataFrame:
    """Per sign: distinct phones, merged address, remaining texts, all texts (in line order).

    The result row of a sign holds its texts, so it is as long as the sign.
    """
    read = read_lines(lines)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", "phones", "address", "rest")))
    signs = read.groupBy("image_id").agg(ordered.alias("_l"))

    def texts(field: str) -> Column:
        return F.filter(F.transform("_l", lambda x: x[field]), lambda v: v.isNotNull())

    return signs.select(
        "image_id",
        F.array_distinct(F.flatten(F.transform("_l", lambda x: x["phones"]))).alias("phones"),
        merge_addresses(texts("address")).alias("address"),
        texts("rest").alias("remaining"),
        texts("text").alias("texts"),
    )
