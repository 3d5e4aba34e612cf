"""Rule-based address normalisation and parsing.

Every parser works on a DataFrame and adds columns in stages, so that each intermediate text is computed once
and everything stays in generated code. Dictionaries are small literal tables turned into CASE chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import sealed

BLANKS = " \t\n\r\x0b\x0c "

# --- Fixed values -------------------------------------------------------------------------------------------
ABBREVIATIONS = [
    ("nvc|văn cử|văn cự|nguyễn văn cử|nguyễn văn cự|nguyễn văn cữ|nguyen van cu", "Nguyễn Văn Cừ"),
    ("cmt8|cach mang thang 8|cách mạng tháng 8", "Cách Mạng Tháng Tám"),
    ("nvl|nguyen van linh", "Nguyễn Văn Linh"),
    ("tpct|ct", "Cần Thơ"),
    ("nk", "Ninh Kiều"),
    (r"p\.ak", "An Khánh"),
    (r"p\.xk", "Xuân Khánh"),
    (r"p\.hl", "Hưng Lợi"),
    (r"p\.ah", "An Hòa"),
    (r"p\.ck", "Cái Khế"),
    (r"p\.ta", "Tân An"),
    (r"p\.tb", "Thới Bình"),
    (r"p\.an", "An Nghiệp"),
    (r"p\.ap", "An Phú"),
    (r"nd|nd\.", "nối dài"),
    ("3/2", "Đường 3 Tháng 2"),
    ("30/4", "Đường 30 Tháng 4"),
]
STREET_FIXES = {
    "nguyễn văn cử": "Nguyễn Văn Cừ",
    "nguyễn văn cự": "Nguyễn Văn Cừ",
    "nguyễn văn cữ": "Nguyễn Văn Cừ",
    "văn cử": "Nguyễn Văn Cừ",
    "văn cự": "Nguyễn Văn Cừ",
    "nguyen van cu": "Nguyễn Văn Cừ",
    "nvc": "Nguyễn Văn Cừ",
    "cmt8": "Cách Mạng Tháng Tám",
    "cach mang thang 8": "Cách Mạng Tháng Tám",
    "cách mạng tháng 8": "Cách Mạng Tháng Tám",
    "nvl": "Nguyễn Văn Linh",
    "nguyen van linh": "Nguyễn Văn Linh",
    "3/2": "Đường 3 Tháng 2",
    "3 tháng 2": "Đường 3 Tháng 2",
    "30/4": "Đường 30 Tháng 4",
    "30 tháng 4": "Đường 30 Tháng 4",
}
WARD_FIXES = {
    "an khánh": "An Khánh", "an khanh": "An Khánh",
    "xuân khánh": "Xuân Khánh", "xuan khanh": "Xuân Khánh",
    "hưng lợi": "Hưng Lợi", "hung loi": "Hưng Lợi",
    "an hòa": "An Hòa", "an hoa": "An Hòa",
    "cái khế": "Cái Khế", "cai khe": "Cái Khế",
    "tân an": "Tân An", "tan an": "Tân An",
    "thới bình": "Thới Bình", "thoi binh": "Thới Bình",
    "an nghiệp": "An Nghiệp", "an nghiep": "An Nghiệp",
    "an phú": "An Phú", "an phu": "An Phú",
    "an hội": "An Hội", "an hoi": "An Hội",
    "an lạc": "An Lạc", "an lac": "An Lạc",
}
DISTRICT_FIXES = {
    "ninh kiều": "Ninh Kiều", "ninh kieu": "Ninh Kiều",
    "bình thủy": "Bình Thủy", "binh thuy": "Bình Thủy",
    "cái răng": "Cái Răng", "cai rang": "Cái Răng",
}
MISSING_TERMS = ["thiếu", "chưa rõ", "không có", "unknown", "none", "null"]

WARDS = [
    "An Khánh", "An Hòa", "An Nghiệp", "An Phú", "An Hội", "An Lạc",
    "Cái Khế", "Hưng Lợi", "Tân An", "Thới Bình", "Xuân Khánh",
]
STREET_ALIASES = {
    "nguyễn văn cừ nối dài": "Nguyễn Văn Cừ Nối Dài",
    "nguyen van cu noi dai": "Nguyễn Văn Cừ Nối Dài",
    "nguyễn văn cừ (nối dài)": "Nguyễn Văn Cừ Nối Dài",
    "nguyễn văn cừ nd": "Nguyễn Văn Cừ Nối Dài",
    "nguyễn văn cừ": "Nguyễn Văn Cừ",
    "nguyen van cu": "Nguyễn Văn Cừ",
    "nguyễn văn cự": "Nguyễn Văn Cừ",
    "nguyễn văn cữ": "Nguyễn Văn Cừ",
    "văn cử": "Nguyễn Văn Cừ",
    "văn cự": "Nguyễn Văn Cừ",
    "nvc": "Nguyễn Văn Cừ",
    "3 tháng 2": "Đường 3 Tháng 2",
    "3/2": "Đường 3 Tháng 2",
    "30 tháng 4": "Đường 30 Tháng 4",
    "30/4": "Đường 30 Tháng 4",
    "30-4": "Đường 30 Tháng 4",
    "30 4": "Đường 30 Tháng 4",
    "0/4": "Đường 30 Tháng 4",
    "cách mạng tháng tám": "Cách Mạng Tháng Tám",
    "cách mạng tháng 8": "Cách Mạng Tháng Tám",
    "cach mang thang 8": "Cách Mạng Tháng Tám",
    "cmt8": "Cách Mạng Tháng Tám",
    "nguyễn văn linh": "Nguyễn Văn Linh",
    "nguyen van linh": "Nguyễn Văn Linh",
    "nvl": "Nguyễn Văn Linh",
    "văn linh": "Nguyễn Văn Linh",
    "nguyễn văn": "Nguyễn Văn Cừ",
    "mậu thân": "Mậu Thân",
    "mau than": "Mậu Thân",
    "trần hưng đạo": "Trần Hưng Đạo",
    "tran hung dao": "Trần Hưng Đạo",
    "trần hưng đao": "Trần Hưng Đạo",
    "hùng vương": "Hùng Vương",
    "hung vuong": "Hùng Vương",
    "đại lộ hòa bình": "Đại lộ Hòa Bình",
    "hòa bình": "Đại lộ Hòa Bình",
    "hoa binh": "Đại lộ Hòa Bình",
    "trần văn hoài": "Trần Văn Hoài",
    "tran van hoai": "Trần Văn Hoài",
    "lý tự trọng": "Lý Tự Trọng",
    "ly tu trong": "Lý Tự Trọng",
    "võ văn kiệt": "Võ Văn Kiệt",
    "vo van kiet": "Võ Văn Kiệt",
    "nguyễn trãi": "Nguyễn Trãi",
    "nguyen trai": "Nguyễn Trãi",
    "đề thám": "Đề Thám",
    "de tham": "Đề Thám",
    "đinh tiên hoàng": "Đinh Tiên Hoàng",
    "châu văn liêm": "Châu Văn Liêm",
    "ngô quyền": "Ngô Quyền",
    "quang trung": "Quang Trung",
    "trần hoàng na": "Trần Hoàng Na",
    "nguyễn việt hồng": "Nguyễn Việt Hồng",
    "lý thường kiệt": "Lý Thường Kiệt",
    "phan đình phùng": "Phan Đình Phùng",
    "hai bà trưng": "Hai Bà Trưng",
    "trần văn khéo": "Trần Văn Khéo",
    "đồng khởi": "Đồng Khởi",
    "xô viết nghệ tĩnh": "Xô Viết Nghệ Tĩnh",
    "nguyễn an ninh": "Nguyễn An Ninh",
    "đường số 1": "Đường Số 1",
    "đường số 2": "Đường Số 2",
}
# The facet parser's own keys, in the order that decides between keys of equal length.
FACET_STREETS = {
    "nguyễn văn cừ nối dài": "Đường Nguyễn Văn Cừ Nối Dài",
    "nguyễn văn cừ (nối dài)": "Đường Nguyễn Văn Cừ Nối Dài",
    "nguyễn văn cừ": "Đường Nguyễn Văn Cừ",
    "mậu thân": "Đường Mậu Thân",
    "3 tháng 2": "Đường 3 Tháng 2",
    "3/2": "Đường 3 Tháng 2",
    "30 tháng 4": "Đường 30 Tháng 4",
    "30/4": "Đường 30 Tháng 4",
    "30-4": "Đường 30 Tháng 4",
    "30 4": "Đường 30 Tháng 4",
    "0/4": "Đường 30 Tháng 4",
    "cách mạng tháng tám": "Đường Cách Mạng Tháng Tám",
    "cách mạng tháng 8": "Đường Cách Mạng Tháng Tám",
    "cmt8": "Đường Cách Mạng Tháng Tám",
    "nguyễn văn linh": "Đường Nguyễn Văn Linh",
    "nvl": "Đường Nguyễn Văn Linh",
    "văn linh": "Đường Nguyễn Văn Linh",
    "nguyễn văn": "Đường Nguyễn Văn Cừ",
    "trần hưng đạo": "Đường Trần Hưng Đạo",
    "trần hưng đao": "Đường Trần Hưng Đạo",
    "hùng vương": "Đường Hùng Vương",
    "hòa bình": "Đại lộ Hòa Bình",
    "đại lộ hòa bình": "Đại lộ Hòa Bình",
    "trần văn hoài": "Đường Trần Văn Hoài",
    "đề thám": "Đường Đề Thám",
    "lý tự trọng": "Đường Lý Tự Trọng",
    "võ văn kiệt": "Đường Võ Văn Kiệt",
    "nguyễn trãi": "Đường Nguyễn Trãi",
    "hai bà trưng": "Đường Hai Bà Trưng",
    "trần văn khéo": "Đường Trần Văn Khéo",
    "đồng khởi": "Đường Đồng Khởi",
    "ngô quyền": "Đường Ngô Quyền",
    "xô viết nghệ tĩnh": "Đường Xô Viết Nghệ Tĩnh",
    "đinh tiên hoàng": "Đường Đinh Tiên Hoàng",
    "nguyễn an ninh": "Đường Nguyễn An Ninh",
    "châu văn liêm": "Đường Châu Văn Liêm",
    "quang trung": "Đường Quang Trung",
    "trần hoàng na": "Đường Trần Hoàng Na",
    "nguyễn việt hồng": "Đường Nguyễn Việt Hồng",
    "lý thường kiệt": "Đường Lý Thường Kiệt",
    "phan đình phùng": "Đường Phan Đình Phùng",
}
KEPT_NUMBERS = ["f4", "f5", "c4", "c6", "c10"]
EMPTY_VALUES = ["none", "null", "unknown", "thiếu", "không có", "chưa rõ", ""]
NINE_DISTRICTS = {
    "ninh kiều": "Ninh Kiều", "ninh kieu": "Ninh Kiều",
    "cái răng": "Cái Răng", "cai rang": "Cái Răng",
    "bình thủy": "Bình Thủy", "binh thuy": "Bình Thủy",
    "ô môn": "Ô Môn", "o mon": "Ô Môn",
    "thốt nốt": "Thốt Nốt", "thot not": "Thốt Nốt",
    "phong điền": "Phong Điền", "phong dien": "Phong Điền",
    "cờ đỏ": "Cờ Đỏ", "co do": "Cờ Đỏ",
    "thới lai": "Thới Lai", "thoi lai": "Thới Lai",
    "vĩnh thạnh": "Vĩnh Thạnh", "vinh thanh": "Vĩnh Thạnh",
}
CITY_WORDS = ["cần thơ", "can tho", "tpct", "tp.ct"]
SKIP_STARTS = [
    "khu vực", "khu vuc", "kv", "ấp", "ap", "hẻm", "hem", "ngõ", "ngo", "tổ", "to", "nền", "nen", "số", "so",
]
WARD_WORDS = ["phường", "phuong", "p.", "xã", "xa", "tt.", "thị trấn"]
MAIN_STREETS = [
    (["nguyen van cu", "nguyễn văn cừ"], "Nguyễn Văn Cừ"),
    (["mậu thân", "mau than"], "Mậu Thân"),
    (["nguyen van linh", "nguyễn văn linh"], "Nguyễn Văn Linh"),
    (["30/4", "30 tháng 4"], "30 Tháng 4"),
    (["3/2", "3 tháng 2"], "3 Tháng 2"),
    (["hòa bình", "hoa binh"], "Đại lộ Hòa Bình"),
]
DEFAULT_DISTRICT, DEFAULT_CITY = "Quận Ninh Kiều", "Thành phố Cần Thơ"
# ------------------------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _first_hit(lowered: Column, table: dict[str, str]) -> Column:
    """Value of the first key contained in the text, else null."""
    chain = None
    for key, value in table.items():
        hit = F.contains(lowered, F.lit(key))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def _longest_first(table: dict[str, str]) -> dict[str, str]:
    return dict(sorted(table.items(), key=lambda kv: -len(kv[0])))


def _double_word(text: Column, word: str, flags: str = "(?iuU)") -> Column:
    spaced = word.replace(" ", r"\s+")
    return F.regexp_replace(text, rf"{flags}\b{spaced}\s+{spaced}\b", word[:1].upper() + word[1:])


def _part(parts: Column, at: int) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(at)), F.lit(""))


def preprocess_address(address: Column) -> Column:
    """Expand abbreviations and fix frequent misspellings, on word boundaries."""
    return reduce(
        lambda text, rule: F.regexp_replace(text, rf"(?iuU)\b(?:{rule[0]})\b", rule[1]), ABBREVIATIONS, address
    )


def postprocess_address(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target``: 'street, ward, district, city' with corrected names; blank input gives ', , , '."""
    c = F.col
    kept = df.columns
    df = df.withColumn("_parts", F.transform(F.split(F.coalesce(c(source), F.lit("")), ","), strip))
    n, parts = F.size("_parts"), c("_parts")
    fields = {
        "_street": F.when(n >= 4, F.array_join(F.slice("_parts", 1, F.greatest(n - 3, F.lit(1))), ", ")).otherwise(_part(parts, 1)),
        "_ward": F.when(n >= 4, _part(parts, -3)).otherwise(""),
        "_district": F.when(n >= 4, _part(parts, -2)).when(n == 3, _part(parts, 2)).otherwise(""),
        "_city": F.when(n >= 2, _part(parts, -1)).otherwise(""),
    }
    df = df.withColumns({k: strip(F.regexp_replace(v, "<[^>]*>", "")) for k, v in fields.items()})
    missing = "|".join(MISSING_TERMS)
    df = df.withColumns({k: F.when(F.lower(k).rlike(missing), "").otherwise(c(k)) for k in fields})
    # A ward in the district slot, then a district in the ward slot.
    df = df.withColumn("_hit", _first_hit(F.lower("_district"), WARD_FIXES))
    df = df.withColumns({
        "_ward": F.coalesce("_hit", "_ward"),
        "_district": F.when(c("_hit").isNull(), c("_district")).otherwise(""),
    })
    df = df.withColumn("_hit", _first_hit(F.lower("_ward"), DISTRICT_FIXES))
    df = df.withColumns({
        "_district": F.coalesce("_hit", "_district"),
        "_ward": F.when(c("_hit").isNull(), c("_ward")).otherwise(""),
    })
    df = df.withColumn("_low", F.lower("_street"))
    for wrong, right in STREET_FIXES.items():
        fixed = F.regexp_replace("_street", rf"(?iu)\Q{wrong}\E", right)
        df = df.withColumn("_street", F.when(F.contains("_low", F.lit(wrong)), fixed).otherwise(c("_street")))
    df = df.withColumns({
        "_ward_hit": _first_hit(F.lower("_ward"), WARD_FIXES),
        "_district": F.coalesce(_first_hit(F.lower("_district"), DISTRICT_FIXES), c("_district")),
        "_low": F.lower("_city"),
    })
    df = df.withColumns({
        "_ward": F.coalesce("_ward_hit", "_ward"),
        "_district": F.when(c("_ward_hit").isNotNull() & (c("_district") == ""), "Ninh Kiều").otherwise(c("_district")),
        "_city": F.when(_has(c("_low"), "cần thơ", "tpct", "ct") | (c("_city") == ""), DEFAULT_CITY)
        .when(_has(c("_low"), "hồ chí minh", "tphcm", "hcm"), "Thành phố Hồ Chí Minh")
        .otherwise(c("_city")),
    })
    bare_ward = (c("_ward") != "") & ~c("_ward").startswith("Phường") & ~c("_ward").startswith("Xã")
    bare_district = (c("_district") != "") & ~c("_district").startswith("Quận") & ~c("_district").startswith("Huyện")
    df = df.withColumns({
        "_ward": F.when(bare_ward, F.concat(F.lit("Phường "), c("_ward"))).otherwise(c("_ward")),
        "_district": F.when(bare_district, F.concat(F.lit("Quận "), c("_district"))).otherwise(c("_district")),
    })
    joined = F.concat_ws(
        ", ",
        _double_word(c("_street"), "đường"),
        _double_word(c("_ward"), "phường"),
        _double_word(c("_district"), "quận"),
        _double_word(c("_city"), "thành phố"),
    )
    blank = strip(F.coalesce(c(source), F.lit(""))) == ""
    return df.select(*[k for k in kept if k != target], sealed(F.when(blank, ", , , ").otherwise(joined)).alias(target))


def _strip_house_number(text: Column, pattern: str) -> Column:
    number = F.lower(F.regexp_extract(text, pattern, 1))
    strippable = (number != "") & ~number.isin(KEPT_NUMBERS)
    return F.when(strippable, strip(F.regexp_replace(text, pattern, ""))).otherwise(text)


_STREET_PREFIXES = r"(?iu)^(?:(?:đường|đại\s+lộ|số|hẻm|đ\.|h\.)\s+)+"


def parse_address_kg(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target`` struct(street, ward, district, city), the knowledge-graph variant.

    A street without an alias keeps its own casing: the title-cased form is not used.
    """
    c = F.col
    kept = df.columns
    df = df.withColumn("_parts", F.transform(F.split(F.coalesce(c(source), F.lit("")), ","), strip))
    n, parts = F.size("_parts"), c("_parts")
    starts_with_ward = _has(F.lower(_part(parts, 1)), *[w.lower() for w in WARDS])
    df = df.withColumns({
        "_ward": F.when(n >= 4, _part(parts, -3))
        .when((n == 3) & starts_with_ward, _part(parts, 1))
        .when(n == 3, _part(parts, 2))
        .otherwise(""),
        "_street": F.when(n >= 4, F.array_join(F.slice("_parts", 1, F.greatest(n - 3, F.lit(1))), ", "))
        .when((n == 3) & starts_with_ward, "")
        .otherwise(_part(parts, 1)),
    })
    for k in ("_ward", "_street"):
        cleaned = strip(_double_word(c(k), "phường"))
        df = df.withColumn(k, F.when(F.lower(k).isin(EMPTY_VALUES), "").otherwise(cleaned))
    ward_names = {w.lower(): f"Phường {w}" for w in WARDS}
    df = df.withColumns({
        "_ward": F.coalesce(_first_hit(F.lower("_ward"), ward_names), F.lit("")),
        "_street": F.btrim(F.regexp_replace("_street", r"(?U)^[\s\-.:,]+", ""), F.lit(" -.,:")),
    })
    df = df.withColumn("_street", _strip_house_number(c("_street"), r"(?U)^([a-zA-Z]?\d+[\w/\\-]*)\s*"))
    df = df.withColumn("_street", F.btrim(F.regexp_replace("_street", _STREET_PREFIXES, ""), F.lit(" -.,:")))
    df = df.withColumn("_low", F.lower("_street"))
    low = c("_low")
    junk = (
        low.isin(EMPTY_VALUES + ["đường", "phường xã", "y khánh", "tân an", "an khánh", "cần thơ"])
        | low.rlike(r"^(?:phường |xã |quận |huyện |p\.|q\.|cổng chợ)")
        | _has(low, "tổ ", "khu vực", "dân cư", "kv", "kim mã", "vành kh")
    )
    alias = _first_hit(low, _longest_first(STREET_ALIASES))
    df = df.withColumn("_street", F.coalesce(alias, F.when(junk, "").otherwise(c("_street"))))
    df = df.withColumn("_street", F.regexp_replace("_street", r"(?iu)^(?:đường|đại\s+lộ)\s+", ""))
    prefix = F.when(_has(F.lower("_street"), "hòa bình", "đại lộ"), "Đại lộ ").otherwise("Đường ")
    parsed = F.struct(
        F.when(c("_street") == "", "").otherwise(F.concat(prefix, c("_street"))).alias("street"),
        c("_ward").alias("ward"),
        F.lit(DEFAULT_DISTRICT).alias("district"),
        F.lit(DEFAULT_CITY).alias("city"),
    )
    return df.select(*[k for k in kept if k != target], sealed(parsed).alias(target))


def parse_address_nine_districts(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target`` struct(street, district, city), the variant that tells nine districts apart."""
    c = F.col
    kept = df.columns
    dashed = F.replace(F.replace(F.coalesce(c(source), F.lit("")), F.lit(" - "), F.lit(", ")), F.lit("-"), F.lit(","))
    df = df.withColumn("_parts", F.filter(F.transform(F.split(dashed, ","), strip), lambda p: p != ""))

    def names_a_street(part: Column) -> Column:
        low = F.lower(part)
        skipped = low.rlike("^(?:" + "|".join(SKIP_STARTS) + ")") | part.rlike(r"(?U)^\d+[\w/-]*$")
        return ~(_has(low, *CITY_WORDS) | _has(low, *NINE_DISTRICTS) | _has(low, *WARD_WORDS) | skipped)

    df = df.withColumns({
        "_streets": F.filter("_parts", names_a_street),
        "_districts": F.filter(
            F.transform("_parts", lambda p: _first_hit(F.lower(p), NINE_DISTRICTS)), lambda d: d.isNotNull()
        ),
        "_before_last": F.try_element_at("_parts", F.lit(-2)),
    })
    df = df.withColumn("_street", F.coalesce(F.get("_streets", F.lit(0)), F.get("_parts", F.lit(0)), F.lit("")))
    df = df.withColumn(
        "_street",
        strip(F.regexp_replace("_street", r"(?iuU)^(?:so\s+|số\s+)?(?:\d+[\w/-]*\s*[-/]*\s*)+", "")),
    )
    df = df.withColumn("_street", strip(F.regexp_replace("_street", r"(?iuU)^(?:đường|duong)\s+", "")))
    df = df.withColumn("_low", F.lower("_street"))
    main = {word: name for words, name in MAIN_STREETS for word in words}
    fallback_ok = c("_before_last").isNotNull() & ~_has(F.lower("_before_last"), *SKIP_STARTS, *WARD_WORDS)
    district = F.coalesce(
        F.try_element_at("_districts", F.lit(-1)), F.when(fallback_ok, c("_before_last")), F.lit("Ninh Kiều")
    )
    blank = F.coalesce(c(source), F.lit("")) == ""
    parsed = F.struct(
        F.coalesce(_first_hit(c("_low"), main), c("_street")).alias("street"),
        F.when(blank, "").otherwise(strip(F.regexp_replace(district, r"(?iuU)^(?:quận|quan|huyện|huyen)\s+", ""))).alias("district"),
        F.lit("Cần Thơ").alias("city"),
    )
    return df.select(*[k for k in kept if k != target], sealed(parsed).alias(target))


FACET_ALIASES = _longest_first(FACET_STREETS)

# Here accented letters are no word characters, so a word that starts or ends with one never has a boundary there.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _facet_double_word(text: Column, word: str) -> Column:
    spaced = word.replace(" ", r"\s+")
    return F.regexp_replace(text, rf"(?iu){_EDGE}{spaced}\s+{spaced}{_EDGE}", word[:1].upper() + word[1:])


def parse_address_facet(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target`` struct(street, ward, district, city, street_name), the search-facet variant.

    ``street`` is the raw street part, ``street_name`` its normalised name without the house number.
    """
    c = F.col
    kept = df.columns
    df = df.withColumn("_parts", F.transform(F.split(F.coalesce(c(source), F.lit("")), ","), strip))
    n, parts = F.size("_parts"), c("_parts")
    df = df.withColumns({
        "_street": F.when(n >= 4, F.array_join(F.slice("_parts", 1, F.greatest(n - 3, F.lit(1))), ", ")).otherwise(_part(parts, 1)),
        "_ward": F.when(n >= 4, _part(parts, -3)).otherwise(""),
        "_city": F.when(n >= 2, _part(parts, -1)).otherwise(""),
    })
    for k in ("_street", "_ward", "_city"):
        text = c(k)
        for word in ("đường", "phường", "quận", "thành phố"):
            text = _facet_double_word(text, word)
        df = df.withColumn(k, text)
        df = df.withColumn(k, F.when(F.lower(k).isin(EMPTY_VALUES + ["phường xã"]), "").otherwise(strip(c(k))))
    df = df.withColumn("_name", _strip_house_number(c("_street"), r"^([a-zA-Z]?\d+[\w/\\-]*)\s*"))
    df = df.withColumn("_name", F.regexp_replace("_name", _STREET_PREFIXES, ""))
    df = df.withColumn("_name", strip(F.regexp_replace("_name", r"(?U)^[\s\-.:,]+", "")))
    df = df.withColumn("_low", F.lower("_name"))
    low = c("_low")
    junk = (
        low.isin(EMPTY_VALUES + ["thành phố cần thơ", "cần thơ", "phường xã", "y khánh", "tân an"])
        | low.rlike(r"^(?:phường |xã |quận |huyện |p\.|q\.)")
        | _has(low, "tổ ", "khu vực")
    )
    df = df.withColumn("_name", F.initcap(F.regexp_replace("_low", r"(?U)\s+", " ")))
    df = df.withColumn("_name", F.regexp_replace("_name", r"(?iu)^(?:đường|đại\s+lộ)\s+", ""))
    prefix = F.when(_has(F.lower("_name"), "hòa bình", "đại lộ"), "Đại lộ ").otherwise("Đường ")
    street_name = F.coalesce(
        F.when(c("_street") == "", ""),
        _first_hit(F.lower("_street"), FACET_ALIASES),
        F.when(junk, "").otherwise(F.concat(prefix, c("_name"))),
    )
    known = F.coalesce(c(source), F.lit("")) != ""
    parsed = F.struct(
        c("_street").alias("street"),
        c("_ward").alias("ward"),
        F.when(known, DEFAULT_DISTRICT).otherwise("").alias("district"),
        c("_city").alias("city"),
        street_name.alias("street_name"),
    )
    return df.select(*[k for k in kept if k != target], sealed(parsed).alias(target))
