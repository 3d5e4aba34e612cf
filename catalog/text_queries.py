"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    any_of, bearing, decision, first_hit, haversine, norm, partial, query, r4, ratio, score, slug, sql_r4, token_set,
)
from placewise.functions import address as A
from placewise.functions.columns import sealed
from placewise.functions import contact, formats, geo, text

PAIRS = "SELECT a.id AS id, a.name AS a, b.name AS b FROM stores a JOIN stores b ON b.id = a.id + 1"


def _pairs(d):
    s = d.stores.select("id", "name")
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("name").alias("b"))
    return s.withColumnRenamed("name", "a").join(nxt, "id").withColumns({"na": text.normalize_text(F.col("a")), "nb": text.normalize_text(F.col("b"))})


@query("t1_normalize_text", f"SELECT id, {norm('name')} AS norm, {norm('address')} AS address_norm FROM stores", "stores")
def _(d):
    return d.stores.select("id", text.normalize_text(F.col("name")).alias("norm"), text.normalize_text(F.col("address")).alias("address_norm"))


@query("t1_normalize_documents", f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents")
def _(d):
    return d.documents.select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


NORMED = f"SELECT id, {norm('a')} AS na, {norm('b')} AS nb FROM ({PAIRS}) p"


@query(
    "t2_t5_similarity",
    f"""SELECT id, {sql_r4('p')} AS partial_ratio, {sql_r4('t')} AS token_set_ratio, {sql_r4('l')} AS levenshtein_ratio,
 {sql_r4(score('p', 't', 'l'))} AS score, {decision(score('p', 't', 'l'))} AS decision
FROM (SELECT id, {partial('na', 'nb')} AS p, {token_set('na', 'nb')} AS t, {ratio('na', 'nb')} AS l FROM n) m""",
    "stores", {"n": NORMED},
)
def _(d):
    scored = _pairs(d).select("id", sealed(text.similarity(F.col("na"), F.col("nb"))).alias("m")).withColumn("s", text.weighted_score(F.col("m")))
    return scored.select(
        "id", *[r4(f"m.{c}").alias(c) for c in ("partial_ratio", "token_set_ratio", "levenshtein_ratio")],
        r4("s").alias("score"), text.decide(F.col("s")).alias("decision"),
    )


@query("t7_make_id", f"SELECT id, {slug('name')} AS name_id, {slug('address')} AS address_id FROM stores", "stores")
def _(d):
    return d.stores.select("id", text.make_id(F.col("name")).alias("name_id"), text.make_id(F.col("address")).alias("address_id"))


def _phone(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    local = (
        f"CASE WHEN starts_with({digits}, '+84') THEN '0' || substr({digits}, 4) "
        f"WHEN starts_with({digits}, '84') AND length({digits}) >= 10 THEN '0' || substr({digits}, 3) ELSE {digits} END"
    )
    return f"CASE WHEN regexp_full_match({local}, '0[0-9]{{8,10}}|1[89]00[0-9]{{4}}') THEN {local} END"


@query(
    "t8_normalize_phone",
    f"SELECT id, part_no, {_phone('part')} AS phone FROM (SELECT id, generate_subscripts(l, 1) AS part_no, unnest(l) AS part "
    "FROM (SELECT id, string_split(phone, '|') AS l FROM stores WHERE phone IS NOT NULL) x) y", "stores",
)
def _(d):
    parts = d.stores.select("id", F.posexplode(F.split("phone", r"\|")).alias("p", "part"))
    return parts.select("id", (F.col("p") + 1).cast("bigint").alias("part_no"), contact.normalize_phone(F.col("part")).alias("phone"))


@query(
    "t9_merge_phones",
    f"""SELECT id, coalesce(string_agg(phone, ' | ' ORDER BY n), '') AS phones FROM (
 SELECT id, phone, min(part_no) AS n FROM (SELECT id, part_no, {_phone('part')} AS phone FROM (
  SELECT id, generate_subscripts(l, 1) AS part_no, unnest(l) AS part FROM (
   SELECT id, string_split(concat(coalesce(phone, ''), '|', coalesce(phone, '')), '|') AS l FROM stores) x) y) z GROUP BY id, phone) w
GROUP BY id""", "stores",
)
def _(d):
    raw = F.array(F.coalesce("phone", F.lit("")), F.coalesce("phone", F.lit("")))
    return d.stores.select("id", F.array_join(contact.merge_phones(raw), " | ").alias("phones"))


_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _preprocess(x: str) -> str:
    for words, replacement in A.ABBREVIATIONS:
        words = words.replace("'", "''")
        # RE2 knows ASCII boundaries only, so the neighbours are matched and kept; twice for adjacent hits.
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i){_EDGE_L}(?:{words}){_EDGE_R}', '\\1{replacement}\\2', 'g')"
    return x


@query("t10_preprocess_address", f"SELECT id, {_preprocess('address')} AS address FROM stores", "stores")
def _(d):
    return d.stores.select("id", A.preprocess_address(F.col("address")).alias("address"))


# T11: the same rules as a chain of CTEs.
def _doubled(x: str, word: str) -> str:
    w = word.replace(" ", r"\s+")
    return f"regexp_replace({x}, '(?i){_EDGE_L}{w}\\s+{w}{_EDGE_R}', '\\1{word[:1].upper() + word[1:]}\\2', 'g')"


def postprocess_ctes(source: str) -> dict[str, str]:
    """CTEs b1 .. bN from a relation (id, a) to b_out (id, address)."""
    missing = "|".join(A.MISSING_TERMS)
    fields = ("street", "ward", "district", "city")
    ctes = {
        "b1": f"SELECT id, a, list_transform(string_split(a, ','), lambda p: trim(p)) AS p, len(string_split(a, ',')) AS n FROM {source}",
        "b2": """SELECT id, a, CASE WHEN n >= 4 THEN array_to_string(p[1:n-3], ', ') ELSE p[1] END AS street,
 CASE WHEN n >= 4 THEN p[n-2] ELSE '' END AS ward, CASE WHEN n >= 4 THEN p[n-1] WHEN n = 3 THEN p[2] ELSE '' END AS district,
 CASE WHEN n >= 2 THEN p[n] ELSE '' END AS city FROM b1""",
        "b3": "SELECT id, a, " + ", ".join(f"CASE WHEN regexp_matches(lower({f}), '{missing}') THEN '' ELSE trim(regexp_replace({f}, '<[^>]*>', '', 'g')) END AS {f}" for f in fields) + " FROM b2",
        "b4": f"SELECT id, a, street, coalesce({first_hit('lower(district)', A.WARD_FIXES)}, ward) AS ward, CASE WHEN {first_hit('lower(district)', A.WARD_FIXES)} IS NULL THEN district ELSE '' END AS district, city FROM b3",
        "b5": f"SELECT id, a, street, coalesce({first_hit('lower(ward)', A.DISTRICT_FIXES)}, district) AS district, CASE WHEN {first_hit('lower(ward)', A.DISTRICT_FIXES)} IS NULL THEN ward ELSE '' END AS ward, city, lower(street) AS low FROM b4",
    }
    last = "b5"
    for i, (k, v) in enumerate(A.STREET_FIXES.items()):
        ctes[f"s{i}"] = f"SELECT id, a, CASE WHEN contains(low, '{k}') THEN regexp_replace(street, '(?i){k}', '{v}', 'g') ELSE street END AS street, ward, district, city, low FROM {last}"
        last = f"s{i}"
    ctes["b6"] = f"""SELECT id, a, street, city, {first_hit('lower(ward)', A.WARD_FIXES)} AS hit, ward,
 coalesce({first_hit('lower(district)', A.DISTRICT_FIXES)}, district) AS district FROM {last}"""
    ctes["b7"] = f"""SELECT id, a, street, coalesce(hit, ward) AS ward, CASE WHEN hit IS NOT NULL AND district = '' THEN 'Ninh Kiều' ELSE district END AS district,
 CASE WHEN {any_of('lower(city)', ['cần thơ', 'tpct', 'ct'])} OR city = '' THEN '{A.DEFAULT_CITY}'
  WHEN {any_of('lower(city)', ['hồ chí minh', 'tphcm', 'hcm'])} THEN 'Thành phố Hồ Chí Minh' ELSE city END AS city FROM b6"""
    ctes["b8"] = """SELECT id, a, street, city,
 CASE WHEN ward <> '' AND NOT starts_with(ward, 'Phường') AND NOT starts_with(ward, 'Xã') THEN 'Phường ' || ward ELSE ward END AS ward,
 CASE WHEN district <> '' AND NOT starts_with(district, 'Quận') AND NOT starts_with(district, 'Huyện') THEN 'Quận ' || district ELSE district END AS district FROM b7"""
    ctes["b_out"] = f"""SELECT id, CASE WHEN trim(a) = '' THEN ', , , ' ELSE {_doubled('street', 'đường')} || ', ' || {_doubled('ward', 'phường')}
 || ', ' || {_doubled('district', 'quận')} || ', ' || {_doubled('city', 'thành phố')} END AS address FROM b8"""
    return ctes


@query("t11_postprocess_address", "SELECT id, address FROM b_out", "stores", {"src": "SELECT id, address AS a FROM stores", **postprocess_ctes("src")})
def _(d):
    return A.postprocess_address(d.stores.select("id", "address"), "address", "address")


@query(
    "p8_normalize_addresses",
    "SELECT s.id AS id, CASE WHEN b.address <> '' THEN b.address ELSE s.address END AS address FROM stores s JOIN b_out b ON b.id = s.id",
    "stores", {"src": f"SELECT id, {_preprocess('address')} AS a FROM stores", **postprocess_ctes("src")},
)
def _(d):
    from placewise.plans.addresses import normalize_addresses

    return normalize_addresses(d.stores.select("id", "address"))


_EMPTY = ", ".join(f"'{v}'" for v in A.EMPTY_VALUES)
_KEPT = ", ".join(f"'{v}'" for v in A.KEPT_NUMBERS)
_PREFIX = r"(?i)^(?:(?:đường|đại\s+lộ|số|hẻm|đ\.|h\.)\s+)+"


def _no_number(x: str, pattern: str) -> str:
    n = f"lower(regexp_extract({x}, '{pattern}', 1))"
    return f"CASE WHEN {n} <> '' AND {n} NOT IN ({_KEPT}) THEN trim(regexp_replace({x}, '{pattern}', '')) ELSE {x} END"


def kg_address_ctes(source: str = "stores") -> dict[str, str]:
    """CTEs k1 .. to k_out (id, street, ward, district, city) of the knowledge-graph parser."""
    wards = [w.lower() for w in A.WARDS]
    ward_names = {w.lower(): f"Phường {w}" for w in A.WARDS}
    pattern = r"^([a-zA-Z]?\d+[\p{L}\p{N}_/\\-]*)\s*"
    junk = ", ".join(f"'{v}'" for v in A.EMPTY_VALUES + ["đường", "phường xã", "y khánh", "tân an", "an khánh", "cần thơ"])
    return {
        "k1": f"SELECT id, list_transform(string_split(coalesce(address, ''), ','), lambda p: trim(p)) AS p, len(string_split(coalesce(address, ''), ',')) AS n FROM {source}",
        "k2": f"""SELECT id, CASE WHEN n >= 4 THEN p[n-2] WHEN n = 3 AND {any_of('lower(p[1])', wards)} THEN p[1] WHEN n = 3 THEN p[2] ELSE '' END AS ward,
 CASE WHEN n >= 4 THEN array_to_string(p[1:n-3], ', ') WHEN n = 3 AND {any_of('lower(p[1])', wards)} THEN '' ELSE p[1] END AS street FROM k1""",
        "k3": "SELECT id, " + ", ".join(f"CASE WHEN lower({f}) IN ({_EMPTY}) THEN '' ELSE trim({_doubled(f, 'phường')}) END AS {f}" for f in ("ward", "street")) + " FROM k2",
        "k4": f"SELECT id, coalesce({first_hit('lower(ward)', ward_names)}, '') AS ward, trim(regexp_replace(street, '^[\\s.:,-]+', ''), ' -.,:') AS street FROM k3",
        "k5": f"SELECT id, ward, {_no_number('street', pattern)} AS street FROM k4",
        "k6": f"SELECT id, ward, trim(regexp_replace(street, '{_PREFIX}', ''), ' -.,:') AS street FROM k5",
        "k7": f"""SELECT id, ward, coalesce({first_hit('lower(street)', A._longest_first(A.STREET_ALIASES))},
 CASE WHEN lower(street) IN ({junk}) OR regexp_matches(lower(street), '^(?:phường |xã |quận |huyện |p\\.|q\\.|cổng chợ)')
  OR {any_of('lower(street)', ['tổ ', 'khu vực', 'dân cư', 'kv', 'kim mã', 'vành kh'])} THEN '' ELSE street END) AS street FROM k6""",
        "k8": r"SELECT id, ward, regexp_replace(street, '(?i)^(?:đường|đại\s+lộ)\s+', '') AS street FROM k7",
        "k_out": f"""SELECT id, CASE WHEN street = '' THEN '' ELSE (CASE WHEN {any_of('lower(street)', ['hòa bình', 'đại lộ'])} THEN 'Đại lộ ' ELSE 'Đường ' END) || street END AS street,
 ward, '{A.DEFAULT_DISTRICT}' AS district, '{A.DEFAULT_CITY}' AS city FROM k8""",
    }


@query("t12_parse_address_kg", "SELECT * FROM k_out", "stores", kg_address_ctes())
def _(d):
    return A.parse_address_kg(d.stores, "address", "a").select("id", "a.street", "a.ward", "a.district", "a.city")


def nine_district_ctes(source: str = "stores") -> dict[str, str]:
    """CTEs n1 .. to n_out (id, street, district, city) of the nine-district parser."""
    number = r"(?i)^(?:so\s+|số\s+)?(?:\d+[\p{L}\p{N}_/-]*\s*[-/]*\s*)+"
    skip = "'^(?:" + "|".join(A.SKIP_STARTS) + ")'"
    main = {w: name for words, name in A.MAIN_STREETS for w in words}
    street = (
        f"NOT ({any_of('lower(x)', A.CITY_WORDS)} OR {any_of('lower(x)', list(A.NINE_DISTRICTS))} OR {any_of('lower(x)', A.WARD_WORDS)} "
        f"OR regexp_matches(lower(x), {skip}) OR regexp_matches(x, '^\\d+[\\p{{L}}\\p{{N}}_/-]*$'))"
    )
    return {
        "n1": f"SELECT id, address, list_filter(list_transform(string_split(replace(replace(coalesce(address, ''), ' - ', ', '), '-', ','), ','), lambda p: trim(p)), lambda p: p <> '') AS p FROM {source}",
        "n2": f"""SELECT id, address, p, list_filter(p, lambda x: {street}) AS s,
 list_filter(list_transform(p, lambda x: {first_hit('lower(x)', A.NINE_DISTRICTS)}), lambda x: x IS NOT NULL) AS ds FROM n1""",
        "n3": f"SELECT id, address, p, ds, trim(regexp_replace(trim(regexp_replace(coalesce(s[1], p[1], ''), '{number}', '')), '(?i)^(?:đường|duong)\\s+', '')) AS street FROM n2",
        "n4": f"""SELECT id, address, coalesce({first_hit('lower(street)', main)}, street) AS street,
 coalesce(ds[len(ds)], CASE WHEN len(p) >= 2 AND NOT {any_of('lower(p[len(p)-1])', A.SKIP_STARTS + A.WARD_WORDS)} THEN p[len(p)-1] END, 'Ninh Kiều') AS district FROM n3""",
        "n_out": "SELECT id, street, CASE WHEN coalesce(address, '') = '' THEN '' ELSE trim(regexp_replace(district, '(?i)^(?:quận|quan|huyện|huyen)\\s+', '')) END AS district, 'Cần Thơ' AS city FROM n4",
    }


@query("t13_parse_address_nine_districts", "SELECT * FROM n_out", "stores", nine_district_ctes())
def _(d):
    return A.parse_address_nine_districts(d.stores, "address", "a").select("id", "a.street", "a.district", "a.city")


def facet_address_ctes(source: str = "stores") -> dict[str, str]:
    """CTEs f1 .. to f_out (id, street, ward, district, city, street_name) of the facet parser."""
    empty = ", ".join(f"'{v}'" for v in A.EMPTY_VALUES + ["phường xã"])
    junk = ", ".join(f"'{v}'" for v in A.EMPTY_VALUES + ["thành phố cần thơ", "cần thơ", "phường xã", "y khánh", "tân an"])

    def doubled(x: str) -> str:
        for w in ("đường", "phường", "quận", "thành phố"):
            s = w.replace(" ", r"\s+")
            x = f"regexp_replace({x}, '(?i)\\b{s}\\s+{s}\\b', '{w[:1].upper() + w[1:]}', 'g')"
        return x

    title = "array_to_string(list_transform(string_split(low, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    return {
        "f1": f"SELECT id, address, list_transform(string_split(coalesce(address, ''), ','), lambda p: trim(p)) AS p, len(string_split(coalesce(address, ''), ',')) AS n FROM {source}",
        "f2": "SELECT id, address, CASE WHEN n >= 4 THEN array_to_string(p[1:n-3], ', ') ELSE p[1] END AS street, CASE WHEN n >= 4 THEN p[n-2] ELSE '' END AS ward, CASE WHEN n >= 2 THEN p[n] ELSE '' END AS city FROM f1",
        "f3": "SELECT id, address, " + ", ".join(f"CASE WHEN lower({doubled(f)}) IN ({empty}) THEN '' ELSE trim({doubled(f)}) END AS {f}" for f in ("street", "ward", "city")) + " FROM f2",
        "f4": f"SELECT *, {_no_number('street', r'^([a-zA-Z]?[0-9]+[a-zA-Z0-9_/\\-]*)\s*')} AS name FROM f3",
        "f5": f"SELECT * EXCLUDE (name), trim(regexp_replace(regexp_replace(name, '{_PREFIX}', ''), '^[\\s.:,-]+', '')) AS name FROM f4",
        "f6": "SELECT *, regexp_replace(lower(name), '\\s+', ' ', 'g') AS low FROM f5",
        "f7": f"SELECT *, regexp_replace({title}, '(?i)^(?:đường|đại\\s+lộ)\\s+', '') AS cap FROM f6",
        "f_out": f"""SELECT id, street, ward, CASE WHEN coalesce(address, '') <> '' THEN '{A.DEFAULT_DISTRICT}' ELSE '' END AS district, city,
 CASE WHEN street = '' THEN '' ELSE coalesce({first_hit('lower(street)', A.FACET_ALIASES)},
  CASE WHEN lower(name) IN ({junk}) OR regexp_matches(lower(name), '^(?:phường |xã |quận |huyện |p\\.|q\\.)') OR {any_of('lower(name)', ['tổ ', 'khu vực'])} THEN ''
  ELSE (CASE WHEN {any_of('lower(cap)', ['hòa bình', 'đại lộ'])} THEN 'Đại lộ ' ELSE 'Đường ' END) || cap END) END AS street_name FROM f7""",
    }


@query("t14_parse_address_facet", "SELECT * FROM f_out", "stores", facet_address_ctes())
def _(d):
    return A.parse_address_facet(d.stores, "address", "a").select("id", "a.street", "a.ward", "a.district", "a.city", "a.street_name")


_MAIL = ", ".join(f"'{m}'" for m in contact.MAIL_DOMAINS)
_LABELLED = r"(?i)(?:^|[^\p{L}\p{N}_])(?:e-?mail|mail)\s*[:\-]?\s*([a-zA-Z0-9._%+-]+)"
_CONTACTS = f"""SELECT k, list_concat(regexp_extract_all(t, '{contact.EMAIL}'),
  list_transform(list_filter(regexp_extract_all(t, '{_LABELLED}', 1), lambda e: contains(e, '.') AND length(e) > 5),
   lambda e: regexp_replace(e, '{contact.LOST_AT_SIGN.replace("(?iu)", "(?i)")}', '@\\1', 'g'))) AS e,
 list_filter(regexp_extract_all(t, '{contact.WEBSITE.replace("(?U)", "")}'), lambda w: lower(w) NOT IN ({_MAIL})) AS w FROM src"""


def _ordered_distinct(x: str) -> str:
    return f"array_to_string(list_filter({x}, lambda v, i: list_position({x}, v) = i), '|')"


_CONTACT_SQL = f"SELECT k AS id, {_ordered_distinct('e')} AS emails, {_ordered_distinct('w')} AS websites FROM c"


def _contacts(df, key, body):
    t = F.col(body)
    return df.select(
        F.col(key).alias("id"), F.array_join(contact.extract_emails(t), "|").alias("emails"),
        F.array_join(contact.extract_websites(t), "|").alias("websites"),
    )


@query("t15_contacts_documents", _CONTACT_SQL, extra={"src": "SELECT doc_id AS k, text AS t FROM documents", "c": _CONTACTS})
def _(d):
    return _contacts(d.documents, "doc_id", "text")


@query("t15_contacts_ocr", _CONTACT_SQL, "ocr_lines", {"src": "SELECT image_id * 1000 + line_no AS k, text AS t FROM ocr_lines", "c": _CONTACTS})
def _(d):
    return _contacts(d.ocr_lines.withColumn("k", F.col("image_id") * 1000 + F.col("line_no")), "k", "text")


_ADDRESS_LIKE = r"(?i)\d+/\d*|\b(?:" + "|".join(contact.ADDRESS_WORDS_LEFT + contact.ADDRESS_WORDS_RIGHT) + r")\b"


@query(
    "t17_is_phone_or_address",
    f"""SELECT image_id, line_no, regexp_matches(trim(text), '{contact.PHONE_LIKE}') OR regexp_matches(trim(text), '{_ADDRESS_LIKE}') AS looks_like
FROM ocr_lines UNION ALL SELECT -1 - id, 0, coalesce(regexp_matches(trim(phone), '{contact.PHONE_LIKE}') OR regexp_matches(trim(phone), '{_ADDRESS_LIKE}'), false) FROM stores
UNION ALL SELECT -1000000000 - id, 0, regexp_matches(trim(address), '{contact.PHONE_LIKE}') OR regexp_matches(trim(address), '{_ADDRESS_LIKE}') FROM stores""",
    "ocr_lines stores",
)
def _(d):
    zero = F.lit(0).cast("bigint").alias("line_no")
    parts = [
        d.ocr_lines.select("image_id", "line_no", "text"),
        d.stores.select((-1 - F.col("id")).alias("image_id"), zero, F.col("phone").alias("text")),
        d.stores.select((-1000000000 - F.col("id")).alias("image_id"), zero, F.col("address").alias("text")),
    ]
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return texts.select("image_id", "line_no", contact.is_phone_or_address(F.col("text")).alias("looks_like"))


_EXTRACTED = """SELECT conv, CASE WHEN json_valid(doc) THEN doc END AS doc, rest FROM (
 SELECT sign_id * 1000 + turn AS conv, regexp_extract(answer, '(?s)(\\{.*\\})', 1) AS doc, remaining_text AS rest FROM extractions) x"""


def _json_list(key: str) -> str:
    raw = f"doc->>'{key}'"
    items = f"CASE WHEN json_type(doc, '$.{key}') = 'ARRAY' THEN list_filter(list_transform(CAST(doc->'$.{key}' AS VARCHAR[]), lambda v: trim(v)), lambda v: v <> '') WHEN {raw} IS NOT NULL AND trim({raw}) <> '' THEN [trim({raw})] ELSE CAST([] AS VARCHAR[]) END"
    return f"coalesce({items}, CAST([] AS VARCHAR[]))"


@query(
    "t18_coerce_extraction",
    f"""SELECT conv AS id, {_ordered_distinct('b')} AS brand, CASE WHEN len(b) = 0 AND len(s) = 0 THEN rest ELSE {_ordered_distinct('s')} END AS service,
 {_ordered_distinct('o')} AS other FROM (SELECT conv, rest, {_json_list('BRAND')} AS b, {_json_list('SERVICE')} AS s, {_json_list('O')} AS o FROM x) y""",
    "extractions", {"x": _EXTRACTED},
)
def _(d):
    e = d.extractions.withColumn("x", contact.coerce_extraction(F.col("answer"), F.col("remaining_text")))
    return e.select((F.col("sign_id") * 1000 + F.col("turn")).alias("id"), *[F.array_join(f"x.{c}", "|").alias(c) for c in ("brand", "service", "other")])


GEO_JSON = """SELECT c_custkey AS id, concat('{', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('"road":"', c_name, '",') END,
 CASE c_custkey % 3 WHEN 0 THEN '"quarter":"An Hội",' WHEN 1 THEN '"quarter":"","ward":"Tân An",' ELSE '' END,
 CASE c_custkey % 4 WHEN 0 THEN '"county":"Phong Điền",' WHEN 1 THEN '"suburb":"Ninh Kiều",' ELSE '' END,
 CASE WHEN c_custkey % 2 = 0 THEN '"city":"Cần Thơ"' ELSE '"state":"Cần Thơ"' END, '}') AS doc FROM customer"""


@query(
    "t19_geocoder_address",
    "SELECT id, concat_ws(', ', doc->>'road', " + ", ".join(
        "coalesce(" + ", ".join(f"nullif(doc->>'{k}', '')" for k in keys) + ")"
        for keys in (("quarter", "ward", "village"), ("city_district", "district", "county", "suburb"), ("city", "state"))
    ) + ") AS address FROM g", extra={"g": GEO_JSON},
)
def _(d):
    from catalog.views import _at

    docs = d.spark.sql(_at(GEO_JSON, d.folder))
    return docs.select("id", contact.geocoder_address(F.col("doc")).alias("address"))


@query(
    "t20_dms_to_decimal",
    f"""SELECT id, {sql_r4("(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END) * (CAST(id % 90 AS DOUBLE) + CAST(id * 7 % 60 AS DOUBLE) / 60 + CASE WHEN id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(id * 13 % 6000 AS DOUBLE) / (id % 11 * 10) / 3600 END)")} AS degrees FROM stores""",
    "stores",
)
def _(d):
    i = F.col("id")

    def frac(num, den):
        return F.struct(num.cast("bigint").alias("num"), den.cast("bigint").alias("den"))

    dms = F.array(frac(i % 90, F.lit(1)), frac(i * 7 % 60, F.lit(1)), frac(i * 13 % 6000, i % 11 * 10))
    ref = F.when(i % 3 == 0, "S").otherwise("N")
    return d.stores.select("id", r4(geo.dms_to_decimal(dms, ref)).alias("degrees"))


_NEXT = "SELECT a.id AS id, a.lng AS x1, a.lat AS y1, b.lng AS x2, b.lat AS y2, c.lng AS x3, c.lat AS y3 FROM stores a JOIN stores b ON b.id = a.id + 1 JOIN stores c ON c.id = a.id + 2"


def _triples(d):
    s = d.stores.select("id", "lng", "lat")
    for n in (1, 2):
        nxt = d.stores.select((F.col("id") - n).alias("id"), F.col("lng").alias(f"lng{n}"), F.col("lat").alias(f"lat{n}"))
        s = s.join(nxt, "id")
    return s


def _turn(d_: str) -> str:
    return (
        f"CASE WHEN abs({d_}) < 25 THEN 'straight' WHEN abs({d_}) <= 100 THEN CASE WHEN {d_} > 0 THEN 'right' ELSE 'left' END "
        f"WHEN abs({d_}) < 170 THEN CASE WHEN {d_} > 0 THEN 'hard-right' ELSE 'hard-left' END ELSE 'uturn' END"
    )


@query(
    "t21_t22_distance_and_turn",
    f"""SELECT id, {sql_r4('m')} AS metres, {sql_r4('b1')} AS bearing, {_turn('d')} AS turn FROM (
 SELECT id, m, b1, CASE WHEN raw > 180 THEN raw - 360 ELSE raw END AS d FROM (SELECT id, m, b1, (b2 - b1 + 360) % 360 AS raw FROM (
  SELECT id, {haversine('x1', 'y1', 'x2', 'y2')} AS m, {bearing('x1', 'y1', 'x2', 'y2')} AS b1, {bearing('x2', 'y2', 'x3', 'y3')} AS b2 FROM t) u) v) w""",
    "stores", {"t": _NEXT},
)
def _(d):
    c = F.col
    df = _triples(d).withColumns({
        "b1": geo.bearing(c("lng"), c("lat"), c("lng1"), c("lat1")), "b2": geo.bearing(c("lng1"), c("lat1"), c("lng2"), c("lat2")),
    })
    return df.select(
        "id", r4(geo.haversine_m(c("lng"), c("lat"), c("lng1"), c("lat1"))).alias("metres"), r4("b1").alias("bearing"),
        geo.turn_type(c("b1"), c("b2")).alias("turn"),
    )


@query(
    "t23_project_to_segment",
    f"""SELECT id, {sql_r4('t')} AS t, {sql_r4('x1 + 0 + (x2 + t * (x3 - x2) - x1)')} AS x, {sql_r4('y2 + t * (y3 - y2)')} AS y FROM (
 SELECT *, CASE WHEN (x3-x2)*(x3-x2)+(y3-y2)*(y3-y2) = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
  ((x1-x2)*(x3-x2)+(y1-y2)*(y3-y2)) / ((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)))) END AS t FROM p) q""",
    "stores", {"p": _NEXT},
)
def _(d):
    p = geo.project_to_segment(*[F.col(c) for c in ("lng", "lat", "lng1", "lat1", "lng2", "lat2")])
    return _triples(d).withColumn("p", p).select("id", r4("p.t").alias("t"), r4("p.x").alias("x"), r4("p.y").alias("y"))


@query(
    "t24_valid_ocr_text",
    "SELECT image_id, line_no, variant_order, length(trim(text)) >= 2 AND regexp_matches(text, '[a-zA-Z0-9]') AS valid FROM variants", "variants",
)
def _(d):
    return d.variants.select("image_id", "line_no", "variant_order", text.is_valid_ocr_text(F.col("text")).alias("valid"))


@query(
    "t25_formats",
    """SELECT event_id, 'S' || CAST(event_id AS VARCHAR) AS code, 'S' || CASE WHEN length(CAST(event_id AS VARCHAR)) >= 3 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR), 3, '0') END AS code3,
 strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%H:%M') AS clock,
 CASE WHEN user_id < 100 THEN CAST(user_id * 10 AS VARCHAR) || 'm' ELSE printf('%.1fkm', user_id / CAST(100 AS DOUBLE) + CASE WHEN user_id % 25 = 0 AND user_id % 10 = 5 THEN 0.01 ELSE 0 END) END AS near,
 CASE WHEN user_id * 25 > 1000 THEN printf('%.2f km', user_id * 25 / CAST(1000 AS DOUBLE) + CASE WHEN user_id * 25 % 125 = 0 AND user_id * 25 % 10 = 5 THEN 0.001 ELSE 0 END) ELSE CAST(user_id * 25 AS VARCHAR) || ' m' END AS far FROM events""",
)
def _(d):
    e, u = F.col("event_id"), F.col("user_id").cast("double")
    return d.events.select(
        "event_id", formats.store_code(e).alias("code"), formats.store_code(e, 3).alias("code3"), formats.date_text(F.col("ts")).alias("day"),
        formats.time_text(F.col("ts")).alias("clock"), formats.search_distance_text(u / 100).alias("near"), formats.route_length_text(u * 25).alias("far"),
    )


@query(
    "u1_ordered_unique", f"SELECT conv_id, turn, {_ordered_distinct('w')} AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations) x",
)
def _(d):
    return d.conversations.select("conv_id", "turn", F.array_join(text.ordered_unique(F.split("text", " ")), "|").alias("words"))


def _tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> '')))"


@query(
    "u2_token_overlap",
    f"""SELECT id, array_to_string(list_filter(a, lambda t: list_contains(b, t)), '|') AS common, array_to_string(list_filter(a, lambda t: NOT list_contains(b, t)), '|') AS only_a,
 array_to_string(list_filter(b, lambda t: NOT list_contains(a, t)), '|') AS only_b FROM (SELECT id, {_tokens('na')} AS a, {_tokens('nb')} AS b FROM n) x""",
    "stores", {"n": NORMED},
)
def _(d):
    o = _pairs(d).withColumn("o", text.token_overlap(F.col("na"), F.col("nb")))
    return o.select("id", *[F.array_join(f"o.{c}", "|").alias(c) for c in ("common", "only_a", "only_b")])


# --- written files, read back -------------------------------------------------------------------------------
@query("s7_backup_round_trip", "SELECT id, address AS address_normalized FROM b_out", "stores", {"src": f"SELECT id, {_preprocess('address')} AS a FROM stores", **postprocess_ctes("src")})
def _(d):
    from placewise.plans.addresses import normalized_addresses
    from placewise.sources.dumps import write_backup
    from placewise.tables import fresh_path

    path = fresh_path(d.spark)
    write_backup(normalized_addresses(d.stores), path)
    return d.spark.read.schema("id long, address_raw string, address_normalized string").json(path).select("id", "address_normalized")


@query("s8_corpus_round_trip", "SELECT text, lang AS label FROM documents")
def _(d):
    """Texts with line breaks and quotes, written and read back."""
    from placewise.plans.corpus import read_corpus, write_corpus
    from placewise.tables import fresh_path

    path = fresh_path(d.spark)
    write_corpus(d.documents.select("text", F.col("lang").alias("label")), path)
    return read_corpus(d.spark, path)
