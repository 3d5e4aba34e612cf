"""Phones, e-mail addresses, websites, geocoder and extraction JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must stay as they are.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LABELLED_EMAIL = r"(?iuU)\b(?:e-?mail|mail)\s*[:\-]?\s*([a-zA-Z0-9._%+-]+)"
LOST_AT_SIGN = r"(?iu)[QqAa0O]?\.?(gmail\.com|yahoo\.com|outlook\.com|hotmail\.com|icloud\.com)"
WEBSITE = (
    r"(?U)\b(?:www\.[a-zA-Z0-9-]+\.[a-zA-Z]{2,}|[a-zA-Z0-9-]+\.(?:com|vn|net|org)(?:\.[a-zA-Z]{2,})?)\b"
)
MAIL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com"]
PHONE_LIKE = r"^[\d\s.\-+()]{7,}$|^0\d{8,9}$|^\+84\d{8,9}$"
ADDRESS_WORDS_LEFT = ["nguyễn", "trần", "lê", "võ", "phạm", "hoàng", "huỳnh", "đinh", "phan"]
ADDRESS_WORDS_RIGHT = [
    "đường", "phường", "quận", "xã", "huyện", "tp\\.", "thành phố", "tỉnh", "khu", "ấp", "thị trấn",
    "nối dài", "số \\d",
]

# ASCII word boundary: an accented letter counts as a non-word character here.
_ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ADDRESS_LIKE = (
    r"(?iu)\d+/\d*|" + _ASCII_EDGE + "(?:" + "|".join(ADDRESS_WORDS_LEFT + ADDRESS_WORDS_RIGHT) + ")" + _ASCII_EDGE
)


def normalize_phone(raw: Column) -> Column:
    """Vietnamese phone as 0xxxxxxxxx, a 1800/1900 hotline, or null."""
    digits = F.regexp_replace(raw, r"[^\d+]", "")
    local = (
        F.when(digits.startswith("+84"), F.concat(F.lit("0"), F.substring(digits, 4, 1 << 20)))
        .when(digits.startswith("84") & (F.length(digits) >= 10), F.concat(F.lit("0"), F.substring(digits, 3, 1 << 20)))
        .otherwise(digits)
    )
    return F.when(local.rlike(r"^0\d{8,10}$|^1[89]00\d{4}$"), local)


def merge_phones(phones: Column) -> Column:
    """List of raw entries (each may hold several, `|` separated) to distinct valid phones, order kept."""
    parts = F.flatten(F.transform(phones, lambda p: F.split(p, r"\|")))
    valid = F.transform(parts, normalize_phone)
    return F.array_distinct(F.filter(valid, lambda p: p.isNotNull()))


def extract_emails(text: Column) -> Column:
    """Well-formed addresses, then labelled ones with a repaired ``@``; distinct, order kept."""
    labelled = F.filter(
        F.regexp_extract_all(text, F.lit(LABELLED_EMAIL), F.lit(1)),
        lambda e: F.contains(e, F.lit(".")) & (F.length(e) > 5),
    )
    repaired = F.transform(labelled, lambda e: F.regexp_replace(e, LOST_AT_SIGN, "@$1"))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), repaired))


def extract_websites(text: Column) -> Column:
    """Web hosts in the text without the bare mail domains; distinct, order kept."""
    hosts = F.regexp_extract_all(text, F.lit(WEBSITE), F.lit(0))
    return F.array_distinct(F.filter(hosts, lambda h: ~F.lower(h).isin(MAIL_DOMAINS)))


def is_phone_or_address(text: Column) -> Column:
    """Does the text look like a phone number or an address? Null and '' do not."""
    trimmed = F.trim(text)
    return F.coalesce((text != "") & (trimmed.rlike(PHONE_LIKE) | trimmed.rlike(ADDRESS_LIKE)), F.lit(False))


def _field(doc: Column, name: str) -> Column:
    return F.get_json_object(doc, f"$.{name}")


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def geocoder_address(doc: Column) -> Column:
    """'road, ward, district, city' from a geocoder's JSON address components."""
    ward = F.coalesce(*[_filled(_field(doc, k)) for k in ("quarter", "ward", "village")])
    district = F.coalesce(*[_filled(_field(doc, k)) for k in ("city_district", "district", "county", "suburb")])
    city = F.coalesce(*[_filled(_field(doc, k)) for k in ("city", "state")])
    return F.concat_ws(", ", _field(doc, "road"), ward, district, city)


def _as_list(doc: Column, key: str) -> Column:
    """A JSON field as a list of trimmed, non-empty, distinct strings; a scalar becomes one element."""
    raw = _field(doc, key)
    as_array = F.from_json(raw, "array<string>")
    is_array = F.ltrim(raw).startswith("[")
    values = (
        F.when(is_array, F.coalesce(as_array, F.array().cast("array<string>")))
        .when(raw.isNotNull(), F.array(raw))
        .otherwise(F.array().cast("array<string>"))
    )
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(trimmed)


def coerce_extraction(answer: Column, remaining_text: Column) -> Column:
    """Free model output to struct(brand, service, other).

    The JSON object is the text from the first ``{`` to the last ``}``. With neither brand nor service the
    remaining sign text becomes the service.
    """
    doc = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    valid = F.when(F.json_object_keys(F.when(doc != "", doc)).isNotNull(), doc)
    brand, service = _as_list(valid, "BRAND"), _as_list(valid, "SERVICE")
    rest = F.trim(F.coalesce(remaining_text, F.lit("")))
    nothing = (F.size(brand) == 0) & (F.size(service) == 0) & (rest != "")
    return F.struct(
        brand.alias("brand"),
        F.when(nothing, F.array(rest)).otherwise(service).alias("service"),
        _as_list(valid, "O").alias("other"),
    )
