"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import TABLES, VIEWS, _with_needs, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Given tables and domain views of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.folder, name)
        if name in TABLES:
            return table(self.spark, self.folder, name)
        raise AttributeError(name)


def query(name: str, sql: str | None = None, views: str = "", extra: dict[str, str] | None = None):
    """Register a function of ``Data`` under ``name``; ``sql`` may use the named ``views`` and ``extra`` CTEs."""

    def register(build: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Data(spark, folder))
        if sql is not None:
            ctes = {n: VIEWS[n] for n in _with_needs(views.split())} | (extra or {})
            # A CTE that reads itself is a recursion.
            recursive = any(re.search(rf"FROM {n}\b", text) for n, text in ctes.items())
            head = ", ".join(f"{n} AS ({text})" for n, text in ctes.items())
            ORACLES[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{head}\n" if head else "") + sql
        return build

    return register


def r4(column: Column | str) -> Column:
    """Four decimals by plain double arithmetic, the same in every engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * 10000.0 + 0.5).cast("double") / 10000.0


def sql_r4(text: str) -> str:
    return f"floor(({text}) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE)"


def sql_exact(text: str, digits: int) -> str:
    """Rounded by the exact binary value, ties to even."""
    return f"CAST(printf('%.{digits}f', {text}) AS DOUBLE)"


# --- SQL snippets for the comparison engine -----------------------------------------------------------------
def norm(x: str) -> str:
    folded = f"lower(strip_accents(replace(replace(lower({x}), 'đ', 'd'), 'Đ', 'd')))"
    return f"coalesce(trim(regexp_replace({folded}, '[^a-z0-9]+', ' ', 'g')), '')"


def slug(x: str) -> str:
    folded = f"trim(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))))"
    return f"regexp_replace(regexp_replace({folded}, '\\s+', '_', 'g'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def ratio(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = '' AND {b} = '' THEN CAST(1 AS DOUBLE) WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST(1 AS DOUBLE) - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"
    )


# (s, l): the shorter and the longer of two non-empty texts a and b.
def partial(a: str, b: str) -> str:
    s, l = (f"(CASE WHEN length({a}) <= length({b}) THEN {x} ELSE {y} END)" for x, y in ((a, b), (b, a)))
    return (
        f"(CASE WHEN {a} = '' AND {b} = '' THEN CAST(1 AS DOUBLE) WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE "
        f"list_max(list_transform(range(0, length({l}) - length({s}) + 1), "
        f"lambda i: CAST(1 AS DOUBLE) - levenshtein({s}, substr({l}, i + 1, length({s}))) / length({s}))) END)"
    )


def token_set(a: str, b: str) -> str:
    ta, tb = (f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> '')))" for x in (a, b))
    common = f"array_to_string(list_filter({ta}, lambda t: list_contains({tb}, t)), ' ')"
    with_a = f"trim({common} || ' ' || array_to_string(list_filter({ta}, lambda t: NOT list_contains({tb}, t)), ' '))"
    with_b = f"trim({common} || ' ' || array_to_string(list_filter({tb}, lambda t: NOT list_contains({ta}, t)), ' '))"
    return (
        f"(CASE WHEN {a} = '' AND {b} = '' THEN CAST(1 AS DOUBLE) WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE "
        f"greatest({ratio(with_a, with_b)}, {ratio(with_a, common)}, {ratio(with_b, common)}) END)"
    )


def haversine(lng1: str, lat1: str, lng2: str, lat2: str, radius: float = 6371000.0) -> str:
    half = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"CAST({2 * radius} AS DOUBLE) * atan2(sqrt({half}), sqrt(CAST(1 AS DOUBLE) - {half}))"


def bearing(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    d = f"(radians({lng2}) - radians({lng1}))"
    y = f"sin({d}) * cos(radians({lat2}))"
    x = f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def score(p: str, t: str, l: str) -> str:
    return f"(CAST(0.4 AS DOUBLE) * {p} + CAST(0.35 AS DOUBLE) * {t} + CAST(0.25 AS DOUBLE) * {l})"


def decision(s: str) -> str:
    return f"CASE WHEN {s} >= CAST(0.88 AS DOUBLE) THEN 'reject' WHEN {s} >= CAST(0.7 AS DOUBLE) THEN 'warning' ELSE 'accept' END"


def first_hit(text: str, table: dict[str, str]) -> str:
    """CASE chain: value of the first key contained in ``text``."""
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in table.items()) + " END"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


RATED = """SELECT s.*, coalesce(r.avg_rating, CAST(0 AS DOUBLE)) AS rating_avg, CAST(coalesce(r.n, 0) AS INTEGER) AS rating_count,
 c.name AS category_name FROM stores s JOIN categories c ON c.id = s.category_id
 LEFT JOIN (SELECT store_id, avg(rating) AS avg_rating, count(rating) AS n FROM reviews GROUP BY store_id) r ON r.store_id = s.id"""
