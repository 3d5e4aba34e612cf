import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placewise.functions import contact, formats, text
from placewise.functions.columns import sealed
from placewise.operators.search import order_page
from tests.conftest import SMALL

# a, b, partial, token set, edit distance, score (4 decimals), decision
PAIRS = [
    ("Cafe Highland", "highlands coffee", 0.2308, 0.75, 0.1875, 0.4017, "accept"),
    ("Phở 24h", "pho 24", 1.0, 0.8571, 0.8571, 0.9143, "reject"),
    ("Gà Rán KFC", "KFC ga ran", 0.2, 1.0, 0.2, 0.48, "accept"),
    ("Trạm xăng Petrolimex", "Cây xăng Petrolimex", 0.8947, 0.85, 0.85, 0.8679, "warning"),
    ("Nhà thuốc An Khang", "Nha Thuoc AN khang 12", 1.0, 1.0, 0.8571, 0.9643, "reject"),
    ("Bánh mì Huynh Hoa", "Bánh mỹ Huỳnh Hoa", 0.9412, 0.9412, 0.9412, 0.9412, "reject"),
    ("Pizza Hut", "Piza hut", 0.75, 0.8889, 0.8889, 0.8333, "warning"),
    ("Bún chả Hương Liên", "bun cha huong lien", 1.0, 1.0, 1.0, 1.0, "reject"),
    ("Kichi Kichi lẩu băng chuyền", "Lẩu kichi kichi", 0.4667, 1.0, 0.3333, 0.62, "accept"),
    ("Tạp hóa cô Tư", "Tạp hóa nhà cô Tư", 0.6154, 1.0, 0.7647, 0.7873, "warning"),
    ("", "x", 0.0, 0.0, 0.0, 0.0, "accept"),
]


def test_similarity(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "a string, b string")
    df = df.select(sealed(text.similarity(text.normalize_text(F.col("a")), text.normalize_text(F.col("b")))).alias("m"))
    df = df.withColumn("s", text.weighted_score(F.col("m"))).select("m.*", "s", text.decide(F.col("s")).alias("d"))
    for row, want in zip(df.collect(), PAIRS):
        assert [round(v, 4) for v in row[:4]] == list(want[2:6])
        assert row.d == want[6]


def fold(value):
    low = value.lower().replace("đ", "d")
    bare = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", unicodedata.normalize("NFC", bare))).strip()


LETTERS = st.text(alphabet="aAbđĐéÊớỢýẴ 12-.&ỗŨçñ́\t", max_size=20)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LETTERS, min_size=20, max_size=40))
def test_normalize_matches_decomposition(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(text.normalize_text(F.col("v"))).collect()]
    assert got == [fold(v) for v in values]


@pytest.mark.parametrize("raw, want", [
    ("+84 912 345 678", "0912345678"), ("84912345678", "0912345678"), ("0292.3831.234", "02923831234"), ("1900 1234", "19001234"),
    ("123", None), ("8412345", None), ("", None), (None, None), ("012345678901", None),
])
def test_phone(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(contact.normalize_phone(F.col("v"))).first()[0] == want


def test_fixed_rounds_the_binary_value(spark):
    values = [1.575, 0.125, 2.675, 0.61, 3.0, 0.999, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(formats.fixed(F.col("v"), 2), formats.fixed(F.col("v"), 2, True), formats.round_exact(F.col("v"), 2)).collect()]
    assert [g[1] for g in got] == [f"{v:.2f}" for v in values]
    assert [g[2] for g in got] == [round(v, 2) for v in values]
    assert got[1][0] == "0.13"


def test_contacts(spark):
    body = "Mail: shopQgmail.com a.b@c.vn www.x-y.vn gmail.com a.b@c.vn e-mail: a@b"
    row = spark.createDataFrame([(body,)], "t string").select(contact.extract_emails(F.col("t")), contact.extract_websites(F.col("t"))).first()
    assert row[0] == ["a.b@c.vn", "shop@gmail.com"]
    assert "www.x-y.vn" in row[1] and "gmail.com" not in row[1]


def test_broken_extraction_falls_back(spark):
    rows = [('x {"BRAND": "A", "SERVICE": [" s ", "s"]} y', "r"), ("{oops", " left over "), (None, ""), ('{"O": ["o"]}', "t")]
    df = spark.createDataFrame(rows, "a string, r string").select(contact.coerce_extraction(F.col("a"), F.col("r")).alias("x")).select("x.*")
    got = [tuple(r) for r in df.collect()]
    assert got == [(["A"], ["s"], []), ([], ["left over"], []), ([], [], []), ([], ["t"], ["o"])]


@pytest.mark.parametrize("desc", [False, True])
def test_pages_by_number_and_by_last_row_agree(spark, desc):
    """Null keys, ties and a page that ends among either."""
    rows = [(i, None if i % 5 == 0 else float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, score double")
    seen, after = [], None
    for page in range(1, 9):
        by_number = order_page(df, "score", ["score"], page=page, size=6, desc=desc).collect()
        by_last = order_page(df, "score", ["score"], size=6, desc=desc, after=after).collect()
        assert by_number == by_last
        seen += by_last
        after = (by_last[-1].score, by_last[-1].id) if by_last else after
    assert sorted(r.id for r in seen) == list(range(40))
    with pytest.raises(ValueError):
        order_page(df, "id", ["score"])


def test_pairs_are_scored_once(spark):
    """A filter on the score does not copy its distances and normalised names below it."""
    from catalog import load

    plan = load()[0]["a5_missed_pairs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "levenshtein" in line]
