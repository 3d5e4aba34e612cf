import pytest
from pyspark.sql import functions as F

from placewise.functions import address as A
from placewise.plans.addresses import normalize_addresses


def run(spark, fn, values):
    return [r[0] for r in fn(spark.createDataFrame([(v,) for v in values], "a string"), "a", "p").select("p").collect()]


@pytest.mark.parametrize("raw, want", [
    ("123 Nguyễn Văn Cừ, Phường An Khánh, Ninh Kiều, Cần Thơ", "123 Nguyễn Văn Cừ, Phường An Khánh, Quận Ninh Kiều, Thành phố Cần Thơ"),
    ("Nguyễn Văn Linh, Phường Hưng Lợi, Quận Ninh Kiều, Thành phố Cần Thơ", "Nguyễn Văn Linh, Phường Hưng Lợi, Quận Ninh Kiều, Thành phố Cần Thơ"),
    ("Nguyễn Văn Cừ, , Phường Tân An, Cần Thơ", "Nguyễn Văn Cừ, Phường Tân An, Quận Ninh Kiều, Thành phố Cần Thơ"),
    ("1 Lê Lợi, Ninh Kiều, , hcm", "1 Lê Lợi, , Quận Ninh Kiều, Thành phố Hồ Chí Minh"),
    ("a, b, c, d, e", "a, b, Phường c, Quận d, e"),
    ("<thiếu>, x, <b>y</b>, z", ", Phường x, Quận y, z"),
    ("  ", ", , , "), (None, ", , , "),
])
def test_postprocess(spark, raw, want):
    assert run(spark, A.postprocess_address, [raw]) == [want]


def test_preprocess(spark):
    df = spark.createDataFrame([("12 nvc, p.ak, NK, TPCT",), ("3/2 nd",), ("nvcx",)], "a string")
    assert [r[0] for r in df.select(A.preprocess_address(F.col("a"))).collect()] == [
        "12 Nguyễn Văn Cừ, An Khánh, Ninh Kiều, Cần Thơ", "Đường 3 Tháng 2 nối dài", "nvcx",
    ]


def test_graph_variant(spark):
    rows = run(spark, A.parse_address_kg, [
        "12/3A đường cmt8, Phường An Hòa, Ninh Kiều, Cần Thơ", "F4 Lê Bình, An Khánh, x, y", "Phường Tân An, Ninh Kiều, Cần Thơ",
        "5 hẻm đường phan bội châu", "p.3, Cần Thơ", "đại lộ hòa bình, Cần Thơ", "",
    ])
    assert [(r.street, r.ward) for r in rows] == [
        ("Đường Cách Mạng Tháng Tám", "Phường An Hòa"), ("Đường F4 Lê Bình", "Phường An Khánh"), ("", "Phường Tân An"),
        ("Đường phan bội châu", ""), ("", ""), ("Đại lộ Hòa Bình", ""), ("", ""),
    ]
    assert {(r.district, r.city) for r in rows} == {("Quận Ninh Kiều", "Thành phố Cần Thơ")}


def test_nine_districts(spark):
    rows = run(spark, A.parse_address_nine_districts, [
        "93A Mậu Thân - Ninh Kiều - TP. Cần Thơ", "12 Lê Lợi, phường 1, quận Ô Môn, Cần Thơ", "kv 3, Trần Phú, Huyện Mỹ Xuyên, Sóc Trăng", "",
    ])
    assert [(r.street, r.district) for r in rows] == [("Mậu Thân", "Ninh Kiều"), ("Lê Lợi", "Ô Môn"), ("Trần Phú", "Mỹ Xuyên"), ("", "")]


def test_facet_variant(spark):
    rows = run(spark, A.parse_address_facet, [
        "12 đường số lê lợi, Phường Phường Tân An, Quận Ninh Kiều, Cần Thơ", "9 nguyen trai, Cần Thơ", "88 nguyễn TRÃI, Cần Thơ", "tổ 4, Cần Thơ",
    ])
    assert [(r.ward, r.street_name) for r in rows] == [
        ("Phường Tân An", "Đường Lê Lợi"), ("", "Đường Nguyen Trai"), ("", "Đường Nguyễn Trãi"), ("", ""),
    ]


def test_parsed_fields_can_be_filtered(spark):
    df = A.postprocess_address(spark.createDataFrame([("3/2, , , ",), ("x",)], "a string"), "a", "p")
    assert df.where(F.col("p").startswith("Đường 3")).count() == 1


def test_normalisation_keeps_rows_and_takes_rewritten(spark):
    df = spark.createDataFrame([(1, "12 nvc, p.ak, NK, TPCT", 'Output: "5 Lê Lợi, An Hội, Ninh Kiều, Cần Thơ"'), (2, None, None)], "id long, address string, w string")
    got = {r.id: r.address for r in normalize_addresses(df).collect()}
    assert got == {1: "12 Nguyễn Văn Cừ, Phường An Khánh, Quận Ninh Kiều, Thành phố Cần Thơ", 2: ", , , "}
    assert normalize_addresses(df, "w").where("id = 1").first().address == "5 Lê Lợi, Phường An Hội, Quận Ninh Kiều, Thành phố Cần Thơ"


def test_facet_alias_ties(spark):
    """Of two keys of one length the earlier of the fixed table decides."""
    rows = spark.createDataFrame([("hẻm văn linh mậu thân, Tân An, Ninh Kiều, Cần Thơ",), ("nguyễn trãi hùng vương, Tân An, Ninh Kiều, Cần Thơ",)], "address string")
    got = [r.a.street_name for r in A.parse_address_facet(rows, "address", "a").collect()]
    assert got == ["Đường Mậu Thân", "Đường Nguyễn Trãi"]
