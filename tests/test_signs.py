import random

from pyspark.sql import functions as F

from placewise.operators import ocr
from placewise.operators.relational import take_per_label
from placewise.plans import corpus, signs

LINE = "image_id long, line_no long, text string, min_y double, max_y double"


def test_read_lines(spark):
    rows = [
        (1, 0, "CÔNG TY TNHH DƯỢC PHẨM TÂY ĐÔ", 0.0, 60.0), (1, 1, "ĐT: 0912 345 678 - 0292.3831234", 70.0, 90.0),
        (1, 2, "Địa chỉ: 12 Nguyễn Trãi, P. An Hội", 100.0, 120.0), (1, 3, "45 đường Mậu Thân, quận Ninh Kiều", 130.0, 150.0),
        (1, 4, "99 đường 30/4, quận Ninh Kiều", 160.0, 260.0), (1, 5, "Hotline 19001234", 270.0, 280.0), (1, 6, "gọi 0123", 290.0, 300.0),
    ]
    got = {r.line_no: r for r in ocr.read_lines(spark.createDataFrame(rows, LINE)).collect()}
    assert got[0].rest == "CÔNG TY TNHH DƯỢC PHẨM TÂY ĐÔ"
    assert got[1].phones == ["0912345678", "02923831234"]
    assert got[2].address == "12 Nguyễn Trãi, P. An Hội"
    assert got[3].address == "45 đường Mậu Thân, quận Ninh Kiều"
    assert got[4].address is None and got[4].rest.startswith("99 đường")  # five times as high as the first address
    assert got[5].phones == ["19001234"] and got[5].rest is None
    assert got[6].phones == [] and got[6].rest == "gọi 0123"


def test_merge_addresses(spark):
    df = spark.createDataFrame([(["12 A", "12 a, P. B", "C", "c"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(ocr.merge_addresses(F.col("a"))).collect()] == ["12 a, P. B, C", ""]


def test_assemble_and_classify(spark):
    lines = spark.createDataFrame([
        (1, 0, "NHÀ THUỐC HUỲNH LỘC", 0.0, 60.0), (1, 1, "ĐT: +84 912 345 678", 70.0, 90.0), (2, 0, "0912345678", 0.0, 9.0), (3, 0, "Quán A", 0.0, 9.0),
    ], LINE)
    answers = spark.createDataFrame([(1, '{"BRAND": ["NHÀ THUỐC HUỲNH LỘC"], "SERVICE": [], "O": ["x"]}'), (3, "?")], "image_id long, answer string")
    got = {r.image_id: r for r in signs.assemble_signs(lines, answers).collect()}
    assert got[1].brand == ["NHÀ THUỐC HUỲNH LỘC"] and got[1].phone == ["0912345678"] and got[1].other == ["x"]
    assert got[2].brand == [] and got[2].service == [] and got[2].class_text == ""
    assert got[3].service == ["Quán A"]
    named = {r.image_id: r.category for r in signs.classify(signs.assemble_signs(lines, answers)).collect()}
    assert named == {1: signs.UNKNOWN, 2: signs.NO_DATA, 3: signs.UNKNOWN}


def bands_by_loop(boxes):
    """The line of every box, straight from the definition."""
    lines, current = [], []
    for b in sorted(boxes, key=lambda b: ((b[2] + b[4]) / 2, b[0])):
        cy, h = (b[2] + b[4]) / 2, b[4] - b[2]
        if current:
            mean_cy = sum((x[2] + x[4]) / 2 for x in current) / len(current)
            mean_h = sum(x[4] - x[2] for x in current) / len(current)
            if abs(cy - mean_cy) > max(h, mean_h) * 0.6:
                lines.append(current)
                current = []
        current.append(b)
    out = []
    for band in [*lines, current]:
        piece = []
        for b in sorted(band, key=lambda b: ((b[1] + b[3]) / 2, (b[2] + b[4]) / 2, b[0])):
            if piece:
                h, ph = b[4] - b[2], piece[-1][4] - piece[-1][2]
                if max(h, ph) / (min(h, ph) + 1e-5) > 2 or b[1] - piece[-1][3] > (h + ph) / 2 * 1.2:
                    out.append({x[0] for x in piece})
                    piece = []
            piece.append(b)
        out.append({x[0] for x in piece})
    return out


def test_group_lines_against_loop(spark):
    rng = random.Random(2)
    signs_, rows = {}, []
    for s in range(20):
        boxes = []
        for b in range(rng.randint(1, 30)):
            x, y, h = rng.randint(0, 300), rng.randint(0, 200), rng.randint(5, 40)
            boxes.append((b, float(x), float(y), float(x + rng.randint(5, 80)), float(y + h)))
        signs_[s] = boxes
        rows += [(s, *b) for b in boxes]
    df = spark.createDataFrame(rows, "sign_id long, box_id long, min_x double, min_y double, max_x double, max_y double")
    got = {}
    for r in ocr.group_ocr_lines(df).collect():
        got.setdefault(r.sign_id, {}).setdefault(r.line_no, set()).add(r.box_id)
    for s, boxes in signs_.items():
        assert [got[s][n] for n in sorted(got[s])] == bands_by_loop(boxes)


def test_group_lines_of_odd_boxes(spark):
    schema = "sign_id long, box_id long, min_x double, min_y double, max_x double, max_y double"
    # One stretch of 60,000 boxes beside a short sign: time grows with the boxes, not with their square.
    long = spark.range(60000).selectExpr("7L AS sign_id", "id AS box_id", "id % 40 * 9.0D AS min_x", "id * 0.7D AS min_y", "id % 40 * 9.0D + 8 AS max_x", "id * 0.7D + 10 + id % 3 AS max_y")
    rows = [(1, 1, 0.0, 0.0, 5.0, 10.0), (1, 1, 0.0, 0.0, 5.0, 10.0), (1, 2, 6.0, 1.0, 9.0, 11.0), (1, 3, 6.0, None, 9.0, 11.0), (None, 4, 0.0, 0.0, 5.0, 10.0), (None, 5, 6.0, 1.0, 9.0, 11.0)]
    got = ocr.group_ocr_lines(long.union(spark.createDataFrame(rows, schema)))
    lines = {}
    for r in got.collect():
        lines.setdefault(r.sign_id, {}).setdefault(r.line_no, []).append(r.box_id)
    boxes = [(r.box_id, r.min_x, r.min_y, r.max_x, r.max_y) for r in long.collect()]
    assert [set(lines[7][n]) for n in sorted(lines[7])] == bands_by_loop(boxes)
    assert sorted(map(sorted, lines[1].values())) == [[1, 1, 2], [3]] and lines[None] == {0: [4, 5]}
    assert ocr.group_ocr_lines(spark.createDataFrame([], schema)).collect() == []


def test_take_per_label_large(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("label"), (F.col("id") * 7919 % 20011).alias("seq"))
    got = take_per_label(rows, 2500).groupBy("label").agg(F.count("*").alias("n"), F.max("seq").alias("m")).collect()
    all_rows = {}
    for r in rows.collect():
        all_rows.setdefault(r.label, []).append(r.seq)
    for r in got:
        want = sorted(all_rows[r.label])[:2500]
        assert (r.n, r.m) == (len(want), want[-1])


def test_corpus(spark):
    words = [(f"label {i}", [f"từ khóa {i} {j}" for j in range(20)], ["Quán", "Tiệm"], ["Ngon", "Rẻ"]) for i in range(3)]
    vocabulary = spark.createDataFrame(words, "label string, keywords array<string>, prefixes array<string>, suffixes array<string>")
    made = corpus.generate_corpus(vocabulary, ["An", "Bình"], per_label=150, seed=3)
    rows = made.collect()
    assert len(rows) == len({(r.label, r.text) for r in rows}) == 450
    assert min(len(r.text) for r in rows) >= 4
    assert sorted(map(tuple, rows)) == sorted(map(tuple, corpus.generate_corpus(vocabulary, ["An", "Bình"], per_label=150, seed=3).collect()))
    clean = sum("từ khóa" in r.text for r in rows) / len(rows)
    assert 0.7 < clean < 0.95


def test_corpus_draws_until_it_is_full(spark, tmp_path):
    """A small vocabulary reaches its target by further draws; one without enough texts is told; line breaks survive files."""
    words = [("small", ["a b c", "d e f", "g h i"], ["Quán"], ["Ngon"]), ("one", ["chữ"], ["Q"], ["N"])]
    vocabulary = spark.createDataFrame(words, "label string, keywords array<string>, prefixes array<string>, suffixes array<string>")
    made = corpus.generate_corpus(vocabulary, ["An"], per_label=150, seed=3)
    counts = {r.label: r.n for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts["small"] == 150
    short = {r.label: r.missing for r in corpus.corpus_shortfall(made, vocabulary, 150).collect()}
    assert short == {k: 150 - n for k, n in counts.items() if n < 150}
    odd = made.unionByName(spark.createDataFrame([('a "quoted"\nline, with\ttab \\ end', "small"), ("", "small")], "text string, label string"))
    corpus.write_corpus(odd, str(tmp_path / "corpus"))
    back = corpus.read_corpus(spark, str(tmp_path / "corpus"))
    assert sorted((r.text or "", r.label) for r in back.collect()) == sorted(map(tuple, odd.collect()))


def test_take_per_label_any_order(spark):
    rows = spark.createDataFrame([("a", None if i == 7 else f"{i:05d}") for i in range(1500)] + [(None, "x"), ("b", None)], "label string, seq string")
    for n in (1, 1000, 1001, 5000):
        got = sorted(map(tuple, take_per_label(rows, n).collect()), key=repr)
        want = sorted([r for r in map(tuple, rows.collect()) if r[0] == "a"], key=lambda r: (r[1] is not None, r[1]))[:n]
        assert got == sorted([*want, (None, "x"), ("b", None)], key=repr)
