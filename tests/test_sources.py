import json

from pyspark.sql import functions as F

from catalog.views import view
from placewise.operators import relational as R
from placewise.operators import search as S
from placewise.operators import workflow as W
from placewise.plans.addresses import normalized_addresses
from placewise.plans.corpus import write_corpus
from placewise.sources import dumps, geojson, photos, stores
from placewise.streaming import feeds
from tests.conftest import SMALL


def test_geojson_files(spark, tmp_path):
    table = R.with_category(view(spark, SMALL, "stores"), view(spark, SMALL, "categories"))
    table = S.with_public_images(table, view(spark, SMALL, "images"))
    geojson.write_geojson(table, str(tmp_path / "lines"))
    back = geojson.read_features(spark, str(tmp_path / "lines"))
    want = table.select("id", "name", "category_name", "lng", "lat", F.to_json("images"))
    assert sorted(map(tuple, back.select("id", "name", "category_name", "lng", "lat", F.to_json("images")).collect())) == sorted(map(tuple, want.collect()))
    document = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [105.7, 10.0]}, "properties": {"id": 5, "name": "A", "category_detail": {"name": "C"}}},
        {"id": 6, "type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": 9, "name": "B"}},
    ]}
    (tmp_path / "one.geojson").write_text(json.dumps(document, indent=1))
    rows = geojson.from_geojson(spark, str(tmp_path / "one.geojson")).orderBy("id").collect()
    assert [(r.id, r.name, r.category_name, r.lng, r.lat) for r in rows] == [(5, "A", "C", 105.7, 10.0), (6, "B", None, 1.0, 2.0)]


def test_address_dump(spark, tmp_path):
    (tmp_path / "dump.txt").write_text("﻿      address      \n-------------------\n 12 Lê Lợi \n 3/2, Cần Thơ\n(2 rows)\n\n", encoding="utf-8")
    assert [r.address for r in dumps.read_address_dump(spark, str(tmp_path / "dump.txt")).collect()] == ["12 Lê Lợi", "3/2, Cần Thơ"]


def test_backup_and_corpus(spark, tmp_path):
    df = normalized_addresses(view(spark, SMALL, "stores"))
    dumps.write_backup(df, str(tmp_path / "backup"))
    assert set(spark.read.json(str(tmp_path / "backup")).columns) == {"id", "address_raw", "address_normalized"}
    rows = spark.createDataFrame([(f"văn bản {i}", "x") for i in range(100)], "text string, label string")
    write_corpus(rows, str(tmp_path / "corpus"))
    back = [r.text for r in spark.read.csv(str(tmp_path / "corpus"), header=True).collect()]
    assert sorted(back) == sorted(f"văn bản {i}" for i in range(100)) and back != sorted(back)


def test_photo_scan(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + b"\x00\xfe" * 40 + b"<exif:GPSLatitude>10,2N</exif>" + b"\xff" * 300)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8nothing")
    (tmp_path / "c.txt").write_bytes(b"GPSLatitude")
    rows = photos.scan_photo_gps_text(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.pattern) for r in rows] == [("a.jpg", "GPSLatitude")]
    assert "<exif:GPSLatitude>10,2N</exif>" in rows[0].snippet


def test_read_table(spark):
    assert stores.read_table(spark, f"{SMALL}/part.parquet").count() == 200


def _in_files(df, path, n):
    df.repartition(n).write.parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    reviews = view(spark, SMALL, "reviews")
    _in_files(reviews, str(tmp_path / "reviews"), 4)
    stream = feeds.read_changes(spark, str(tmp_path / "reviews"), reviews.schema, files_per_trigger=1)
    live = feeds.update_once(feeds.running_ratings(stream), str(tmp_path / "r"), ["store_id"])
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, feeds.running_ratings(reviews).collect()))

    history = view(spark, SMALL, "search_history")
    _in_files(history, str(tmp_path / "history"), 3)
    stream = feeds.read_changes(spark, str(tmp_path / "history"), history.schema, files_per_trigger=1)
    live = feeds.update_once(feeds.latest_searches(stream).withColumn("w", F.lower("keyword")), str(tmp_path / "h"), ["user_id", "w"]).drop("w")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, feeds.latest_searches(history).collect()))


def test_approvals_in_batches_equal_one_replay(spark, tmp_path):
    table, images, approvals = (view(spark, SMALL, n) for n in ("stores", "images", "approvals"))
    want_stores, want_images = W.apply_approvals(table, images, approvals)
    approved = approvals.where("status = 'approved'").orderBy("date_up", "id")
    half = approved.selectExpr("percentile_approx(date_up, 0.5)").first()[0]
    early, late = approvals.where(F.col("date_up") <= half), approvals.where(F.col("date_up") > half)
    # The older decisions come second in one log: they must not overwrite the newer ones.
    for name, batches in (("forth", (early, late)), ("back", (late, early))):
        for batch in batches:
            batch.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = feeds.read_changes(spark, str(tmp_path / name / "in"), approvals.schema)
            feeds.run_once(feeds.log_approvals(stream, str(tmp_path / name / "log")), str(tmp_path / name / "progress"))
        # A batch written twice counts once; a compacted log says the same.
        W.note_changes(late if name == "forth" else early).write.mode("overwrite").parquet(str(tmp_path / name / "log" / "batch=1"))
        feeds.compact_log(spark, str(tmp_path / name / "log"), str(tmp_path / name / "compact"))
        for log in ("log", "compact"):
            for got, want in zip(feeds.merged_state(table, images, str(tmp_path / name / log)), (want_stores, want_images)):
                assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_note_changes_of_odd_notes(spark):
    notes = [
        (1, 1, "approved", 5, '{"new_images": [1, null, 2], "deleted_images": [2], "name": "a"}'), (2, 1, "approved", 9, '{"new_images": "x", "deleted_images": 3}'),
        (3, None, "approved", 9, '{"name": "nobody", "new_images": [4]}'), (4, 2, "approved", None, '{"name": "undated"}'), (5, 2, "approved", 1, "[1]"), (6, 2, "approved", 1, None),
        (7, 2, None, 1, '{"name": "x"}'), (8, 1, "approved", 5, '{"name": "b"}'),
    ]
    approvals = spark.createDataFrame(notes, "id long, store_id long, status string, decided int, note string")
    changes = W.note_changes(approvals, when="decided")
    got = {(r.store_id, r.image_id, r.field): (r.value, r.approval_id) for r in changes.collect()}
    assert got == {
        (None, 1, "published"): (None, 1), (None, 2, "published"): (None, 1), (None, 2, "deleted"): (None, 1), (None, 4, "published"): (None, 3),
        (1, None, "name"): ("b", 8), (None, None, "name"): ("nobody", 3), (2, None, "name"): ("undated", 4),
    }
    images = spark.createDataFrame([(i, i % 3 or None, "private") for i in range(1, 6)], "id long, store_id long, state string")
    assert {r.id: r.state for r in W.merge_image_changes(images, changes).collect()} == {1: "public", 3: "private", 4: "public", 5: "private"}
    assert W.note_changes(approvals.limit(0), when="decided").collect() == []


def test_rows_with_a_null_key_are_unique(spark):
    rows = spark.createDataFrame([(1, 5, 7), (2, 5, 7), (3, None, 7), (4, None, 7), (5, 5, None)], "id long, user_id long, store_id long")
    valid, rejected = W.check_favorites(rows)
    assert {r.id for r in valid.collect()} == {1, 3, 4, 5} and {r.id for r in rejected.collect()} == {2}


def test_duplicate_alerts_on_a_stream(spark, tmp_path):
    known = spark.createDataFrame([(1, "Phở 24", 105.7, 10.0), (2, "Xyz", 105.7, 10.0)], "id long, name string, lng double, lat double")
    arriving = spark.createDataFrame([(9, "PHO 24h", 105.70001, 10.0), (8, "", 105.7, 10.0)], "candidate_id long, name string, lng double, lat double")
    _in_files(arriving, str(tmp_path / "new"), 2)
    stream = feeds.read_changes(spark, str(tmp_path / "new"), arriving.schema)
    rows = feeds.append_once(feeds.duplicate_alerts(stream, known), str(tmp_path / "out")).collect()
    assert [(r.candidate_id, r.store_id, r.decision) for r in rows] == [(9, 1, "reject")]


def test_images_of_a_busy_store_are_shared_out(spark):
    shops = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = [(i, 1, f"{i}.jpg", "", "public") for i in range(500)] + [(1000, 2, "a.jpg", "", "public"), (1001, 2, "b.jpg", "", "private")]
    images = spark.createDataFrame(rows, "id long, store_id long, image string, describe string, state string")
    nested = S.with_public_images(shops, images).collect()
    assert sorted(i.id for r in nested if r.id == 1 for i in r.images) == list(range(500))
    assert len(nested) == 3
    flat = S.public_images(images).where("store_id = 1").orderBy("position").collect()
    assert [(r.position, r.id) for r in flat] == [(i, i) for i in range(500)]
    assert {(r.id, len(r.images)) for r in nested if r.id != 1} == {(2, 1), (3, 0)}


def test_explicit_null_and_bad_notes(spark):
    table = spark.createDataFrame([(1, 3, "old", "p", 1.0, 2.0, "pending", False), (2, 3, "b", "q", 1.0, 2.0, "active", True)], "id long, category_id long, name string, phone string, lat double, lng double, state string, is_active boolean")
    notes = [
        (1, 1, "approved", "2024-01-02", '{"name": "new", "phone": null, "latitude": "x", "longitude": "1"}'), (2, 1, "approved", "2024-01-01", '{"name": "older", "latitude": 5, "longitude": 6.5}'),
        (3, 1, "approved", "2024-01-03", "{bad"), (4, 1, "approved", "2024-01-01", '{"action": "CREATE_NEW", "category": 7}'), (5, 2, "rejected", "2024-01-01", '{"name": "no"}'),
    ]
    approvals = spark.createDataFrame(notes, "id long, store_id long, status string, date_up string, note string")
    got = {r.id: tuple(r)[1:] for r in W.patch_stores(table, approvals).collect()}
    assert got == {1: (7, "new", None, 5.0, 6.5, "active", True), 2: (3, "b", "q", 1.0, 2.0, "active", True)}
