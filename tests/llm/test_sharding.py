import zlib

from placewise.llm.sharding import shard_documents
from tests.conftest import SMALL


def check(spark, docs, shards=8, tolerance=0.02, ranges=None):
    out = shard_documents(docs, shards, ranges=ranges).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == docs.count()
    loads, slots = [0] * shards, {}
    for r in out:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    mean = sum(loads) / shards
    assert max(loads) <= mean * (1 + tolerance) + max(r.size for r in out), loads
    return out, texts


def test_documents(spark):
    out, texts = check(spark, spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet"))
    homes = {}
    for r in out:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_hot_group_is_split_only_when_too_large(spark):
    small = [(i, f"text number {i} " * (i % 7)) for i in range(3000)]
    docs = spark.createDataFrame([*small, *((10_000 + i, "copy " * 20) for i in range(200)), *((20_000 + i, "hot " * 30) for i in range(3000))], "doc_id long, text string")
    out, texts = check(spark, docs)
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"copy " * 20)}) == 1
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"hot " * 30)}) > 2


def test_odd_rows(spark, odd):
    out = shard_documents(odd).collect()
    assert len(out) == odd.count() and sum(r.size == 1 for r in out) == 2
    assert shard_documents(odd.limit(0)).count() == 0
