"""Vector codes and nearest vectors against brute force on whole tables, and on odd rows."""

from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm import queries
from placewise.llm.vector_codes import CellCache, Codebooks, decode_vectors, encode_vectors, train_codebooks
from placewise.llm.vector_search import nearest_vectors
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Null, empty and zero vectors, null and non-finite components, short vectors, repeated rows and keys, a null key, and a clashing column."""
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("CODE", T.StringType()),
    ])
    rng = np.random.default_rng(3)
    plain = [(i, rng.standard_normal(16).astype("float32").tolist(), i % 3 if i % 5 else None, "mine") for i in range(60)]
    odd = [
        (100, None, 1, None), (101, [], 1, None), (102, [0.0] * 16, None, None), (103, [1.0, None] * 8, 1, None), (104, [NAN] + [1.0] * 15, 1, None), (105, [1.0] * 15 + [INF], 1, None),
        (106, [-INF] + [1.0] * 15, 1, None), (107, [1.0, 2.0, 3.0], 1, None), (None, [0.5] * 16, None, None), plain[7], plain[7], (8, [0.25] * 16, 2, "another vector of this key"),
        *[(200 + i, [3.0] + [-1.0] * 15, 0, None) for i in range(40)],
    ]
    return spark.createDataFrame(plain + odd, schema).repartition(5)


def usable(rows):
    return [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]


def plain_codes(rows, parts, entries, rounds, width):
    """Codes by comparing everything with everything, in Python's own numbers."""
    rows = sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id or 0, list(r.embedding)))
    each = width // parts
    whole = [[int(np.floor(4096 * np.float64(x))) for x in [*r.embedding, *[0.0] * (width - len(r.embedding))]] for r in rows]
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        found = [sum((x - y) ** 2 for x, y in zip(part, entry)) for entry in book]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        moved = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for c in cut:
                own[nearest(c[p], book)[0]].append(c[p])
            moved.append([[sum(x) // len(o) for x in zip(*o)] if o else e for o, e in zip(own, book)])
        books = moved
    coded = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, sorted((r.vec_id if r.vec_id is not None else -1, [e for e, _ in c], sum(d for _, d in c)) for r, c in zip(rows, coded))


def test_codes_of_odd_rows(spark, odd_vectors):
    for parts, entries in ((8, 16), (3, 4), (16, 200)):
        books = train_codebooks(odd_vectors, parts=parts, entries=entries, rounds=3, cell_width=700)
        width = -(-16 // parts) * parts
        want_books, want = plain_codes(usable(odd_vectors.collect()), parts, entries, 3, width)
        assert books.entries.tolist() == want_books
        coded = encode_vectors(odd_vectors, books)
        assert coded.columns == ["vec_id", "embedding", "label", "code", "error"]
        got = sorted((r.vec_id if r.vec_id is not None else -1, list(r.code), r.error) for r in coded.collect())
        assert got == want
    near = {(r.vec_id, tuple(r.code)): r.decoded for r in decode_vectors(coded, books).collect()}
    for (_, code), decoded in near.items():
        assert decoded == [x / 4096 for p, e in enumerate(code) for x in want_books[p][e]]


def test_codes_of_empty_table(spark, odd_vectors):
    books = train_codebooks(odd_vectors.limit(0))
    assert books.entries.shape[1] == 0 and encode_vectors(odd_vectors.limit(0), books).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        train_codebooks(huge)


def test_cells_give_the_nearest_entry():
    rng = np.random.default_rng(5)
    parts = np.concatenate([rng.integers(-3000, 3000, (4000, 4)), np.repeat(rng.integers(-3000, 3000, (5, 4)), 300, axis=0)])
    entries = np.concatenate([parts[:20], parts[:3]])  # ties between equal entries
    distance = ((parts[:, None] - entries) ** 2).sum(axis=2)
    for width in (1, 64, 1000, 100_000):
        cache = CellCache(entries, width)
        for _ in range(2):  # the second time from the cache
            entry, far = cache.nearest(parts)
            assert (entry == distance.argmin(axis=1)).all() and (far == distance.min(axis=1)).all()
        assert width > 1000 or cache.evaluated < len(entries) * cache.rows / 2


def test_codes_do_not_depend_on_cell_width(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert len({train_codebooks(df, cell_width=w, rounds=2).sha256 for w in (32, 512, 1 << 20)}) == 1
    assert Codebooks(np.array([[[1, -2]], [[3, 4]]]), 1.0, 1).sha256 == sha256(b"1,-2,3,4").hexdigest()


def brute(rows, asks, k):
    """The k nearest of every query, ties by key; rows with one key and vector count once."""
    kept = sorted({(r.vec_id, tuple(r.embedding)) for r in usable(rows) if r.vec_id is not None and any(r.embedding)})
    width = max(len(v) for _, v in kept)
    x = np.array([[*v, *[0.0] * (width - len(v))] for _, v in kept], float)
    keys = np.array([key for key, _ in kept])
    out = {}
    for i in np.flatnonzero([asks(key) for key in keys]):
        score = x @ x[i]
        other = np.flatnonzero(keys != keys[i])
        out.setdefault(int(keys[i]), []).append([(int(keys[j]), score[j]) for j in other[np.lexsort((keys[other], -np.round(score[other], 9)))][:k]])
    return out


def test_nearest_of_odd_rows(spark, odd_vectors):
    asks = lambda key: key % 4 == 0
    want = brute(odd_vectors.collect(), asks, 20)
    got = {}
    for r in nearest_vectors(odd_vectors, F.col("vec_id") % 4 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    for key, lists in want.items():
        assert len(got[key]) == sum(map(len, lists))
        if len(lists) == 1:
            assert [r["rank"] for r in got[key]] == list(range(1, len(lists[0]) + 1))
            assert [r.vec_id for r in got[key]] == [j for j, _ in lists[0]]
            assert np.allclose([r.score for r in got[key]], [s for _, s in lists[0]], rtol=1e-12)
    few = odd_vectors.where("vec_id < 9")
    assert {r.query_id: r["count"] for r in nearest_vectors(few, F.col("vec_id") % 4 == 0).groupBy("query_id").count().collect()} == {0: 9, 4: 9, 8: 16}
    assert nearest_vectors(odd_vectors.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    assert nearest_vectors(odd_vectors.where("vec_id = 0"), F.lit(True)).count() == 0


def test_recall(spark):
    """On the given vectors, and on longer tables of unlike lengths with a third of all rows equal."""
    for folder in (SMALL, SMALL.replace("0.001", "0.1")):
        rows = spark.read.parquet(f"{folder}/embeddings.parquet")
        want = {(q, j) for q, lists in brute(rows.collect(), lambda key: key % 20 == 0, 20).items() for found in lists for j, _ in found}
        got = queries.QUERIES["op12_nearest_vectors"](spark, folder).collect()
        assert len(got) == len(want)
        assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 12)) * 3
    x = np.concatenate([centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 12)) * 0.3, np.tile(centres[0], (3000, 1))]) * rng.uniform(0.5, 2, (9000, 1))
    x[6000:] = centres[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = nearest_vectors(df, F.col("vec_id") % 100 == 0, leaf_rows=16, sample=1000).collect()
    assert len(found) == 90 * 20
    hits = 0
    for q in range(0, 9000, 100):
        score = x @ x[q]
        score[q] = -INF
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert np.allclose([r.score for r in own], [score[r.vec_id] for r in own], rtol=1e-9)
        hits += sum(r.score >= np.sort(score)[-20] - 1e-9 for r in own)
    assert hits >= 0.9 * 90 * 20


def test_given_queries_read_whole_tables(spark):
    ids = set(pq.read_table(f"{SMALL}/embeddings.parquet")["vec_id"].to_pylist())
    assert {r.vec_id for r in queries.QUERIES["op11_vector_codes"](spark, SMALL).select("vec_id").collect()} == ids
