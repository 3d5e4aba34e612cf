"""The filter audit against a plain count of documents, order by order."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np

from placewise.llm import queries
from placewise.llm.filter_audit import FILTERS, audit_filters, surviving
from tests.conftest import SMALL

WORDS = re.compile("[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    """docs: (key, text, part); labels: (key, quality, toxic)."""
    good, toxic = ({key for key, *said in labels if said[i] == 1} for i in (0, 1))
    failing = []
    for key, text, part in docs:
        text = text or ""
        words = WORDS.findall(text)
        failing.append((part or "", key, {
            *["A"] * (len(words) < 200), *["B"] * (100 * len(set(words)) < 50 * len(words)), *["C"] * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
            *["D"] * bool(re.search("[#$%&*|]", text)), *["E"] * any(k is not None and key is not None and k < key and (t or "") == text for k, t, _ in docs),
        }))
    out = {}
    for part in {f[0] for f in failing}:
        own, shapley = [f for f in failing if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[2]]
                left = [f for f in left if c not in f[2]]
                shapley[c] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(c in f[2] for f in own) - len(gone), sum(f[2] == {c} for f in own), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def as_dict(df):
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(out) == len(rows)
    return out


def test_walk_gives_every_subset():
    cells = np.random.default_rng(1).integers(0, 9, (3, 32, 2))
    states = surviving(cells, 5)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_audit_of_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(250))
    half = " ".join(["a b"] * 100)
    rows = [
        (1, many, "x"), (2, many, "x"), (2, many, "x"), (3, many, None), (4, many, ""), (None, many, "x"), (5, None, "y"), (6, "", "y"), (7, None, None), (8, "A" * 3 + "b" * 147, "y"),
        (9, "A" * 3 + "b" * 146, "y"), (10, half, "x"), (11, half + " c" * 2, "x"), (12, "one # sign", "z"), (13, "\x0b \x0c", "z"), (14, "word " * 50_000, "z"), (1, "another text with key 1", "x"),
        (15, " ".join(f"É{i}" for i in range(200)), "z"), (-1, many, "only last"),
    ]
    labels = [(1, 1, 0), (1, None, 1), (2, 1, None), (5, 0, 1), (None, 1, 1), (99, 1, 1), (12, 1, 0), (12, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'mine' AS mask", "1 AS good", "2 AS digest").repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(rows, labels)
    assert as_dict(audit_filters(docs, said)) == want and len(want) == 5 * 600
    assert as_dict(audit_filters(docs, said.limit(0))) == plain_audit(rows, [])
    assert audit_filters(docs.limit(0), said).count() == 0
    assert FILTERS == "ABCDE"


def test_query_on_given_tables(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet'").fetchall()
    labels = con.execute(f"SELECT doc_id, quality, toxic FROM '{SMALL}/labels.parquet'").fetchall()
    assert as_dict(queries.QUERIES["op13_filter_audit"](spark, SMALL)) == plain_audit(docs, labels)
