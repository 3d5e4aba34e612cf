"""Row by row operators against plain Python on whole tables, and on odd rows."""

import random
import re
import time
from collections import Counter
from hashlib import sha256

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placewise.llm import bpe, chat, html, quality, queries, secrets
from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS

DOCS = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- BPE ----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


def test_bpe_equals_library(spark, library):
    got = rows(queries.QUERIES["op6_bpe"](spark, SMALL))
    assert len(got) == len(DOCS)
    for d in DOCS:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want = sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["ids_sha256"]) == (len(ids), want)
        assert got[d["doc_id"]]["decoded_sha256"] == sha256(decoded.encode()).hexdigest()


def test_bpe_odd_texts(odd, library):
    path = queries.vocabulary("word_bpe_49k.json")
    out = bpe.decode_bpe(bpe.encode_bpe(odd, path), path)
    assert "IDS" not in out.columns and out.columns.count("ids") == 1
    found = out.collect()
    assert len(found) == len(ODD_TEXTS) + 2
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_long_words_are_merged_in_time(library):
    model, rng = bpe.load_bpe(queries.vocabulary("word_bpe_49k.json")), random.Random(4)
    words = ["".join(rng.choice(kind) for _ in range(n)) for kind in ("ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzäßé") for n in (2, 63, 64, 65, 66, 300, 5000)]
    words += ["a" * n for n in (64, 65, 129, 4001)] + ["the" * 900, "abcabcab" * 50]
    for word in words:
        letters = "".join(model.letters[b] for b in word.encode())
        want = library.encode(word, add_special_tokens=False).ids
        assert model.merge_exactly(letters) == want == model.encode([word])[0].tolist()
        if len(word) < 400:
            parts = [model.ids[c] for c in letters[:-1]] + [model.ids[letters[-1] + bpe.WORD_END]]
            assert model._merge_long(list(parts)) == model._merge_short(list(parts))
    start = time.perf_counter()
    million = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    got = model.encode([million])[0].tolist()
    assert time.perf_counter() - start < 60
    assert got == library.encode(million, add_special_tokens=False).ids


def test_guesses_are_checked():
    """Some longest-match guesses are wrong; checking finds exactly those."""
    model = bpe.load_bpe(queries.vocabulary("word_bpe_49k.json"))
    words = sorted({w for d in DOCS for w in model.find((d["text"] or "").lower())})
    letters = ["".join(model.letters[b] for b in w.encode()) for w in words]
    exact = [model.merge_exactly(x) for x in letters]
    guesses = [model._propose(x) for x in letters]
    assert any(g != e for g, e in zip(guesses, exact))
    model.words.clear()
    assert [list(x) for x in model.encode(words)] == exact


# --- secrets ------------------------------------------------------------------------------------------------
def plain_base(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


BODY = "abcdefghijKLMNOPQRST0123456789"
TRICKY = [
    "Token=token=token = 'abcdef' PASSWORD:x secret   :   \"longvalue\"", "apikey=API_KEY=12345 api_key=123456", "AKIA" + "A" * 16 + "AKIA" + "B" * 12, "AKIAAKIA" + "Z9" * 8,
    "é" * 7 + "0123456789abcdef01234567" + "g" + "f" * 23 + "G" + "a" * 100, "İ token=abcdefg K toKen=abcdefg", "password=" + "a1" * 20 + "==",
    f"ghp_{BODY}{secrets.checksum62(BODY)} ghp_{BODY}AAAAAA npm_{BODY}{secrets.checksum62(BODY)}x",
]


@pytest.mark.parametrize("text", [*TRICKY, *(t or "" for t in ODD_TEXTS)])
def test_base_spans(text):
    assert [s for s in secrets.find_spans(text) if s[0] != "issuer"] == plain_base(text)


def test_checksums():
    assert [k for k, _, _ in secrets.find_spans(TRICKY[-1])] == ["issuer"]


def test_secrets_query(spark):
    got = rows(queries.QUERIES["op5_secrets"](spark, SMALL))
    for d in DOCS:
        base = plain_base(d["text"] or "")
        assert got[d["doc_id"]]["base_sha256"] == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[d["doc_id"]]["n_hex"] == sum(k == "hex" for k, _, _ in base)
    assert any(r["n_access"] for r in got.values()) or len(DOCS) < 1000


def test_redaction(spark, odd):
    assert secrets.redact("a token=abcdef0123456789abcdef0123 z", secrets.find_spans("a token=abcdef0123456789abcdef0123 z")) == "a [secret] z"
    assert secrets.redact_secrets(odd).where(F.col("text").isNull()).count() == 1


# --- quality ------------------------------------------------------------------------------------------------
def plain_statistics(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet").select("text"), odd):
        for r in quality.add_statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text or "")


def test_quality_verdicts(spark):
    """Most rows labelled bad go, nearly all good ones stay."""
    folder = SMALL.replace("0.001", "0.01")
    judged = queries.QUERIES["op9_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    shares = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[0] < 0.1 and shares[1] > 0.9


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge_quality(odd, none).collect()
    assert len(judged) == len(ODD_TEXTS) + 2
    assert all(r.kept == (not r.base_failed) for r in judged)
    half = spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 1, 0), (5, 1, 0), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(odd, half).count() == len(ODD_TEXTS) + 2
    assert quality.judge_quality(odd.limit(0), half).count() == 0


def test_forest_counts_every_labelled_row(spark):
    """More labelled texts than a sample of 20,000 holds: all good ones are in the trees, and the threshold is the best cut over all rows that loses few good ones."""
    words = F.expr("array_join(transform(sequence(1, 60 + cast(id % 40 as int)), i -> substr(md5(concat(id % 700, ' ', i)), 1, 3 + cast(i % 5 as int))), ' ')")
    bad = F.col("id") % 7 == 0
    docs = spark.range(0, 22_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(bad, F.upper(F.concat(words, F.lit(" ### !!! $ %")))).otherwise(words).alias("text"))
    labels = spark.range(22_000).select(F.col("id").alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"))
    forest = quality.train_quality_forest(docs, labels)
    assert forest.n_rows == sum(i % 7 > 0 for i in range(22_000))
    judged = quality.judge_quality(docs, labels, keep_text=False).select("doc_id", "anomaly", "kept").collect()
    good, other = (sorted(r.anomaly for r in judged if (r.doc_id % 7 > 0) == side) for side in (True, False))
    lost, caught = (sum(a >= forest.threshold for a in side) / len(side) for side in (good, other))
    assert lost <= 0.0021 and caught > 0.95
    assert all(r.kept == (r.anomaly < forest.threshold) for r in judged)


# --- HTML ---------------------------------------------------------------------------------------------------
LONG = "Some prose, with commas, that goes on for a while and says a thing or two about nothing much, really."
PAGES = {
    f"<html><body><nav><a href=x>Menu</a></nav><header>Site</header><article><header><h1>Title</h1></header><p>{LONG}<p>Second &amp; last&nbsp;one</article>"
    f"<div class=sidebar><p>{LONG}</p></div><div id='comments'><p>{LONG}{LONG}</p></div><footer>&copy;</footer>": f"Title\n{LONG}\nSecond & last one",
    f"<div id=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><ul><li>first<li>second</ul><form>Name <input></form></div><div class='cookie-notice'>We use {LONG}</div>": f"Head\n{LONG}\n{LONG}\nfirst\nsecond",
    f"<main><p>a <b>bold</b> and<br>broken   line</p><script>var x='<p>no</p>';</script><table><tr><td>cell<td>{LONG}</table></main>": f"a bold and broken line\ncell\n{LONG}",
    "": "", "plain text &lt;only&gt;": "plain text <only>", "<p>1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "<script>only()</script>": "", "<!-- open comment <p>gone": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


@pytest.mark.parametrize("name", ["content no-sidebar", "main-content has-sidebar", "post menu-open", "entry share-enabled", "layout with-sidebar"])
def test_junk_names_around_the_article(name):
    inner = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class=sidebar><p>{LONG}</p></div>"
    want = f"Title\n{LONG}\n{LONG}"
    assert html.main_text(f"<body><div>Site</div><div class='{name}'>{inner}</div><div class=comments><p>{LONG * 3}</p></div></body>") == want
    assert html.main_text(f"<body><form action=x><div>{inner}</div></form></body>") == want
    assert html.main_text(f"<body><div class=sidebar><p>{LONG}</p></div><div class='{name}' hidden>{inner}</div><p>{LONG}</p></body>") == LONG


def test_sections_with_few_points():
    first, second = "one, two, three, four, five, six, seven, eight, nine and ten", "uno, due, tre, quattro, cinque and sei"
    assert html.main_text(f"<body><div><div><p>{first}</p></div><div><p>{second}</p></div></div></body>") == f"{first}\n{second}"


def test_deep_and_broken_pages():
    assert html.main_text("<div>" * 20_000 + LONG) == LONG
    assert html.main_text("</p></div><p a='>'>x</b></i>") == "x"


COMMENTS = "I think, as others said, that this is so, and more. " * 24


@pytest.mark.parametrize("page, want", [
    (f"<article><p>{LONG}</p></article><div class=comments>{COMMENTS}</div>", LONG),
    (f"<article><p>{LONG}</p><section class='user-comments'><p>{COMMENTS}</p></section></article>", LONG),
    (f"<div class='cookie-notice'><p>{COMMENTS}</p></div><div><p>{LONG}</p></div>", LONG),
    (f"<main><p>{LONG}</p></main><div class='promo content'><p>{COMMENTS}</p></div><form class=signup><p>{COMMENTS}</p></form>", LONG),
    (f"<article><p>{LONG}</p></article><div class='sidebar'><p>{COMMENTS * 5}</p></div>", LONG),
    (f"<div class='post comments-open'><p>{LONG}</p></div>", LONG),
])
def test_no_comments_for_the_article(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page, size", [
    ("<a " * 300_000, 899_999), ("<div>" * 8000 + "</b>" * 100_000, 0), ("<p>" + "<span>" * 50_000 + "<hr>" * 50_000, 0), ("<a \" " * 99_999 + "\">\"", 1),
    ("<ul>" + "<li>x" * 50_000, 99_999), ("<ul><li>" * 20_000, 0), ("<!--" * 200_000, 0), ("<table>" + "<tr><td>x" * 50_000, 99_999),
])
def test_broken_pages_take_linear_time(page, size):
    began = time.process_time()
    assert len(html.main_text(page)) == size
    assert time.process_time() - began < 5


def test_pages_of_odd_rows(spark):
    pages = [(1, None, "a"), (2, "", "b"), (3, f"<p>{LONG}</p>", None), (3, f"<p>{LONG}</p>", None), (None, "<nav>menu</nav>", "c"), (4, f"<p>{LONG}</p><p>{LONG}</p>", "d"), (5, "<b" * 100_000, "e")]
    df = spark.createDataFrame(pages, "page_id long, html string, MAIN_TEXT string").repartition(3)
    made = html.extract_main_text(df)
    assert made.columns == ["page_id", "html", "main_text"]
    got = sorted(((r.page_id or 0, r.main_text) for r in made.collect()), key=repr)
    assert got == sorted([(0, ""), (1, ""), (2, ""), (3, LONG), (3, LONG), (4, f"{LONG}\n{LONG}"), (5, "<b" * 100_000)], key=repr)
    assert html.extract_main_text(df, keep_html=False).columns == ["page_id", "main_text"]
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_pages_query(spark):
    import html as references

    got = rows(queries.QUERIES["op8_main_text"](spark, SMALL), "page_id")
    for page in pq.read_table(f"{SMALL}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub("<[^>]+>", " " if "<br>" == "" else "", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[page["page_id"]]["text"] == "\n".join(b for b in blocks if b)


# --- chat ---------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    odd = [("user", queries.CHAT_TEST), ("a: b\\", "### x: </turn>\n\\"), ("assistant", "####\\### </turn></turn>"), (None, None), ("assistant", "<|endoftext|>"), ("assistant", "é🎉")]
    turns = spark.createDataFrame([(1, i, r, t, 0) for i, (r, t) in enumerate(odd)] + [(None, None, "user", "hi", 0), (2, 0, "user", "same", 0), (2, 0, "user", "same", 0)], "conv_id long, turn long, role string, text string, n_turns int")
    path = queries.vocabulary("byte_bpe_50k.json")
    made = chat.format_chat(turns, path)
    read = rows(chat.read_chat(made, path), "conv_id")
    assert [(r.role, r.text) for r in read[1]["turns"]] == [(r or "", t or "") for r, t in odd]
    assert read[1]["loss_text"] == "".join(t for r, t in odd if r == "assistant")
    assert len(read[2]["turns"]) == 2 and len(read[None]["turns"]) == 1
    formatted = rows(made, "conv_id")[1]["formatted"]
    again = re.findall(r"### ((?:[^\\:]|\\.)*?): (.*?)</turn>\n", formatted, re.S)
    assert [(chat.unescape(r), chat.unescape(t)) for r, t in again] == [(r or "", t or "") for r, t in odd]
    assert chat.format_chat(turns.limit(0), path).count() == 0
