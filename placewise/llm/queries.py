"""The registered queries of this subpackage, and comparison SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHAT_TEST = r"\### Assistant: </turn> ok"


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_shard(spark, folder):
    """All documents in 8 shards of near equal bytes."""
    from placewise.llm.sharding import shard_documents

    out = shard_documents(table(spark, folder, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op2_chat(spark, folder):
    """All conversations formatted with a byte-level vocabulary, and what can be read back from the ids."""
    from placewise.llm.chat import format_chat, read_chat

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_TEST).alias("text"),
    )
    path = vocabulary("byte_bpe_50k.json")
    read = read_chat(format_chat(turns.unionByName(extra), path), path)
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op2_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>') AS safe_text,
    replace(replace(replace(replace(role, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>'), ':', '\:') AS safe_role FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, safe_role, safe_text) AS all_turns,
    coalesce(string_agg(text, '' ORDER BY turn, safe_role, safe_text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('### ' || safe_role || ': ' || safe_text || '</turn>' || chr(10))) AS formatted_chars
  FROM escaped GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined"""


@query
def op5_secrets(spark, folder):
    """Secrets in every document."""
    from placewise.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(named(base), 256).alias("base_sha256"), named("secret_spans").alias("spans"))


@query
def op6_bpe(spark, folder):
    """Every document encoded, and its ids decoded."""
    from placewise.llm.bpe import encode_bpe, id_lists, load_bpe
    from placewise.llm.rows import add_columns

    path = vocabulary("word_bpe_49k.json")

    def digest(column):
        """Read from the ids alone."""
        from hashlib import sha256

        lists, decode = id_lists(column), load_bpe(path).decode
        return [
            [len(x) for x in lists], [sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists], [sha256(decode(x).encode()).hexdigest() for x in lists],
        ]

    coded = encode_bpe(table(spark, folder, "documents").select("doc_id", "text"), path, keep_text=False)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return add_columns(coded, "ids", fields, digest, arrow=True, keep_text=False)


@query
def op8_main_text(spark, folder):
    """The main text of every page."""
    from placewise.llm.html import extract_main_text

    found = extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"), text="main_text", keep_html=False)
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


@query
def op9_quality(spark, folder):
    """Rule statistics and verdict of every document."""
    from placewise.llm.quality import judge_quality

    judged = judge_quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query
def op3_decontaminate(spark, folder):
    """Every benchmark item that a document holds."""
    from placewise.llm.decontamination import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_repeated_passages(spark, folder):
    """Passages of 50 words or more that documents share, exactly or nearly."""
    from placewise.llm.substring_dedup import near_duplicate_passages

    return near_duplicate_passages(table(spark, folder, "documents"))


@query
def op7_near_duplicates(spark, folder):
    """Groups of documents with similar 3-word shingles."""
    from placewise.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), k=3, percent=85)


@query
def op10_language_model(spark, folder):
    """Log10 probabilities of all documents under a model of nine tenths of them."""
    from placewise.llm.ngram_lm import is_held_out, score_documents, train_bigrams

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train_bigrams(docs.where(~is_held_out("doc_id")))
    scored = score_documents(docs, model, keep_text=False).withColumn("held_out", is_held_out("doc_id")).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_vector_codes(spark, folder):
    """Every vector as eight codebook indexes."""
    from placewise.llm.vector_codes import encode_vectors, train_codebooks
    from placewise.tables import materialize

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    books = train_codebooks(vectors)
    coded = materialize(encode_vectors(vectors, books).select("vec_id", "label", "code", "error"))
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    out = coded.join(by_label, coded["label"].eqNullSafe(by_label["label"]))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return out.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other; all values are whole numbers."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "comps AS MATERIALIZED (SELECT rid, unnest(range(len(embedding))) AS pos, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x, len(embedding) AS dims FROM kept)",
        f"parts AS MATERIALIZED (SELECT rid, pos // (dims // {parts}) AS p, pos % (dims // {parts}) AS d, x FROM comps)",
        f"book0 AS MATERIALIZED (SELECT p, rid AS e, d, x AS y FROM parts WHERE rid < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT rid, p, min(s * {entries} + e) % {entries} AS e, min(s * {entries} + e) // {entries} AS s FROM "
            f"(SELECT rid, a.p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS s FROM parts a JOIN book{r} b ON a.p = b.p AND a.d = b.d GROUP BY ALL) t GROUP BY rid, p)"
        )
        if r < rounds:
            steps.append(
                f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.d, coalesce(m.y, b.y) AS y FROM book{r} b LEFT JOIN (SELECT a.p, n.e, a.d, "
                f"CAST(sum(x) AS BIGINT) // count(*) - CASE WHEN CAST(sum(x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS y FROM parts a JOIN near{r} n ON a.rid = n.rid AND a.p = n.p GROUP BY ALL) m "
                f"ON m.p = b.p AND m.e = b.e AND m.d = b.d)"
            )
    steps.append(f"coded AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM near{rounds} GROUP BY rid)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, d)) FROM book{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (rid)"
    )


ORACLES["op11_vector_codes"] = _codes_sql()


@query
def op12_nearest_vectors(spark, folder):
    """The 20 nearest vectors of every twentieth vector."""
    from placewise.llm.vector_search import nearest_vectors

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors, F.col("vec_id") % 20 == 0)


@query
def op13_filter_audit(spark, folder):
    """What each of five text filters removes, by source and order of the filters."""
    from placewise.llm.filter_audit import audit_filters

    return audit_filters(table(spark, folder, "documents").select("doc_id", "text", "source"), table(spark, folder, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH texts AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, l.good, l.toxic FROM documents d LEFT JOIN
  (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
worded AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM texts),
failing AS (SELECT part, good, toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask FROM worded),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
  JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
bits AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
steps AS (SELECT o, step, 1 << (ascii(o[step]) - 65) AS own, CAST((SELECT sum(1 << (ascii(x) - 65)) FROM (SELECT unnest(string_split(o[:step - 1], '')) AS x) y WHERE x <> '') AS INTEGER) AS earlier FROM bits),
counted AS (SELECT part, o, step, own,
    sum(CASE WHEN mask & (coalesce(earlier, 0) | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""
