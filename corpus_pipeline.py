"""From raw documents to token ids: quality rules, near-duplicates, benchmark leaks, secrets, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.bpe import encode_bpe
from placewise.llm.decontamination import drop_leaking
from placewise.llm.minhash import keep_one_of_each
from placewise.llm.quality import add_statistics, add_verdict, train_quality_forest
from placewise.llm.queries import table, vocabulary
from placewise.llm.secrets import redact_secrets
from placewise.tables import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep. Null and empty texts go: they have no words."""
    forest = train_quality_forest(docs, table(spark, sf_dir, "labels"))
    apart = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_pw_row"))  # so that no column's name can clash
    judged = add_verdict(add_statistics(apart, "_pw_row", forest, part="text"), forest)
    return judged.where("kept").select("_pw_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8), the one with the smallest doc_id; rows without doc_id stay."""
    return keep_one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the new text."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids and n_tokens."""
    out = encode_bpe(docs, vocabulary("word_bpe_49k.json"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("hide_secrets", hide_secrets), ("encode", encode),
]
ORACLE_SQL = None  # SQL has no isolation forest; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
