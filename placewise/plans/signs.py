"""From OCR lines and extraction output to one record per sign, and category classification."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import HashingTF, IDF, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.contact import coerce_extraction, extract_emails, extract_websites, merge_phones
from placewise.operators.ocr import read_signs
from placewise.operators.relational import first_category_containing

NO_DATA, UNKNOWN = "Thiếu dữ liệu", "Chưa xác định"


def classifier_text(brand: Column, service: Column) -> Column:
    """Lower-cased text the category is predicted from."""
    return F.trim(F.lower(F.concat_ws(" ", F.array_join(brand, " "), F.array_join(service, " "))))


def assemble_signs(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """One record per sign from its lines and the extraction output (image_id, answer)."""
    signs = read_signs(lines).join(answers, "image_id", "left")
    combined = F.array_join("texts", " ")
    rest = F.array_join("remaining", " ")
    signs = signs.withColumn("_x", coerce_extraction(F.when(rest != "", F.col("answer")), rest))
    no_text = F.array().cast("array<string>")
    return signs.select(
        "image_id", "_x.brand", "_x.service", "_x.other",
        F.when(F.col("address") != "", F.array("address")).otherwise(no_text).alias("address"),
        merge_phones(F.col("phones")).alias("phone"),
        extract_emails(combined).alias("email"), extract_websites(combined).alias("website"),
        "texts", classifier_text(F.col("_x.brand"), F.col("_x.service")).alias("class_text"),
    )


def with_category_id(signs: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``category_id`` for a predicted ``category`` name."""
    return first_category_containing(signs, "category", categories)


def category_classifier(features: int = 1 << 16, max_iter: int = 30) -> Pipeline:
    """Word and word-pair TF-IDF into one linear SVC per category, for a table of ``text`` and ``label``."""
    stages = [
        StringIndexer(inputCol="label", outputCol="_label", handleInvalid="skip"),
        RegexTokenizer(inputCol="text", outputCol="_words", pattern="\\s+", toLowercase=True),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        HashingTF(inputCol="_words", outputCol="_tf1", numFeatures=features),
        HashingTF(inputCol="_pairs", outputCol="_tf2", numFeatures=features),
        VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_features"),
        OneVsRest(classifier=LinearSVC(maxIter=max_iter), featuresCol="_features", labelCol="_label", predictionCol="_class"),
    ]
    return Pipeline(stages=stages)


def train_categories(corpus: DataFrame, **options):
    return category_classifier(**options).fit(corpus)


def classify(signs: DataFrame, model=None) -> DataFrame:
    """Add ``category`` from ``class_text``: unknown without a model or any text, no data without brand and service."""
    has_text = F.size("texts") > 0
    fallback = F.when(~has_text, UNKNOWN).when(F.col("class_text") == "", NO_DATA)
    if model is None:
        return signs.withColumn("category", F.coalesce(F.when(has_text & (F.col("class_text") == ""), NO_DATA), F.lit(UNKNOWN)))
    indexer, *rest = model.stages
    scored = signs.withColumn("text", F.col("class_text"))
    for stage in rest:
        scored = stage.transform(scored)
    named = IndexToString(inputCol="_class", outputCol="_name", labels=indexer.labels).transform(scored)
    return named.withColumn("category", F.coalesce(fallback, F.col("_name"))).select(*signs.columns, "category")
