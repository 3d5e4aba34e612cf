import pytest
from pyspark.sql import types as T

ODD_TEXTS = [
    None, "", " ", "\n\t\x0b", "one", "two words", "a b c", "ÀÉ ſtraße K İstanbul ΣΑΣ", "tie tie tie", "tie tie tie", "x" * 50_000, "word " * 30_000, "\x00 \x1c\x85 ok",
    "emoji 🎉🎉 and\r\nlines\nlines\nlines", "<|endoftext|> and <|startoftext|>mid<|endoftext|>", "don't we'll I'd 123 45", "é combining",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("IDS", T.StringType()), T.StructField("n_words", T.DateType())])
    rows = [(i if i != 3 else None, t, "mine" if i % 2 else None, None) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], schema).repartition(3)
