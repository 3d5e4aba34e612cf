"""Labelled sign texts from a vocabulary, with seeded noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.text import fold_accents
from placewise.operators.relational import take_per_label
from placewise.tables import materialize

# --- Fixed values -------------------------------------------------------------------------------------------
CLEAN_SHARE, LIGHT_SHARE = 0.80, 0.10
LIGHT_UNACCENT, LIGHT_LOWER, HEAVY_UNACCENT = 0.7, 0.6, 0.85
CONFUSED_SHARE, STRAY_SHARE = 0.12, 0.08
LOOKALIKES = {
    "Oo0": ["0", "O", "o", "D"], "Il1i": ["1", "I", "l", "|"], "A4a": ["4", "A", "a"], "E3e": ["3", "E", "e"],
    "G6": ["6", "G", "9"], "B8": ["8", "B"], "S5": ["5", "S"], "Z2": ["2", "Z"],
}
STRAY_MARKS = ["@", "#", "!"]
MIN_LENGTH = 4
# ------------------------------------------------------------------------------------------------------------

_CHUNK = 1000


def _dice(seed: int, *parts: Column | str) -> Column:
    """Uniform number in 0..1 from a hash of the row's key; the same key gives the same number."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def _pick(values: Column, dice: Column) -> Column:
    return F.get(values, F.floor(dice * F.size(values)).cast("int"))


def _heavy(text: Column, key: Column, seed: int) -> Column:
    """Look-alike letters, stray marks and lost blanks; one of three kinds leaves the text as it is."""
    base = F.when(_dice(seed + 20, key) < HEAVY_UNACCENT, fold_accents(text)).otherwise(text)
    letters = F.split(base, "")

    def roll(n: int, i: Column) -> Column:
        return _dice(seed + n, key, i)

    def confuse(letter: Column, i: Column) -> Column:
        swapped = letter
        for alike, options in LOOKALIKES.items():
            swapped = F.when(letter.isin(list(alike)), _pick(F.array(*[F.lit(o) for o in options]), roll(22, i))).otherwise(swapped)
        return F.when(roll(21, i) < CONFUSED_SHARE, swapped).otherwise(letter)

    def stray(letter: Column, i: Column) -> Column:
        mark = F.when(letter == " ", F.when(roll(24, i) < 0.5, "\n").otherwise("")).when(roll(24, i) < 0.5, "*").otherwise(
            _pick(F.array(*[F.lit(m) for m in STRAY_MARKS]), roll(25, i))
        )
        return F.concat(F.when(roll(23, i) < STRAY_SHARE, mark).otherwise(""), letter)

    kind = F.floor(_dice(seed + 26, key) * 3)
    noisy = F.when(kind == 0, F.array_join(F.transform(letters, confuse), "")).when(
        kind == 2, F.array_join(F.transform(letters, stray), "")
    ).otherwise(base)
    return F.coalesce(F.nullif(F.trim(noisy), F.lit("")), base)


def add_noise(text: Column, key: Column, seed: int) -> Column:
    """80 % clean, 10 % light (no accents, or letter case), 10 % heavy noise."""
    share = _dice(seed + 10, key)
    light = F.when(_dice(seed + 11, key) < LIGHT_UNACCENT, fold_accents(text)).when(
        _dice(seed + 12, key) < LIGHT_LOWER, F.lower(text)
    ).otherwise(F.upper(text))
    return F.when(share < CLEAN_SHARE, text).when(share < CLEAN_SHARE + LIGHT_SHARE, light).otherwise(_heavy(text, key, seed))


def generate_corpus(vocabulary: DataFrame, names: list[str], per_label: int, seed: int = 7, most: int = 50) -> DataFrame:
    """``per_label`` unique (text, label) rows per label.

    ``vocabulary`` has one row per label: label, keywords, prefixes, suffixes (string arrays). Drafts are made in
    parallel, each by one of five templates; labels that are short draw again, twice as many, up to ``most`` times
    ``per_label`` drafts in all. ``corpus_shortfall`` tells the labels whose words cannot make that many texts.
    """
    kept, short, begin, end = None, vocabulary, 0, per_label * 2
    while True:
        drafts = _drafts(short, names, begin, end, seed)
        drafts = drafts if kept is None else kept.unionByName(drafts)
        kept = materialize(drafts.groupBy("label", "text").agg(F.min("seq").alias("seq")))
        full = materialize(kept.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= per_label))
        short = vocabulary.join(full, vocabulary["label"] == full["label"], "left_anti")
        if end >= most * per_label or short.isEmpty():
            return take_per_label(kept, per_label).select("text", "label")
        begin, end = end, min(2 * end, most * per_label)


def corpus_shortfall(made: DataFrame, vocabulary: DataFrame, per_label: int) -> DataFrame:
    """(label, missing) of the labels with fewer than ``per_label`` rows."""
    counts = made.groupBy("label").agg(F.count("*").alias("n"))
    missing = (F.lit(per_label) - F.coalesce("n", F.lit(0))).alias("missing")
    return vocabulary.select("label").join(counts, "label", "left").select("label", missing).where("missing > 0")


def _drafts(vocabulary: DataFrame, names: list[str], begin: int, end: int, seed: int) -> DataFrame:
    """(label, text, seq): the noisy drafts with numbers from ``begin`` to ``end`` of every label."""
    # Each label's row is spread as chunks of draft numbers, then every chunk is unrolled where it landed.
    chunks = vocabulary.withColumn("_chunk", F.explode(F.sequence(F.lit(begin // _CHUNK), F.lit((end - 1) // _CHUNK))))
    numbers = F.sequence(F.greatest(F.col("_chunk") * _CHUNK, F.lit(begin)), F.least((F.col("_chunk") + 1) * _CHUNK, F.lit(end)) - 1)
    drafts = chunks.repartition("label", "_chunk").withColumn("seq", F.explode(numbers)).drop("_chunk")
    key = F.concat_ws("/", "label", F.col("seq").cast("string"))

    def word(values: str, n: int) -> Column:
        return _pick(F.col(values), _dice(seed + n, key))

    pre, kw, suf = word("prefixes", 1), word("keywords", 2), word("suffixes", 3)
    name = _pick(F.array(*[F.lit(n) for n in names]), _dice(seed + 4, key))
    kind = F.floor(_dice(seed + 5, key) * 5)
    text = (
        F.when(kind == 0, F.concat_ws(" ", pre, kw)).when(kind == 1, F.concat_ws(" ", kw, suf))
        .when(kind == 2, F.concat_ws(" ", pre, kw, name)).when(kind == 3, F.concat_ws(" ", kw, name, suf))
        .otherwise(F.concat_ws(" ", pre, kw, suf))
    )
    made = drafts.select("label", "seq", text.alias("clean"), key.alias("_key"))
    made = made.select("label", add_noise(F.col("clean"), F.col("_key"), seed).alias("text"), "seq")
    return made.where(F.length("text") >= MIN_LENGTH)


def write_corpus(corpus: DataFrame, path: str, seed: int = 7) -> None:
    """CSV with header, every value quoted, rows in a seeded random order; texts may hold line breaks and quotes."""
    rows = corpus.orderBy(F.xxhash64(F.lit(seed), "text", "label"))
    rows.write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a written corpus."""
    return spark.read.csv(path, header=True, schema="text string, label string", multiLine=True, escape='"')
