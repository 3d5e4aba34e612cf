"""Name normalisation and similarity as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score weights, decision thresholds.
WEIGHT_PARTIAL, WEIGHT_TOKEN_SET, WEIGHT_LEVENSHTEIN = 0.40, 0.35, 0.25
WARNING_AT, REJECT_AT = 0.70, 0.88

# Letters that do not decompose into a base letter and a mark.
_PLAIN_LETTERS = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ð": "d", "ħ": "h", "ı": "i"}
_WIDE_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}


def _fold_pairs(plain: dict[str, str]) -> tuple[str, str]:
    """Source and target alphabets for ``translate``: Latin letters to their base letter.

    Combining marks come last and have no target, so ``translate`` drops them.
    """
    pairs = dict(plain)
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if base != letter and len(base) == 1:
            pairs[letter] = base
    marks = "".join(chr(c) for c in range(0x0300, 0x0370) if unicodedata.category(chr(c)) == "Mn")
    return "".join(pairs) + marks, "".join(pairs.values())


_NFD_FROM, _NFD_TO = _fold_pairs({"đ": "d", "Đ": "D"})
_ASCII_FROM, _ASCII_TO = _fold_pairs(_PLAIN_LETTERS)


def fold_accents(text: Column) -> Column:
    """Latin text without accents, case kept (the transliteration used for ids and for corpus noise)."""
    out = F.translate(text, _ASCII_FROM, _ASCII_TO)
    for wide, plain in _WIDE_LETTERS.items():
        out = F.replace(out, F.lit(wide), F.lit(plain))
    return out


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, only ``a-z0-9`` and single blanks. Null gives ''."""
    folded = F.translate(F.lower(text), _NFD_FROM, _NFD_TO)
    return F.coalesce(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")), F.lit(""))


def make_id(text: Column) -> Column:
    """Slug for graph node ids."""
    slug = F.trim(F.lower(fold_accents(text)))
    return F.regexp_replace(F.regexp_replace(slug, r"(?U)\s+", "_"), r"(?U)[^\w]", "")


def _both_or_one_empty(a: Column, b: Column, otherwise: Column) -> Column:
    return (
        F.when((a == "") & (b == ""), F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(otherwise)
    )


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return _both_or_one_empty(a, b, F.lit(1.0) - F.levenshtein(a, b) / longest)


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter text against every window of its length in the longer text."""
    a_is_short = F.length(a) <= F.length(b)
    short, long = F.when(a_is_short, a).otherwise(b), F.when(a_is_short, b).otherwise(a)
    width = F.length(short)
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.length(long) - width + 1),
            lambda at: F.lit(1.0) - F.levenshtein(short, F.substring(long, at, width)) / width,
        )
    )
    return _both_or_one_empty(a, b, best)


def tokens(text: Column) -> Column:
    """Distinct blank-separated tokens."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Sorted common tokens, tokens only in ``a``, tokens only in ``b``."""
    ta, tb = tokens(a), tokens(b)
    return F.struct(
        F.array_sort(F.array_intersect(ta, tb)).alias("common"),
        F.array_sort(F.array_except(ta, tb)).alias("only_a"),
        F.array_sort(F.array_except(tb, ta)).alias("only_b"),
    )


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among (common+rest a, common+rest b, common)."""
    overlap = token_overlap(a, b)
    common = F.array_join(overlap["common"], " ")
    with_a = F.trim(F.concat(common, F.lit(" "), F.array_join(overlap["only_a"], " ")))
    with_b = F.trim(F.concat(common, F.lit(" "), F.array_join(overlap["only_b"], " ")))
    best = F.greatest(ratio(with_a, with_b), ratio(with_a, common), ratio(with_b, common))
    return _both_or_one_empty(a, b, best)


def similarity(norm_a: Column, norm_b: Column) -> Column:
    """Struct of the three metrics of two already normalised names; all 0 if either is ''."""
    usable = (norm_a != "") & (norm_b != "")
    zero = F.lit(0.0)
    return F.struct(
        F.when(usable, partial_ratio(norm_a, norm_b)).otherwise(zero).alias("partial_ratio"),
        F.when(usable, token_set_ratio(norm_a, norm_b)).otherwise(zero).alias("token_set_ratio"),
        F.when(usable, ratio(norm_a, norm_b)).otherwise(zero).alias("levenshtein_ratio"),
    )


# The symbols of normalised names.
_SYMBOLS = " abcdefghijklmnopqrstuvwxyz0123456789"
_COUNTED = 5  # bits for the count of a symbol
_SYMBOLS_A_WORD = 12
_PAIR_WORDS = 4


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _bits_of(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(_bit(F.pmod(h, F.lit(64)))))


def name_profile(norm: Column) -> Column:
    """What ``score_bound`` needs of a normalised name, in a few 64-bit words.

    ``bag*`` has the count of each symbol as so many bits, up to five, and ``rest`` what is beyond; ``pair*`` has a bit for each pair of neighbouring symbols, by hash, and
    ``pair_rest`` how many pairs have no bit of their own. Pairs are those of the name with a blank at both ends, so a token has the same pairs wherever it stands. ``tokens`` has a bit for each token.
    """
    length = F.length(norm)
    fields, over = {}, F.lit(0)
    for begin in range(0, len(_SYMBOLS), _SYMBOLS_A_WORD):
        bits = F.lit(0).cast("long")
        for place, symbol in enumerate(_SYMBOLS[begin : begin + _SYMBOLS_A_WORD]):
            many = length - F.length(F.replace(norm, F.lit(symbol), F.lit("")))
            kept = F.least(many, F.lit(_COUNTED))
            bits = bits.bitwiseOR(F.shiftleft(_bit(kept) - 1, _COUNTED * place))
            over = over + many - kept
        fields[f"bag{begin // _SYMBOLS_A_WORD}"] = bits
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), length + 1), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(2))), F.lit(64 * _PAIR_WORDS)))
    for word in range(_PAIR_WORDS):
        fields[f"pair{word}"] = _bits_of(F.filter(pairs, lambda h: F.floor(h / 64) == word))
    fields["pair_rest"] = length + 1 - F.size(F.array_distinct(pairs))
    fields["tokens"] = _bits_of(F.transform(tokens(norm), lambda t: F.xxhash64(t)))
    fields |= {"rest": over, "length": length, "distinct_length": F.length(F.array_join(tokens(norm), " "))}
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def shared_parts(a: Column, b: Column) -> Column:
    """(symbols, pairs): upper bounds of how many symbols and pairs two profiles share. Seal it: ``score_bound`` uses both many times."""

    def shared(kind: str, words: int, rest: str) -> Column:
        return reduce(lambda x, y: x + y, [F.bit_count(a[f"{kind}{i}"].bitwiseAND(b[f"{kind}{i}"])) for i in range(words)], F.least(a[rest], b[rest]))

    return F.struct(shared("bag", -(-len(_SYMBOLS) // _SYMBOLS_A_WORD), "rest").alias("symbols"), shared("pair", _PAIR_WORDS, "pair_rest").alias("pairs"))


def score_bound(a: Column, b: Column, shared: Column, edits: Column | None = None) -> Column:
    """An upper bound of the weighted score of two names by their profiles, without any edit distance; ``shared`` is from ``shared_parts``.

    An edit takes away at most one shared symbol and two shared pairs. So names of ``n`` symbols and ``n - 1`` pairs, of which ``s`` and ``p`` are shared, are at least
    ``n - s`` and ``(n - 1 - p) / 2`` edits apart. That bounds the ratio of the whole names, of their token lists, and of the shorter name's best window. Common tokens have fewer
    symbols than shared pairs. ``edits``, the edit distance of the names, makes it closer: it is the whole names' ratio, and the symbols
    beside a window, together with the window's own edits, are no fewer.
    """
    symbols, pairs = shared["symbols"], shared["pairs"]

    def most(n: Column) -> Column:
        edits = F.greatest(n - symbols, (n - 1 - pairs) / F.lit(2.0), F.lit(0))
        return F.greatest(F.lit(1.0) - edits / F.greatest(n, F.lit(1)), F.lit(0.0))

    shorter = F.greatest(F.least(a["distinct_length"], b["distinct_length"]), F.lit(1))
    common = F.when(a["tokens"].bitwiseAND(b["tokens"]) == 0, 0.0).otherwise(F.least(F.lit(1.0), (pairs - 1) / shorter))
    short, long = F.least(a["length"], b["length"]), F.greatest(a["length"], b["length"])
    partial, whole = most(short), most(long)
    if edits is not None:
        whole = F.lit(1.0) - edits / F.greatest(long, F.lit(1))
        partial = F.least(partial, F.lit(1.0) - F.greatest(edits - (long - short), F.lit(0)) / F.greatest(short, F.lit(1)))
    return (
        WEIGHT_PARTIAL * partial
        + WEIGHT_TOKEN_SET * F.greatest(most(F.greatest(a["distinct_length"], b["distinct_length"])), common)
        + WEIGHT_LEVENSHTEIN * whole
    )


def weighted_score(metrics: Column) -> Column:
    return (
        F.lit(WEIGHT_PARTIAL) * metrics["partial_ratio"]
        + F.lit(WEIGHT_TOKEN_SET) * metrics["token_set_ratio"]
        + F.lit(WEIGHT_LEVENSHTEIN) * metrics["levenshtein_ratio"]
    )


def decide(score: Column) -> Column:
    """Decision on the unrounded score."""
    return F.when(score >= REJECT_AT, "reject").when(score >= WARNING_AT, "warning").otherwise("accept")


def severity(decision: Column) -> Column:
    return F.when(decision == "reject", 2).when(decision == "warning", 1).otherwise(0)


def decision_of_severity(level: Column) -> Column:
    return F.when(level == 2, "reject").when(level == 1, "warning").otherwise("accept")


def is_valid_ocr_text(text: Column) -> Column:
    """At least two characters and one ASCII letter or digit."""
    return (F.length(F.trim(text)) >= 2) & text.rlike("[a-zA-Z0-9]")


def ordered_unique(values: Column) -> Column:
    """Distinct values of a list, first occurrence kept, order kept."""
    return F.array_distinct(values)
