"""Secret scan: a keyword automaton finds places, anchored patterns run only there, checksums settle token kinds."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from placewise.llm.rows import add_columns

# Keywords and patterns of the kinds.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS_WORD = "akia"
ISSUER_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
KINDS = ["assign", "access", "hex", "issuer"]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ISSUER = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 6, "access": 20, "hex": 24}
_STRIDE = 6  # any 24 hex digits hold four samples in a row
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", [ACCESS_WORD]), ("issuer", ISSUER_WORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum62(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits, the form in which issuers embed it."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits


def _hex_spans(text: str) -> list[tuple[str, int, int]]:
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[_STRIDE - 1 :: _STRIDE]
    if len(points) < 4:
        return []
    digit = ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 102))
    spans, done = [], 0
    for sample in np.flatnonzero(digit[:-3] & digit[1:-2] & digit[2:-1] & digit[3:]):
        start = int(sample) * _STRIDE + _STRIDE - 1
        if start < done:
            continue
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        done = HEX.match(text, start).end()
        if done - start >= LEAST["hex"]:
            spans.append(("hex", start, done))
    return spans


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    spans, done = _hex_spans(text), {"assign": 0, "access": 0, "issuer": 0}
    for last, (kind, width) in _automaton().iter(low):
        start = last - width + 1
        if start < done[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, start)):
            keep = len(m[2]) >= LEAST[kind]
        elif kind == "access" and (m := ACCESS.match(text, start)):
            keep = m.end() - start >= LEAST[kind]
        elif kind == "issuer" and (m := ISSUER.match(text, start)):
            keep = checksum62(m[1]) == m[2]
        else:
            continue
        done[kind] = m.end()
        if keep:
            spans.append((kind, start, m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones joined, replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, text: str = "text", spans: str = "secret_spans", keep_text: bool = True) -> DataFrame:
    """``docs`` with an array column of spans (kind, start, end; code points, end exclusive).

    Kinds: an assignment to a secret-like name, a cloud access key, a long hex string, and an issuer's token whose embedded checksum is right.
    Null or empty text: an empty array. Whole texts are scanned; equal rows get equal results.
    """
    field = [(spans, T.ArrayType(SPAN))]
    as_dicts = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
    return add_columns(docs, text, field, lambda texts: [[as_dicts(find_spans(t)) for t in texts]], keep_text=keep_text)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text column; a null text stays null."""
    hide = lambda column: [[t if t is None else redact(t, find_spans(t)) for t in column.to_pylist()]]
    return add_columns(docs, text, [(text, T.StringType())], hide, arrow=True).select(*docs.columns)
