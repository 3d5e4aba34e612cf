"""Chat formatting by tokens: segments are encoded apart, reserved ids are spliced in, masks come from prefix sums.

A turn is written as ``### role: text</turn>`` and a line break. The three control strings are single reserved ids, so ordinary text can never
produce them; in the written form a backslash is put inside each control string that a role or text holds, and before each backslash.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template.
OPEN, NAMED, CLOSE = "### ", ": ", "</turn>\n"
CONTROLS = [OPEN, NAMED, CLOSE]
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = {"\\": "\\\\", "###": "#\\##", "</turn>": "<\\/turn>", ":": "\\:"}


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    found.no_truncation()
    found.no_padding()
    return found


def reserved_ids(path: str) -> list[int]:
    """The ids of the control strings: the first ones after the vocabulary."""
    size = _tokenizer(path).get_vocab_size(with_added_tokens=True)
    return [size + i for i in range(len(CONTROLS))]


def decode_segments(path: str, ids: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, read from its ids alone."""
    opens, named, closes = reserved_ids(path)
    marks = np.flatnonzero(ids >= opens)
    bounds = np.concatenate([marks, [len(ids)]])
    parts = _tokenizer(path).decode_batch([ids[a + 1 : b].tolist() for a, b in zip(bounds, bounds[1:])], skip_special_tokens=False)
    kinds = ids[marks].tolist()
    if kinds != [opens, named, closes] * (len(kinds) // 3):
        raise ValueError("the ids are not a formatted conversation")
    return [(unescape(parts[i]), unescape(parts[i + 1])) for i in range(0, len(parts), 3)]


def format_chat(turns: DataFrame, vocabulary: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (text), ids, loss_mask (a flag per id).

    ``turns`` has conv_id, turn, role, text. Texts are encoded row by row before anything is grouped, so only the finished
    segments of a conversation meet. Turns are ordered by turn, null first; ties by role and text; repeated rows are repeated
    turns. A null role or text is empty. The mask covers the texts of ``loss_roles``, without their marks. A null conv_id is
    one conversation. Other columns are left out. Vocabulary: a byte-level tokenizer file that every worker has.
    """
    segment = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("turn", turns.schema["turn"].dataType),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType()),
        T.StructField("role_ids", T.ArrayType(T.IntegerType())), T.StructField("text_ids", T.ArrayType(T.IntegerType())),
    ])

    def encode(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from placewise.llm.rows import pieces

        schema = to_arrow_schema(segment)
        for whole in batches:
            for batch in pieces(whole, 3):
                roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
                own_roles = [escape(x, role=True) for x in roles]
                own_texts = [escape(x) for x in texts]
                coded = _tokenizer(vocabulary).encode_batch(own_roles + own_texts, add_special_tokens=False)
                ids = [x.ids for x in coded]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(own_roles, pa.string()), pa.array(own_texts, pa.string()),
                    pa.array([r in loss_roles for r in roles]), pa.array(ids[: len(roles)], schema.field(5).type), pa.array(ids[len(roles) :], schema.field(6).type),
                ], schema=schema)

    segments = turns.select("conv_id", "turn", "role", "text").mapInArrow(encode, segment)
    each = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "loss", "role_ids", "text_ids")))
    grouped = segments.groupBy("conv_id").agg(each.alias("segments"))
    lines = F.transform("segments", lambda s: F.concat(F.lit(OPEN), s["role"], F.lit(NAMED), s["text"], F.lit(CLOSE)))
    packed = grouped.select(
        "conv_id", F.size("segments").cast("long").alias("n_turns"), F.array_join(lines, "").alias("formatted"),
        F.transform("segments", lambda s: s["loss"]).alias("loss"),
        F.transform("segments", lambda s: F.size(s["role_ids"])).alias("role_sizes"),
        F.transform("segments", lambda s: F.size(s["text_ids"])).alias("text_sizes"),
        F.flatten(F.transform("segments", lambda s: F.concat(s["role_ids"], s["text_ids"]))).alias("plain_ids"),
    )
    out = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
    ])

    def splice(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from placewise.llm.bpe import id_lists

        controls, schema = np.array(reserved_ids(vocabulary)), to_arrow_schema(out)
        for batch in batches:
            ids, masks = [], []
            for loss, roles, texts, plain in zip(*(id_lists(batch.column(i)) for i in (3, 4, 5, 6))):
                # Places by prefix sums: each turn is open, role, named, text, close.
                sizes = np.column_stack([np.ones_like(roles), roles, np.ones_like(roles), texts, np.ones_like(roles)]).ravel()
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                total, n = int(at[-1]), len(roles)
                own = np.empty(total, np.int32)
                reserved = np.zeros(total, bool)
                for k, place in enumerate((0, 2, 4)):
                    own[at[place : 5 * n : 5]] = controls[k]
                    reserved[at[place : 5 * n : 5]] = True
                own[~reserved] = plain
                steps = np.zeros(total + 1, np.int32)
                flags = loss.astype(np.int32)
                np.add.at(steps, at[3 : 5 * n : 5], flags)
                np.add.at(steps, at[4 : 5 * n : 5], -flags)
                ids.append(own)
                masks.append(np.cumsum(steps[:-1]) > 0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(ids, schema.field(3).type), pa.array(masks, schema.field(4).type)
            ], schema=schema)

    return packed.mapInArrow(splice, out)


def read_chat(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, turns (role, text) and loss_text (what the mask covers, unescaped), all read from ids and loss_mask; formatted passes through."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    out = T.StructType([
        T.StructField("conv_id", formatted.schema["conv_id"].dataType), T.StructField("formatted", T.StringType()),
        T.StructField("turns", T.ArrayType(turn)), T.StructField("loss_text", T.StringType()),
    ])

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from placewise.llm.bpe import id_lists

        schema = to_arrow_schema(out)
        for batch in batches:
            turns, losses = [], []
            for ids, mask in zip(id_lists(batch.column(2)), id_lists(batch.column(3))):
                turns.append([{"role": r, "text": t} for r, t in decode_segments(vocabulary, ids)])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                covered = _tokenizer(vocabulary).decode_batch([ids[a:b].tolist() for a, b in edges.reshape(-1, 2)], skip_special_tokens=False)
                losses.append("".join(map(unescape, covered)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, schema.field(2).type), pa.array(losses, pa.string())], schema=schema)

    return formatted.select("conv_id", "formatted", "ids", "loss_mask").mapInArrow(read, out)
