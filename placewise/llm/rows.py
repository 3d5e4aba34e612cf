"""Columns computed row by row from a text column, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


def add_columns(
    df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], compute: Callable, arrow: bool = False, keep_text: bool = True,
) -> DataFrame:
    """``df`` with the columns that ``compute`` makes of the texts.

    ``compute`` gets a list of texts (null: empty), or the Arrow array if ``arrow``, and gives one list per field. A column
    of ``df`` that has a new column's name, in any letter case, is replaced. The row count, row order and all other columns
    stay; without ``keep_text`` the text itself does not come back.
    """
    new = {name.lower() for name, _ in fields}
    stay = [c for c in df.columns if c.lower() not in new and (keep_text or c != text)]
    source = df.select(*[df[c] for c in stay], *([] if text in stay else [df[text].alias("_pw_text")]))
    at, width = (stay.index(text) if text in stay else len(stay)), len(stay)
    schema = T.StructType([*source.schema.fields[:width], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in fields]
        names = [f.name for f in schema.fields]
        for batch in batches:
            for part in pieces(batch, at):
                values = part.column(at)
                made = compute(values if arrow else [t if t is not None else "" for t in values.to_pylist()])
                columns = [part.column(i) for i in range(width)]
                columns += [pa.array(values, kind) for values, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, at: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text in column ``at``."""
    import pyarrow.compute as pc

    column = batch.column(at)
    if pa.types.is_struct(column.type):  # a whole row: its longest kind of field is its text
        column = max((c for c in column.flatten() if pa.types.is_string(c.type)), key=lambda c: c.nbytes)
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = pc.fill_null(sizes, 0).to_pylist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if batch.num_rows > begin:
        yield batch.slice(begin)
