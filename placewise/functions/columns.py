"""Helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sealed(value: Column) -> Column:
    """The value computed once per row, to be used as a column of its own in a select.

    A later filter or repeated use would otherwise copy the whole expression: filters are pushed below the
    projections that make a column, and fields of a struct are taken apart again. A generated column stops
    both and stays in generated code.
    """
    return F.explode(F.array(value))
