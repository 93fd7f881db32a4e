"""Text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything that counts as white space in Unicode.
WHITESPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.trim(text, F.lit(WHITESPACE))


def to_number(text: Column) -> Column:
    """Plain decimal text as a double; NULL for anything else."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))
