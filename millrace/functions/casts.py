"""Casts that give null where a value does not fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[\x00-\x20]*"
WHOLE = rf"^{BLANK}[+-]?\d+{BLANK}$"
# What a text must hold at least to cast to a type.
NEEDED = {
    "tinyint": WHOLE, "smallint": WHOLE, "int": WHOLE, "bigint": WHOLE,
    "double": r"(?i)\d|inf|nan", "float": r"(?i)\d|inf|nan", "decimal": r"\d",
    "date": r"\d", "timestamp_ntz": r"\d", "timestamp": r"\d",
}


def cast_or_null(column: Column, source: T.DataType, target: str) -> Column:
    """`try_cast`, tried only on texts that may fit.

    A failed `try_cast` raises and catches an exception inside the task, which costs
    far more than a pattern when many values fail.
    """
    attempt = column.try_cast(target)
    pattern = NEEDED.get(target.split("(")[0])
    if isinstance(source, (T.StringType, T.VarcharType, T.CharType)) and pattern:
        return F.when(column.rlike(pattern), attempt)
    return attempt
