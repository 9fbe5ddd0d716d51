"""Scalar rules over text columns: quotas, limits, ids, errors, digests, classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quoting import hide_escapes, last_of_each, quoted_pairs

# Unit letter → power of 1024.
UNIT_POWERS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5}

# Texts that mean "no such object". Each object has alternatives,
# and all texts of one alternative must occur in the lower-cased message.
NOT_FOUND = {
    "database_missing": [["unknown database"], ["database", "not exist"], ["is not found"]],
    "table_missing": [["unknown table"], ["is not found"], ["table", "doesn't exist"], ["does not exist"]],
    "index_missing": [["does not exist"], ["is not found"], ["index", "not found"]],
    "plugin_missing": [["unknown plugin"], ["plugin", "not found"], ["plugin", "does not exist"]],
    "group_missing": [["unknown resource group"], ["does not exist"], ["is not found"], ["not found"]],
}

# Property keys that hold credentials.
SECRET_KEY = r"(?i)(password|passwd|secret|token|access[-_.]?key|credential|private[-_.]?key)"


def quota_bytes(quota: Column) -> Column:
    """``10G`` → bytes; empty, zero or unreadable text → null (no quota)."""
    pattern = r"(?i)^\s*(\d+)\s*([KMGTP]?)B?\s*$"
    number = F.nullif(F.regexp_extract(quota, pattern, 1), F.lit("")).try_cast("bigint")
    unit = F.upper(F.regexp_extract(quota, pattern, 2))
    factor = F.lit(None).cast("bigint")
    for letter, power in UNIT_POWERS.items():
        factor = F.when(unit == letter, F.lit(1024**power).cast("bigint")).otherwise(factor)
    return F.nullif(F.try_multiply(number, factor), F.lit(0).cast("bigint"))


def positive_limit(text: Column) -> Column:
    """Numeric limit; zero, negative or unreadable text means unset."""
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.when(number > 0, number)


def percent_fraction(text: Column) -> Column:
    """``80.0%`` → 0.8"""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*%\s*$", 1)
    return F.nullif(number, F.lit("")).cast("double") / 100


def import_parts(text: Column, n: int) -> list[Column]:
    """The n parts of a dotted id and, last, whether it is valid.

    The final part keeps its dots; a missing or empty part makes the id invalid.
    """
    parts = F.split(text, r"\.", n)
    valid = (F.size(parts) == n) & ~F.exists(parts, lambda p: p == "")
    return [F.when(valid, F.get(parts, F.lit(i))) for i in range(n)] + [valid]


def not_found_flags(message: Column) -> dict[str, Column]:
    low = F.lower(message)

    def holds(words):
        found = low.contains(words[0])
        for word in words[1:]:
            found = found & low.contains(word)
        return found

    flags = {}
    for name, alternatives in NOT_FOUND.items():
        flag = holds(alternatives[0])
        for words in alternatives[1:]:
            flag = flag | holds(words)
        flags[name] = flag
    return flags


def normal_statement(stmt: Column) -> Column:
    """Literals become ``?``, white space collapses; digits inside names stay."""
    # A doubled quote inside a literal makes it two that touch: they fold into one.
    no_strings = F.regexp_replace(F.regexp_replace(stmt, r"'[^']*+'", "?"), r"\?{2,}+", "?")
    no_numbers = F.regexp_replace(no_strings, r"\b\d+(?:\.\d+)?\b", "?")
    return F.trim(F.regexp_replace(no_numbers, r"\s+", " "))


def digest(stmt: Column) -> Column:
    return F.md5(normal_statement(stmt))


def classifier_fields(text: Column) -> dict[str, Column]:
    """Every field of ``(id=1, user=x, …)``, each found by its own name."""

    def field(name):
        return F.nullif(F.regexp_extract(text, rf"(?:^|[(,\s]){name}=([^,)]+)", 1), F.lit(""))

    fields = {"classifier_id": field("id").try_cast("bigint")}
    for name in ("user", "role", "query_type", "source_ip", "db"):
        fields[name if name not in ("user", "role") else f"{name}_name"] = field(name)
    return fields


def normal_setting(value: Column) -> Column:
    """Setting text with both spellings of a boolean made one."""
    low = F.lower(value)
    return F.when(low == "true", "1").when(low == "false", "0").otherwise(value)


def set_statement(name: Column, value: Column) -> Column:
    doubled = F.replace(value, F.lit("'"), F.lit("''"))
    return F.concat(F.lit("SET GLOBAL "), name, F.lit(" = '"), doubled, F.lit("'"))


def strip_index_type(raw: Column) -> tuple[Column, Column]:
    """``NGRAMBF("GRAM_NUM" = "4")`` → (type, lower-cased property map)."""
    kind = F.upper(F.trim(F.split_part(raw, F.lit("("), F.lit(1))))
    keys, values = quoted_pairs(hide_escapes(raw))
    return kind, last_of_each(F.transform(keys, F.lower), values)


def redact(props: Column) -> Column:
    """Mask the values of credential keys in a property map."""
    return F.transform_values(props, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("******")).otherwise(v))


def merge_properties(recorded: Column, server: Column) -> Column:
    """What to keep of the server's properties.

    Nothing tracked: take all of the server's. Otherwise only tracked keys stay,
    with the server's value where it has one.
    """
    kept = F.transform_values(recorded, lambda k, v: F.coalesce(F.try_element_at(server, k), v))
    return F.when(F.coalesce(F.size(recorded), F.lit(0)) <= 0, server).otherwise(kept)


def prefer_recorded(recorded: Column, server: Column) -> Column:
    """Recorded text unless it is empty (free-form clauses come back re-quoted)."""
    return F.coalesce(F.nullif(recorded, F.lit("")), F.nullif(server, F.lit("")), F.lit(""))


def prefer_server(recorded: Column, server: Column, default: str) -> Column:
    return F.coalesce(F.nullif(server, F.lit("")), recorded, F.lit(default))


def partition_value(clause: str, df_columns) -> Column:
    """The DATE a ``date_trunc('unit', column)`` partition clause gives a row."""
    match = re.search(r"date_trunc\(\s*'(\w+)'\s*,\s*`?(\w+)`?\s*\)", clause, re.IGNORECASE)
    if not match:
        raise ValueError(f"not a date_trunc partition clause: {clause!r}")
    unit, column = match.groups()
    if column not in df_columns:
        raise ValueError(f"partition column {column!r} is not in the data")
    return F.date_trunc(unit, F.col(column)).cast("date")
