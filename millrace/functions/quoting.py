"""Double-quoted texts inside larger ones, without a pattern that steps through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escapes of a quoted text, but for the backslash and the quote.
ESCAPES = {"a": "\x07", "b": "\x08", "f": "\x0c", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b"}
# Stand-ins while a text is taken apart; quoted texts show such characters as escapes only.
BACKSLASH, QUOTE, LINE_END = "\x01", "\x02", "\x03"
QUOTED = r'"([^"]*+)"'


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    A lambda that closes over an expression computes it for each element, and an expression
    named twice may be computed twice; the element of a one-element array is neither.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quote(text: Column) -> Column:
    """Double-quoted literal, with backslash, quote and control characters escaped."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for letter, character in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(character), F.lit("\\" + letter))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def hide_escapes(text: Column) -> Column:
    """Escaped backslashes and quotes, and line ends inside quotes, as stand-ins: a quote left is a real one."""
    hidden = F.when(text.contains("\\"), F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))).otherwise(text)
    parts = F.transform(F.split(hidden, '"'), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\n"), F.lit(LINE_END))).otherwise(p))
    return F.when(text.contains("\n"), F.array_join(parts, '"')).otherwise(hidden)


def unquote(body: Column) -> Column:
    """The text that a hidden body between quotes stands for."""
    plain = F.replace(body, F.lit(LINE_END), F.lit("\n"))
    for letter, character in ESCAPES.items():
        plain = F.replace(plain, F.lit("\\" + letter), F.lit(character))
    plain = F.regexp_replace(plain, r"\\(.)", "$1")
    plain = F.replace(F.replace(plain, F.lit(QUOTE), F.lit('"')), F.lit(BACKSLASH), F.lit("\\"))
    # Most texts hide nothing.
    return F.when(body.rlike(rf"[\\{BACKSLASH}{QUOTE}{LINE_END}]"), plain).otherwise(body)


def outside(hidden: Column, change) -> Column:
    """The hidden text with ``change`` made to what stands outside quotes."""
    return F.array_join(F.transform(F.split(hidden, '"'), lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(p)), '"')


def quoted_pairs(hidden: Column) -> tuple[Column, Column]:
    """Keys and values of ``"k" = "v"`` pairs."""
    pair = rf"{QUOTED}\s*=\s*{QUOTED}"
    return tuple(F.transform(F.regexp_extract_all(hidden, F.lit(pair), k), unquote) for k in (1, 2))


def last_of_each(keys: Column, values: Column) -> Column:
    """The pairs as a map; of a repeated key the last value counts.

    If keys are repeated, the pairs are sorted by key, the last of a key first, and each is
    looked at next to the one before, so a map costs no more than the sort.
    """

    def sorted_map(entries):
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(entries, lambda e: e["key"]))
        last = F.zip_with(entries, before, lambda e, k: F.when(e.isNotNull() & ~e["key"].eqNullSafe(k), F.struct(e["key"], e["value"])))
        return F.map_from_entries(F.filter(last, lambda e: e.isNotNull()))

    def map_of(pair):
        pairs = F.zip_with(pair["keys"], pair["values"], lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        numbered = F.transform(pairs, lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("back"), e["value"].alias("value")))
        once = F.size(F.array_distinct(pair["keys"])) == F.size(pair["keys"])
        return F.when(once, F.map_from_arrays(pair["keys"], pair["values"])).otherwise(let(F.array_sort(numbered), sorted_map))

    return let(F.struct(keys.alias("keys"), values.alias("values")), map_of)
