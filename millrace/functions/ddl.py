"""Table DDL text ↔ columns, as built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quoting import QUOTED, hide_escapes, last_of_each, let, outside, quote, quoted_pairs, unquote

# The integer types a server prints with a display width.
WIDTH_TYPES = "TINYINT|SMALLINT|INT|BIGINT|LARGEINT"
# The aggregate kinds a value column's type may end with.
AGGREGATES = "SUM|MIN|MAX|REPLACE"

# name, type, nullability, default, comment
COLUMN_LINE = (
    r"(?i)^\s*`([^`]+)`\s+(?!(?:NOT\s+)?NULL\b)(\S[^\"]*?)(?:\s+(NOT\s+NULL|NULL))?"
    rf"(?:\s+DEFAULT\s+{QUOTED})?(?:\s+COMMENT\s+{QUOTED})?\s*,?\s*$"
)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalise_type(raw: Column) -> Column:
    """Upper case, without the display width of integer types.

    The width also goes when an aggregate kind follows, as in ``bigint(20) SUM``.
    """
    tidy = F.upper(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.regexp_replace(tidy, rf"^({WIDTH_TYPES})\(\d+\)(\s|$)", "$1$2")


def value_type(canonical: Column) -> Column:
    return F.regexp_replace(canonical, rf"\s+({AGGREGATES})$", "")


def aggregate_kind(canonical: Column) -> Column:
    return _some(F.regexp_extract(canonical, rf"\s({AGGREGATES})$", 1))


def column_ddl(name: Column, type_: Column, nullable: Column, dflt: Column, comment: Column) -> Column:
    """``name`` TYPE [NOT] NULL [DEFAULT "…"] [COMMENT "…"]; empty text means unset."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("`"), name, F.lit("`")),
        type_,
        F.when(nullable, "NULL").otherwise("NOT NULL"),
        F.when(dflt != "", F.concat(F.lit("DEFAULT "), quote(dflt))),
        F.when(comment != "", F.concat(F.lit("COMMENT "), quote(comment))),
    )


def _split_block(hidden: Column) -> Column:
    """What stands between the first parenthesis outside quotes and the one that closes it (``inside``), and what follows (``tail``)."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s, piece):
        depth = s["depth"] + F.when(F.endswith(piece, F.lit("(")), 1).when(F.endswith(piece, F.lit(")")), -1).otherwise(0)
        at = s["at"] + F.length(piece)
        first = F.when((s["first"] == 0) & (depth == 1), at).otherwise(s["first"])
        last = F.when((s["last"] == 0) & (first > 0) & (depth == 0), at).otherwise(s["last"])
        return F.struct(depth.alias("depth"), at.alias("at"), first.alias("first"), last.alias("last"))

    def ends(text):
        # Quoted texts become as many blanks, so that places agree.
        blank = F.array_join(F.transform(F.split(text, '"'), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)), '"')
        return F.aggregate(F.split(blank, r"(?<=[()])"), start, step)

    def parts(x):
        text, first, last = x["text"], x["ends"]["first"], x["ends"]["last"]
        inside = F.call_function("substring", text, first + 1, F.greatest(last - first - 1, F.lit(0)))
        tail = F.when(last > 0, F.call_function("substring", text, last + 1, F.length(text))).otherwise("")
        return F.struct(inside.alias("inside"), tail.alias("tail"))

    return let(let(hidden, lambda text: F.struct(text.alias("text"), ends(text).alias("ends"))), parts)


def parse_columns(corpus: DataFrame, key: str, ddl: str) -> DataFrame:
    """One row per column of each DDL text, numbered in order; one column a line or several."""
    taken = corpus.select(key, _split_block(hide_escapes(F.col(ddl)))["inside"].alias("block"))
    one_each = outside(F.col("block"), lambda p: F.regexp_replace(p, r",\s*+`", ",\n`"))
    lines = F.filter(F.split(one_each, "\n"), lambda line: line.rlike(COLUMN_LINE))

    def part(group):
        return F.regexp_extract("line", COLUMN_LINE, group)

    return taken.select(key, F.posexplode(lines).alias("pos", "line")).select(
        key,
        (F.col("pos") + 1).alias("ord"),
        part(1).alias("name"),
        normalise_type(part(2)).alias("type"),
        F.upper(part(3)).rlike(r"^(NULL)?$").alias("nullable"),
        _some(unquote(part(4))).alias("dflt"),
        _some(unquote(part(5))).alias("comment"),
    )


def parse_tables(corpus: DataFrame, key: str, ddl: str) -> DataFrame:
    """Table-level clauses, on lines of their own or not; properties as a map (the last of a key), key columns as an array."""
    # All clauses follow the column block.
    taken = corpus.select(key, F.col(ddl).alias("ddl"), _split_block(hide_escapes(F.col(ddl)))["tail"].alias("tail"))
    props = F.regexp_extract("tail", r"(?is)\bPROPERTIES\s*\((.*)\)", 1)
    # The key models a table clause may name.
    key_clause = r"(?i)\b(DUPLICATE KEY|AGGREGATE KEY|UNIQUE KEY|PRIMARY KEY)\s*\(([^)]*+)\)"
    key_list = F.regexp_extract("tail", key_clause, 2)

    # Without the texts that may hold the words of a clause.
    bare = F.regexp_replace(F.regexp_replace("tail", rf"(?i)\bCOMMENT\s+{QUOTED}", "COMMENT"), r"(?is)\bPROPERTIES\s*\(.*", "PROPERTIES")

    def clause(words):
        # Up to the end of the line or the next clause.
        return _some(F.trim(F.regexp_extract(bare, rf"(?i)\b({words}[^\n]+?)(?=\s+(?:DISTRIBUTED BY|ORDER BY|PROPERTIES|COMMENT)\b|\s*+;?\s*+(?:\n|$))", 1)))

    return taken.select(
        key,
        F.regexp_extract("ddl", r"(?i)CREATE TABLE `([^`]+)`", 1).alias("name"),
        _some(F.regexp_extract("tail", r"(?i)\bENGINE\s*=\s*(\w+)", 1)).alias("engine"),
        _some(F.upper(F.regexp_extract("tail", key_clause, 1))).alias("key_type"),
        F.when(
            key_list != "",
            F.transform(F.split(key_list, ","), lambda k: F.regexp_replace(k, r"^\s*`?|`?\s*$", "")),
        ).alias("key_columns"),
        clause("PARTITION BY").alias("partition_by"),
        clause("DISTRIBUTED BY").alias("distributed_by"),
        _some(unquote(F.regexp_extract("tail", rf"(?i)\bCOMMENT\s+{QUOTED}", 1))).alias("comment"),
        last_of_each(*quoted_pairs(props)).alias("properties"),
    )


def render_properties(props: Column) -> Column:
    """``"k" = "v"`` pairs in the order of the rendered pair."""
    pairs = F.transform(F.map_entries(props), lambda e: F.concat(quote(e["key"]), F.lit(" = "), quote(e["value"])))
    return F.array_join(F.array_sort(pairs), ", ")


def render_create_table(columns: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """One CREATE TABLE text per spec row.

    ``specs`` has db, name, engine, key_type, key_columns, comment, partition_by,
    distributed_by and properties; unset clauses are null. The columns of one table
    end up in one text, so that group is as large as the row it makes.
    """
    fragment = column_ddl(*(F.col(c) for c in ("name", "type", "nullable", "dflt", "comment")))
    bodies = columns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", fragment.alias("ddl")))).alias("cols"))
    backticked = F.transform("key_columns", lambda k: F.concat(F.lit("`"), k, F.lit("`")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("CREATE TABLE IF NOT EXISTS `"), F.col("db"), F.lit("`.`"), F.col("name"), F.lit("` (")),
        F.concat(F.lit("  "), F.array_join(F.col("cols.ddl"), ",\n  ")),  # left out if there are none
        F.lit(")"),
        F.when(F.col("engine") != "", F.concat(F.lit("ENGINE = "), F.col("engine"))),
        F.when(
            (F.col("key_type") != "") & (F.size("key_columns") > 0),
            F.concat(F.col("key_type"), F.lit(" ("), F.array_join(backticked, ", "), F.lit(")")),
        ),
        F.when(F.col("comment") != "", F.concat(F.lit("COMMENT "), quote(F.col("comment")))),
        F.nullif(F.col("partition_by"), F.lit("")),
        F.nullif(F.col("distributed_by"), F.lit("")),
        F.when(
            F.size("properties") > 0,
            F.concat(F.lit("PROPERTIES ("), render_properties(F.col("properties")), F.lit(")")),
        ),
    )
    return specs.join(bodies, key, "left").select(key, text.alias("ddl"))
