"""Rows that fail to parse: strict load, anti-join on record offsets, diagnosis of the rest.

Format of a line: four fields with one tab between them (nodeA, nodeB, weight, types). A field is bare or wholly in
double quotes, with quotes inside doubled. A single carriage return at the very end is not part of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ID = r'(?:[0-9]+|"[0-9]+")'
_NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: The whole of a conforming line.
EDGE_LINE = rf'\A{_ID}\t{_ID}\t(?:(?:{_NUMBER})?|"(?:{_NUMBER})?")\t{_ID}\r?\z'
#: A line that splits into four well quoted fields, whatever their values.
#: Possessive, so that very long lines don't need a deep stack; nothing could match in another way.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"\t]*+)'
FOUR_FIELDS = rf"(?s)\A{_FIELD}\t{_FIELD}\t{_FIELD}\t{_FIELD}\z"
WELL_QUOTED = rf"(?s)\A{_FIELD}(?:\t{_FIELD})*+\z"
#: A record as the anti-join sees it: its offset, and a fingerprint that tells apart lines under one offset.
_KEY = ("_offset", "_print")


def strict_edges(lines: DataFrame, offset: str = "line_id", line: str = "line") -> DataFrame:
    """The conforming lines as typed edges ``(offset, node_a, node_b, weight, types)``; nothing else gets through.

    An empty weight is null. Nodes must fit a bigint, types an int, and the weight a finite double.
    Self-loops, repeated lines and repeated or null offsets are kept as they are; null lines never conform.
    """
    text = F.col(line)
    # In a conforming line, quotes only enclose values and a carriage return only ends it: without them, tabs separate.
    split = lines.where(text.rlike(EDGE_LINE)).select(
        F.col(offset).alias("_offset"), F.xxhash64(text).alias("_print"), F.split(F.translate(text, '"\r', ""), "\t", -1).alias("_f")
    )
    typed = split.select(
        "_offset",
        "_print",
        F.col("_f")[0].try_cast("bigint").alias("node_a"),
        F.col("_f")[1].try_cast("bigint").alias("node_b"),
        F.nullif(F.col("_f")[2], F.lit("")).alias("_weight"),
        F.col("_f")[3].try_cast("int").alias("types"),
    )
    weight = F.col("_weight").try_cast("double")
    fits = F.col("_weight").isNull() | (weight < F.lit(float("inf")))
    return typed.where(F.col("node_a").isNotNull() & F.col("node_b").isNotNull() & F.col("types").isNotNull() & fits).select(
        "_offset", "_print", "node_a", "node_b", weight.alias("weight"), "types"
    )


def edges(lines: DataFrame, offset: str = "line_id", line: str = "line") -> DataFrame:
    """The typed edges with their record offset."""
    return strict_edges(lines, offset, line).select(F.col("_offset").alias(offset), "node_a", "node_b", "weight", "types")


def _plain(field: Column) -> Column:
    """A field's value without its quotes."""
    return F.when(
        field.startswith('"') & field.endswith('"') & (F.length(field) >= 2),
        F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(field)


def _reason(line: Column) -> Column:
    body = F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
    fields = F.regexp_extract_all(F.concat(F.lit("\t"), body), F.lit(rf"(?s)\t({_FIELD})"), F.lit(1))
    at = [_plain(F.get(fields, F.lit(k))) for k in range(4)]
    digits = r"\A[0-9]+\z"
    return (
        F.when(line.isNull(), "line is null")
        .when(F.length(body) == 0, "line is empty")
        .when(~body.rlike(WELL_QUOTED), "broken quoting")
        .when(~body.rlike(FOUR_FIELDS), F.concat(F.lit("column count "), F.size(fields).cast("string"), F.lit(", not 4")))
        .when(~at[0].rlike(digits), "nodeA is not digits")
        .when(at[0].try_cast("bigint").isNull(), "nodeA out of range")
        .when(~at[1].rlike(digits), "nodeB is not digits")
        .when(at[1].try_cast("bigint").isNull(), "nodeB out of range")
        .when((at[2] != "") & ~at[2].rlike(rf"\A{_NUMBER}\z"), "weight is not a number")
        .when((at[2] != "") & ~(at[2].try_cast("double") < F.lit(float("inf"))), "weight is not finite")
        .when(~at[3].rlike(digits), "types is not digits")
        .when(at[3].try_cast("int").isNull(), "types out of range")
        .otherwise("not of the format")
    )


def rejects(lines: DataFrame, offset: str = "line_id", line: str = "line") -> DataFrame:
    """Every record that the strict load didn't take, as ``(offset, line, reason)``.

    The offsets of the loaded records are subtracted from the raw offsets (null-safe, so a record without an offset is
    handled like any other), and only what remains is diagnosed. A record is known by its offset together with a hash
    of its line; so where an offset occurs twice, a good line doesn't hide a bad one. Other columns are ignored.
    """
    loaded = strict_edges(lines, offset, line).select(*_KEY)
    raw = lines.select(F.col(offset).alias("_offset"), F.xxhash64(F.col(line)).alias("_print"), F.col(line).alias("_line"))
    same = raw["_print"].eqNullSafe(loaded["_print"]) & raw["_offset"].eqNullSafe(loaded["_offset"])
    return raw.join(loaded, same, "left_anti").select(
        F.col("_offset").alias(offset), F.col("_line").alias(line), _reason(F.col("_line")).alias("reason")
    )
