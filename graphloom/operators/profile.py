"""Profiles and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_profile(df: DataFrame) -> DataFrame:
    """(field, rows, present, empty): one pass with one count for each column, then unpivoted."""
    filled = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in df.columns]
    wide = df.agg(F.count("*").alias("_rows"), *filled)
    return wide.unpivot("_rows", df.columns, "field", "present").select("field", F.col("_rows").alias("rows"), "present", (F.col("_rows") - F.col("present")).alias("empty"))


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Rows of each key by the given values, 0 where there are none, in the order given."""
    return df.groupBy(key).pivot(column, values).count().fillna(0)


def json_type(c: str | Column) -> Column:
    """Type of a JSON text: null, array[0], array[object:n], array[T:n], object or the scalar's type."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    n = F.json_array_length(c)
    inner = F.regexp_extract(kind, r"^ARRAY<(\w+)", 1)
    name = F.lower(F.when(F.startswith(inner, F.lit("OBJECT")), F.lit("object")).otherwise(inner))
    array = F.when(n == 0, "array[0]").otherwise(F.concat(F.lit("array["), name, F.lit(":"), n.cast("string"), F.lit("]")))
    return F.when(v.isNull() | (kind == "VOID"), "null").when(F.startswith(kind, F.lit("ARRAY")), array).when(F.startswith(kind, F.lit("OBJECT")), "object").otherwise(F.lower(kind))


def type_histogram(df: DataFrame) -> DataFrame:
    """(field, type, n): how many values of each column have which type; a null is ``null``, a variant has its value's type."""

    def kind(name: str, of: str) -> Column:
        own = json_type(F.to_json(name)) if of == "variant" else F.lit(of)
        return F.when(F.col(name).isNull(), "null").otherwise(own)

    each = F.array(*(F.struct(F.lit(c).alias("field"), kind(c, of).alias("type")) for c, of in df.dtypes))
    return df.select(F.inline(each)).groupBy("field", "type").agg(F.count("*").alias("n"))
