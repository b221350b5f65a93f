"""Column expressions: identifiers, lists in strings, casts and blanks. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def namespaced(prefix: str, c: str | Column) -> Column:
    """``prefix`` before the id, or a blank where the id is null or blank."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(prefix), text)).otherwise(F.lit(""))


def without_prefixes(c: str | Column, *prefixes: str) -> Column:
    """Trimmed, upper-cased, then each prefix taken off in turn."""
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda x, p: F.when(F.startswith(x, F.lit(p)), F.substring(x, len(p) + 1, 1 << 30)).otherwise(x), prefixes, F.upper(F.trim(c)))


def without_suffix(c: str | Column, suffix: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def slug(c: str | Column) -> Column:
    """Lower case with underscores for spaces; other characters stay."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def split_list(c: str | Column, separators: str = ";") -> Column:
    """Trimmed parts that are not blank; any of the separators divides."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(F.translate(c, separators[1:], separators[0] * len(separators[1:])), separators[0]), lambda x: F.trim(x)), lambda x: x != "")


def joined_list(c: str | Column, separator: str = ";") -> Column:
    """Elements joined; null is blank."""
    return F.coalesce(F.array_join(c, separator), F.lit(""))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def default_blank(c: str | Column, other: Column) -> Column:
    """``other`` where the value is null or blank."""
    return F.coalesce(blank_to_null(c), other)


def safe_number(c: str | Column, kind: str = "double") -> Column:
    """Null where the text is blank or no number."""
    return (F.col(c) if isinstance(c, str) else c).try_cast(kind)


def strict_number(c: str | Column, kind: str = "double") -> Column:
    """Null where the text is blank; an error where it is no number."""
    return blank_to_null(c).cast(kind)


def first_present(*named: tuple[str, str | Column]) -> Column:
    """Struct (name, value) of the first column that is neither null nor blank."""
    picks = [F.when(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) != "", F.struct(F.lit(n).alias("name"), (F.col(c) if isinstance(c, str) else c).alias("value"))) for n, c in named]
    return F.coalesce(*picks)


def missing_fields(*columns: str) -> Column:
    """Names of the columns that are null or blank, comma-joined, in order."""
    return F.concat_ws(",", *(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in columns))


def sorted_value(c: Column, kind: T.DataType) -> Column:
    """A nested value whose struct fields and map keys are in order of name, at every level."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(sorted_value(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), sorted_value(e["value"], kind.valueType).alias("value"))))
    return c


def json_text(df: DataFrame, name: str) -> Column:
    """JSON of a nested column with sorted keys and its null fields; a null or empty one is blank."""
    kind, c = df.schema[name].dataType, F.col(name)
    text = F.to_json(sorted_value(c, kind), {"ignoreNullFields": "false"})
    empty = F.size(c) == 0 if isinstance(kind, T.ArrayType | T.MapType) else F.lit(False)
    return F.when(c.isNull() | empty, "").otherwise(text)


def list_text(df: DataFrame, name: str, separator: str = ";") -> Column:
    """Elements of a list joined, or a single value as text; null and empty are blank."""
    c = F.col(name)
    is_list = isinstance(df.schema[name].dataType, T.ArrayType)
    return F.coalesce(F.array_join(c.cast("array<string>"), separator) if is_list else c.cast("string"), F.lit(""))


def clean_text(c: str | Column) -> Column:
    """Runs of white space as one space, trimmed; null is blank."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))
