"""Writers for exchange files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; null is blank, CRLF ends lines."""
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    out.write.options(header=True, sep="\t", escape='"', emptyValue="", nullValue="", lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, nulls kept."""
    df.select(sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def by_tier(df: DataFrame, path: str, tier: str = "tier") -> None:
    """One folder for each tier, in one pass."""
    df.write.partitionBy(tier).parquet(path)


def metadata(df: DataFrame) -> str:
    """A one-row table of aggregates as pretty JSON with sorted keys."""
    row = df.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, sort_keys=True, ensure_ascii=False)


def json_pages(pages: DataFrame, path: str, folder: str) -> None:
    """Pages, one to a line, in a folder for each value of ``folder``."""
    pages.write.partitionBy(folder).json(path)


def exists(spark: SparkSession, *paths: str) -> dict[str, bool]:
    """Which outputs are there, in whatever file system their paths name."""
    found = {}
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found[path] = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return found
