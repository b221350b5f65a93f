"""What several operators share: written intermediate tables and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back; it stays there."""
    return Tables(df.sparkSession).put(name, df)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row by id and text; identical repeats of a row share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
