"""Output with its checks and metadata from one job.

What is measured, and what must hold, is observed on the rows as they are
written; nothing is read or computed again for it. Output whose checks fail is
removed, and a run that is complete has its metadata beside its rows.
"""

from __future__ import annotations

import datetime
import decimal
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import remove_folder

METADATA = "_checks.json"  # names with an underscore are not read as rows, but for `_metadata`, which is Parquet's own


@dataclass(frozen=True)
class Checks:
    """What is measured while rows are written, and what must hold.

    ``measures``: aggregates by name. ``layers``: for a column, the values that
    it may have; each value's rows are counted as ``column=value``, and the
    counts must add up to all rows, so that a row in no layer is found.
    ``sums``: of measures, name -> names that must add up to it. ``require``:
    conditions that every row must meet (null counts as not met); the first row
    that does not ends the job. ``unique``: columns whose values together must
    not repeat, nulls being values; the job ends at a repeat.
    """

    measures: dict[str, Column] = field(default_factory=dict)
    layers: dict[str, list[str]] = field(default_factory=dict)
    sums: dict[str, list[str]] = field(default_factory=dict)
    require: dict[str, Column] = field(default_factory=dict)
    unique: tuple[str, ...] = ()


def observed(df: DataFrame, checks: Checks, observation: Observation) -> DataFrame:
    """``df`` that fills ``observation`` and fails on rows that break a rule, when it is run."""
    names = df.columns
    rules = dict(checks.require)
    if checks.unique:
        again = F.row_number().over(W.partitionBy(*checks.unique).orderBy(*checks.unique))
        df = df.withColumn("_again", again)
        rules[f"{', '.join(checks.unique)} is unique"] = F.col("_again") == 1
    first, kind = F.col(names[0]), df.schema[names[0]].dataType
    for name, holds in rules.items():  # on a column that is written, so that it is evaluated whatever is pruned
        first = F.when(holds, first).otherwise(F.raise_error(F.lit(f"a row breaks the rule: {name}")).cast(kind))
    df = df.select(first.alias(names[0]), *names[1:])
    counts = {f"{c}={v}": F.count_if(F.col(c) == v) for c, values in checks.layers.items() for v in values}
    return df.observe(observation, F.count("*").alias("rows"), *(m.alias(n) for n, m in (counts | checks.measures).items()))


def broken(found: dict, checks: Checks) -> list[str]:
    """The sums that do not add up."""
    sums = {"rows": [[f"{c}={v}" for v in values] for c, values in checks.layers.items()]}
    for name, parts in checks.sums.items():
        sums.setdefault(name, []).append(parts)
    none = lambda v: 0 if v is None else v  # noqa: E731  the sum of no rows
    return [f"{name} is {found[name]}, {' + '.join(parts)} is {sum(none(found[p]) for p in parts)}" for name, each in sums.items() for parts in each if none(found[name]) != sum(none(found[p]) for p in parts)]


def write(df: DataFrame, path: str, checks: Checks, by: list[str] | None = None, more: dict | None = None) -> dict:
    """Writes ``df`` as Parquet in a new folder and returns what was measured, with ``more``, as its metadata file has it.

    One job reads the input, writes the rows and measures them. A broken rule or
    sum raises ValueError or the job's error, and nothing stays at ``path``. An
    empty table has counts of 0.
    """
    spark, observation = df.sparkSession, Observation()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(folder):
        raise ValueError(f"{path} is already there")
    try:
        out = observed(df, checks, observation).write
        (out.partitionBy(*by) if by else out).parquet(path)
        found = observation.get
        wrong = broken(found, checks)
        if wrong:
            raise ValueError("; ".join(wrong))
        text = json.dumps(found | (more or {}), indent=2, sort_keys=True, ensure_ascii=False, default=_text)
        file = store.create(spark._jvm.org.apache.hadoop.fs.Path(folder, METADATA))
        file.write(bytearray(text.encode()))
        file.close()
    except BaseException:
        remove_folder(spark, path)
        raise
    return json.loads(text)


def _text(value) -> str:
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def metadata(spark: SparkSession, path: str) -> dict:
    """What was measured when ``path`` was written; an error if the run did not end."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path, METADATA)
    store = file.getFileSystem(spark._jsc.hadoopConfiguration())
    with_lines = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(store.open(file), "UTF-8"))
    text = "\n".join(iter(with_lines.readLine, None))
    with_lines.close()
    return json.loads(text)
