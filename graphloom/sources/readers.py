"""Readers of landed files. Blank cells are blank text, not null."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_pages(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of paged JSON envelopes with ``file`` and ``position`` as their order."""
    page = T.StructType([T.StructField("payload", T.ArrayType(record))])
    pages = spark.read.schema(page).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return pages.select(F.input_file_name().alias("file"), F.posexplode("payload").alias("position", "r")).select("file", "position", "r.*")


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table with a header, all text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(header=True, sep="\t", escape='"', multiLine=True).schema(schema).csv(path).fillna("")


def positional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Headerless tab-separated lines: those with enough fields, the first of which are named."""
    return fields(spark.read.text(path), "value", columns)


def fields(lines: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """The first tab-separated fields of lines that have enough, such as those of ``zipped_lines``."""
    parts = lines.where(F.trim(line) != "").select(F.split(line, "\t", -1).alias("p")).where(F.size("p") >= len(columns))
    return parts.select(*(F.col("p")[i].alias(c) for i, c in enumerate(columns)))


def pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Two columns, split at the first tab; lines without one are left out."""
    p = F.split("value", "\t", 2)
    return spark.read.text(path).select(p.alias("p")).where("size(p) = 2").select(F.col("p")[0].alias(left), F.col("p")[1].alias(right))


def zipped_lines(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(file, line_no, line) of one member of each zip, the only one unless named, streamed; what is not UTF-8 is replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [member] if member else z.namelist()
                    if len(members) != 1:
                        raise ValueError(f"{name} has {len(members)} members, not one")
                    with z.open(members[0]) as f:
                        held: list[str] = []
                        at = 0
                        for line in io.TextIOWrapper(f, "utf-8", "replace", newline="\n"):
                            held.append(line.rstrip("\r\n"))
                            if len(held) == 50_000:
                                yield pd.DataFrame({"file": name, "line_no": range(at, at + len(held)), "line": held})
                                held, at = [], at + len(held)
                        yield pd.DataFrame({"file": name, "line_no": range(at, at + len(held)), "line": held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line_no bigint, line string")


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Elements of XML files, plain or gzipped; a default namespace is ignored."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def json_page_lines(spark: SparkSession, path: str, record: T.StructType, envelope: T.StructType) -> DataFrame:
    """Records of pages written one to a line, with the fields of their envelope and ``position``."""
    schema = T.StructType([*envelope.fields, T.StructField("payload", T.ArrayType(record))])
    return spark.read.schema(schema).json(path).select(*envelope.names, F.posexplode("payload").alias("position", "r")).select(*envelope.names, "position", "r.*")


def zipped_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType, member: str | None = None) -> DataFrame:
    """Elements ``row_tag`` of one XML member of each zip, which are not nested; streamed, one element in memory at a time."""
    import xml.etree.ElementTree as ET

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [member] if member else z.namelist()
                    if len(members) != 1:
                        raise ValueError(f"{name} has {len(members)} members, not one")
                    held: list[str] = []
                    with z.open(members[0]) as f:
                        for _, element in ET.iterparse(f):
                            if element.tag.rpartition("}")[2] == row_tag:
                                for x in element.iter():  # the namespace is ignored
                                    x.tag = x.tag.rpartition("}")[2]
                                element.tail = None
                                held.append(ET.tostring(element, "unicode"))
                                element.clear()
                            if len(held) == 1000:
                                yield pd.DataFrame({"xml": held})
                                held = []
                    yield pd.DataFrame({"xml": held}, dtype=str)

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "xml string")
    return found.select(F.from_xml("xml", schema.simpleString()).alias("r")).select("r.*")
