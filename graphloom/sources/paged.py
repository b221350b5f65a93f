"""Archive of crawled pages as a data source of Spark: ``{stage}/page_{n:04d}.json``, one envelope a file.

Reading follows the crawl's stop rules: a stage's pages count from 0 up to the
first one that is empty or missing, with which its total is reached, or that is
the last allowed; files behind it are not opened. Wanted stages and tests of
fields are options of the relation: other stages are not listed as tasks, and
records that fail a test do not leave the reader. They are not taken from the
plan's filters, because Spark 4.1 keeps one reader for all plans of a DataFrame:
a filter pushed by one plan, or by one branch of a union, would hold in others.

Writing gives one file for each page. Tasks write to a folder of their job and
hand over what they wrote; only the commit moves files from there, and the
folder goes in any case, so neither a failed job nor a failed task leaves a file
behind. With ``index`` the commit also writes a small file of page sizes,
from which a later read plans its stop rules as a running sum, opens nothing
behind them, and cuts long stages into several tasks.
"""

from __future__ import annotations

import json
import operator
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

INDEX = "_pages.json"
HELD = 16  # pages of a task that are Python values at a time
#: Keys of an envelope, in the order of their names; a page keeps those that its writer is given
ENVELOPE = ("httpStatus", "paging", "payload", "requestpar", "status", "warnings")
_COMPARE = {"=": operator.eq, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda a, b: a in b}


def _files(path: str):
    """File system of a path and the path in it; works for those that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


@dataclass
class Pages(InputPartition):
    """Pages ``first`` up to before ``end`` of a stage; without an end the reader stops by the rules."""

    stage: str
    first: int
    end: int | None


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (stage, page, records, total, temporary name)."""

    pages: list[tuple]


def _total(envelope: dict, rows: int) -> int:
    return int((envelope.get("paging") or {}).get("totalElements") or rows)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema = options["path"], schema
        self.most = int(options["max_pages"]) if "max_pages" in options else None
        self.task_rows = int(options.get("task_rows", 100_000))
        self.stages = set(json.loads(options["stages"])) if "stages" in options else None
        self.tests = json.loads(options.get("where", "[]"))
        for name, sign, _ in self.tests:
            if sign not in _COMPARE or not isinstance(schema[name].dataType, (T.NumericType, T.StringType)):
                raise ValueError(f"cannot test {name} {sign}")

    def partitions(self) -> list[Pages]:
        """A task for each stage, or for each ``task_rows`` records of it where there is an index."""
        from pyarrow import fs

        store, root = _files(self.root)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        stages = sorted(i.base_name for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))
        stages = [s for s in stages if self.stages is None or s in self.stages]
        if not any(i.base_name == INDEX for i in found):
            return [Pages(s, 0, None) for s in stages] or [Pages("", 0, 0)]
        with store.open_input_stream(f"{root}/{INDEX}") as f:
            sizes = json.load(f)
        out = []
        for s in stages:
            first, held, seen = 0, 0, 0
            end = 0
            for rows, total in _counted(sizes.get(s, {})):
                if self.most is not None and end >= max(self.most, 1):
                    break
                end, held, seen = end + 1, held + rows, seen + rows
                if held >= self.task_rows:
                    out.append(Pages(s, first, end))
                    first, held = end, 0
                if not rows or seen >= total:
                    break
            if first < end:
                out.append(Pages(s, first, end))
        return out or [Pages("", 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, root = _files(self.root)
        fields, kinds = self.schema.fieldNames(), [f.dataType for f in self.schema]
        page, seen = partition.first, 0
        while partition.end is None or page < partition.end:
            try:
                with store.open_input_stream(f"{root}/{partition.stage}/page_{page:04d}.json") as f:
                    envelope = json.load(f)
            except FileNotFoundError:
                return
            payload = envelope.get("payload") or []
            own = {"stage": partition.stage, "page": page}
            for position, record in enumerate(payload):
                if self._passes(record):
                    own["position"] = position
                    yield tuple(own[n] if n in own else _fitted(record.get(n), k) for n, k in zip(fields, kinds))
            page, seen = page + 1, seen + len(payload)
            if partition.end is None and (not payload or seen >= _total(envelope, len(payload)) or (self.most is not None and page >= self.most)):
                return

    def _passes(self, record: dict) -> bool:
        for name, sign, value in self.tests:
            own = _fitted(record.get(name), self.schema[name].dataType)
            if own is None or value is None or not _COMPARE[sign](own, value):
                return False
        return True


def _counted(pages: dict) -> Iterator[tuple[int, int]]:
    """(records, total) of pages 0, 1 and so on, as far as there are any."""
    n = 0
    while str(n) in pages:
        yield tuple(pages[str(n)])
        n += 1


def _fitted(value, kind: T.DataType):
    """A JSON value as a value of a Spark type; what does not fit is null, and a number or structure asked for as text is its JSON."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, T.IntegralType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.ArrayType):
        return [_fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return {k: _fitted(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, StructType):
        return Row(**{f.name: _fitted(value.get(f.name), f.dataType) for f in kind}) if isinstance(value, dict) else None
    raise ValueError(f"pages have no values of type {kind.simpleString()}")


class PageWriter(DataSourceArrowWriter):
    """Writes rows (stage, page, payload and other envelope keys), one file each, a few at a time of the batches that Spark sends."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.index = options["path"], options.get("index", "true").lower() == "true"
        self.folder = f"_writing-{uuid.uuid4().hex}"  # of this job: the writer is made once and sent to its tasks
        self.keys = [f.name for f in schema if f.name not in ("stage", "page")]
        odd = [k for k in self.keys if k not in ENVELOPE]
        if odd or not {"stage", "page", "payload"} <= set(schema.fieldNames()):
            raise ValueError(f"pages are (stage, page, payload) and of {ENVELOPE}, not {odd or schema.fieldNames()}")

        # made here and by no task, so a task that still runs when the job is undone finds no folder to write to
        store, root = _files(self.root)
        store.create_dir(f"{root}/{self.folder}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _files(self.root)
        done = []
        for batch in iterator:
            kinds = {f.name: f.type for f in batch.schema}
            for row in (row for at in range(0, batch.num_rows, HELD) for row in batch.slice(at, HELD).to_pylist()):
                if row["stage"] is None or row["page"] is None or row["page"] < 0 or not row["stage"] or "/" in row["stage"] or row["stage"][0] in "._":
                    raise ValueError(f"not a page of a stage: {row['stage']!r}, {row['page']!r}")
                envelope = {k: _plain(row[k], kinds[k]) for k in self.keys}
                name = f"{root}/{self.folder}/{uuid.uuid4().hex}"
                rows = len(envelope["payload"] or [])
                done.append((row["stage"], row["page"], rows, _total(envelope, rows), name))
                with store.open_output_stream(name) as f:
                    f.write(json.dumps(envelope, ensure_ascii=False, indent=2, sort_keys=True).encode())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _files(self.root)
        pages = [p for m in messages if m for p in m.pages]
        if len({p[:2] for p in pages}) < len(pages):
            self.abort(messages)
            raise ValueError("a page comes twice")
        for stage in {p[0] for p in pages}:
            store.create_dir(f"{root}/{stage}")
        for stage, page, _, _, name in pages:
            store.move(name, f"{root}/{stage}/page_{page:04d}.json")
        if self.index:
            sizes: dict[str, dict] = {}
            for stage, page, rows, total, _ in pages:
                sizes.setdefault(stage, {})[str(page)] = [rows, total]
            store.create_dir(root)
            with store.open_output_stream(f"{root}/{INDEX}") as f:
                f.write(json.dumps(sizes, sort_keys=True).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what tasks wrote, those that failed included."""
        store, root = _files(self.root)
        for turn in range(20):
            try:
                store.delete_dir(f"{root}/{self.folder}")
            except FileNotFoundError:
                return
            except OSError:  # a task that is being ended has put a file into it meanwhile
                if turn == 19:
                    raise
                time.sleep(0.1)


def _plain(value, kind: pa.DataType):
    """A value of a batch as JSON has it: structs without the fields that are null, as an answer leaves them out."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind if value[f.name] is not None}
    if pa.types.is_map(kind):
        return {k: _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    return value


class PageArchive(DataSource):
    """Format ``pages``; options ``path``, ``stages``, ``where``, ``max_pages``, ``task_rows`` (reading), ``index`` (writing)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        if overwrite:
            raise ValueError("pages are added to an archive, not overwritten")
        return PageWriter(self.options, schema)


def read(spark: SparkSession, path: str, record: StructType, stages: list[str] | None = None, where: list[tuple] = (), max_pages: int | None = None, task_rows: int | None = None) -> DataFrame:
    """(stage, page, position, fields of ``record``) of the pages that a crawl reaches.

    ``stages`` names those to read, ``where`` holds (field, sign, value) of
    tests that all must hold, with a sign of SQL or ``in`` and a list; a null
    fails every test. The stop rules count all records, whatever is tested.
    Values that do not fit their field are null. A folder without stages, or
    that is not there, gives no rows.
    """
    spark.dataSource.register(PageArchive)
    own = StructType([T.StructField("stage", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("position", T.IntegerType())])
    clash = set(own.fieldNames()) & set(record.fieldNames())
    if clash:
        raise ValueError(f"records have fields named as a page's own: {sorted(clash)}")
    limits = {"where": json.dumps(list(where))} | {k: str(v) for k, v in (("max_pages", max_pages), ("task_rows", task_rows)) if v is not None}
    if stages is not None:
        limits["stages"] = json.dumps(stages)
    return spark.read.format("pages").schema(StructType(own.fields + record.fields)).options(path=path, **limits).load()


def write(pages: DataFrame, path: str, index: bool = True) -> None:
    """One file for each row (stage, page, payload, and what other keys of ``ENVELOPE`` it has).

    A page that comes twice, a blank stage or a negative page is an error, and
    so is a failure of any task: no page of the job stays then. Pages of earlier
    jobs stay; an ``index`` covers the pages of this job alone.
    """
    pages.sparkSession.dataSource.register(PageArchive)
    pages.select("stage", F.col("page").cast("int").alias("page"), *(c for c in pages.columns if c not in ("stage", "page"))).write.format("pages").options(path=path, index=str(index).lower()).mode("append").save()

