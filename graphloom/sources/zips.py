"""Members of zip archives as a data source of Spark, planned from the archives' central directories.

A task is a member, or a byte range of a member that is stored without
compression; where there are more than ``TASKS`` of these, small ones are dealt
together by their bytes, whole archives where there are so many, so the number
of tasks grows with the bytes and not with the members. Its bytes are streamed from the archive's own file system by
seeking, so neither an archive nor a member is ever held whole, and archives
and members may be larger than any memory.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 128 << 20  # bytes of a task of a stored member
TASKS = 64  # up to so many members, or archives, have a task of their own
OPENING = 1 << 16  # bytes that opening a member counts for
_ROWS, _BYTES = 50_000, 16 << 20  # of a batch, at most
_LOCAL = struct.Struct("<26xHH")  # the local header's lengths of name and extra field


@dataclass
class Member(InputPartition):
    """A member of an archive, from byte ``start`` up to ``end`` if it is stored, whole if ``end`` is None; all members that fit if ``name`` is None."""

    archive: str
    name: str | None
    start: int
    end: int | None


@dataclass
class Members(InputPartition):
    """Members that one task reads in turn."""

    parts: list[Member]


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("member", "*")
        self.split, self.tag = int(options.get("split", SPLIT)), options.get("element")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _files(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
            archives = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name.lower().endswith(".zip"))
        else:
            archives = [(root, info.size)]
        # of many archives only the large ones are opened here
        opened = [a for a in archives if len(archives) <= TASKS or a[1] > self.split]
        sized = [(Member(a, None, 0, None), size) for a, size in archives if len(archives) > TASKS and size <= self.split]
        for archive, _ in opened:
            with store.open_input_file(archive) as f, zipfile.ZipFile(f) as z:  # reads the directory at the archive's end
                for m in self._fitting(archive, z):
                    if m.compress_type == zipfile.ZIP_STORED and m.file_size > self.split and not self.tag:
                        sized += [(Member(archive, m.filename, at, min(at + self.split, m.file_size)), self.split) for at in range(0, m.file_size, self.split)]
                    else:
                        sized.append((Member(archive, m.filename, 0, None), m.compress_size))
        return _dealt(sized, self.split) or [Member("", "", 0, None)]  # Spark reads one partition at least

    def _fitting(self, archive: str, z: zipfile.ZipFile) -> Iterator[zipfile.ZipInfo]:
        for m in z.infolist():
            if m.is_dir() or not fnmatch.fnmatchcase(m.filename, self.pattern):
                continue
            if m.flag_bits & 1:
                raise ValueError(f"{archive}: {m.filename} is encrypted")
            yield m

    def read(self, partition: Member | Members) -> Iterator[pa.RecordBatch]:
        parts = partition.parts if isinstance(partition, Members) else [partition]
        store, _ = _files(self.path)
        return _batches(row for archive, own in itertools.groupby(parts, key=lambda p: p.archive) if archive for row in self._rows(store, archive, own))

    def _rows(self, store, archive: str, parts: Iterable[Member]) -> Iterator[tuple[str, str, int, str]]:
        """The rows of members of one archive, which is opened once."""
        with store.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
            for p in parts:
                for name in [p.name] if p.name is not None else [m.filename for m in self._fitting(archive, z)]:
                    for at, text in self._found(f, z, name, p):
                        yield archive, name, at, text

    def _found(self, f, z: zipfile.ZipFile, name: str, partition: Member) -> Iterator[tuple[int, str]]:
        if self.tag or partition.end is None:
            with z.open(name) as member:
                yield from _elements(member, self.tag) if self.tag else _lines(member, 0, None)
            return
        m = z.getinfo(name)
        f.seek(m.header_offset)
        begin = m.header_offset + _LOCAL.size + sum(_LOCAL.unpack(f.read(_LOCAL.size)))
        f.seek(begin + max(partition.start - 1, 0))
        stored = _Stored(f, m.file_size - max(partition.start - 1, 0))
        at = partition.start
        if at:  # the line that this range begins in belongs to the range before
            at += len(stored.readline()) - 1
        yield from _lines(stored, at, partition.end)


def _dealt(sized: list[tuple[Member, int]], split: int) -> list[InputPartition]:
    """A task for each, or for neighbours together where there are more than ``TASKS``: of ``split`` bytes, or less where that gives ``TASKS`` tasks."""
    if len(sized) <= TASKS:
        return [m for m, _ in sized]
    most = max(1, min(split, sum(size + OPENING for _, size in sized) // TASKS))
    out, own, held = [], [], 0
    for member, size in sized:
        if own and held + size + OPENING > most:
            out.append(Members(own))
            own, held = [], 0
        own.append(member)
        held += size + OPENING
    return [*out, Members(own)]


class _Stored(io.BufferedIOBase):
    """The next ``size`` bytes of a file, by buffered lines."""

    def __init__(self, file, size: int):
        self.file, self.left, self.held = file, size, b""

    def readline(self, size: int = -1) -> bytes:
        parts = []
        while True:
            end = self.held.find(b"\n") + 1
            parts.append(self.held[:end] if end else self.held)
            self.held = self.held[end:] if end else b""
            if end or not self.left:
                return b"".join(parts)
            self.held = self.file.read(min(1 << 20, self.left))
            self.left = self.left - len(self.held) if self.held else 0


def _lines(file, at: int, end: int | None) -> Iterator[tuple[int, str]]:
    """(byte of its start, line) of the lines that start before ``end``; what is not UTF-8 is replaced."""
    while end is None or at < end:
        line = file.readline()
        if not line:
            return
        yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
        at += len(line)


def _elements(file, tag: str) -> Iterator[tuple[int, str]]:
    """(number, XML) of the elements ``tag``, outermost ones, without namespaces; one in memory at a time."""
    import xml.etree.ElementTree as ET

    depth, n, parents = 0, 0, []
    for event, element in ET.iterparse(file, ("start", "end")):
        own = element.tag.rpartition("}")[2] == tag
        if event == "start":
            parents.append(element)
            depth += own
            continue
        parents.pop()
        depth -= own
        if own and not depth:
            for x in element.iter():
                x.tag = x.tag.rpartition("}")[2]
            element.tail = None
            yield n, ET.tostring(element, "unicode")
            n += 1
        if not depth:
            element.clear()
            if parents:
                parents[-1].clear()  # what was read before is no longer needed
    return


def _batches(found: Iterable[tuple[str, str, int, str]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row[3])
        if len(rows) == _ROWS or size >= _BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"archive": pa.string(), "member": pa.string(), "at": pa.int64(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), types.values())], list(types))


class ZipMembers(DataSource):
    """Format ``zip_members``; options ``path`` (an archive or a folder of them), ``member`` (a pattern), ``split``, ``element``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, at bigint, text string"

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options)


def lines(spark: SparkSession, path: str, member: str = "*", split: int = SPLIT) -> DataFrame:
    """(archive, member, at, text): the lines of all members whose name fits, ``at`` being the byte at which each starts.

    Line ends are left out, bytes that are not UTF-8 are replaced, an empty
    member has no lines. Encrypted members are an error.
    """
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(path=path, member=member, split=str(split)).load()


def elements(spark: SparkSession, path: str, tag: str, schema: StructType, member: str = "*") -> DataFrame:
    """(archive, member, at, fields of ``schema``): the elements ``tag`` of XML members, ``at`` being their number; namespaces are ignored."""
    spark.dataSource.register(ZipMembers)
    found = spark.read.format("zip_members").options(path=path, member=member, element=tag).load()
    return found.select("archive", "member", "at", F.from_xml("text", schema.simpleString()).alias("r")).select("archive", "member", "at", "r.*")


def write(rows: DataFrame, path: str, compress: bool = True) -> None:
    """One archive for each value of ``archive``, one member for each of ``member``, of the lines ``text`` in the order of ``at``.

    Rows are dealt out by archive and streamed into it; a task that runs again
    replaces its archives whole, as each gets its name when it is complete.
    """

    method = zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _files(path)
        store.create_dir(root)
        now, names = None, []
        for batch in batches:
            for archive, member, text in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "text"))):
                if now is None or now.name != archive:
                    if now is not None:
                        now.close()
                    now = _Archive(store, root, archive, method)
                    names.append(archive)
                now.add(member, (text or "").encode() + b"\n")
        if now is not None:
            now.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])

    base = rows.select("archive", "member", "at", "text")
    base.repartition("archive").sortWithinPartitions("archive", "member", "at").mapInArrow(run, "archive string").write.format("noop").mode("overwrite").save()


class _Archive:
    """An archive that is written member by member, under another name until it is complete."""

    def __init__(self, store, root: str, name: str, method: int):
        self.store, self.name, self.method = store, name, method
        self.part, self.path = f"{root}/.{name}.{uuid.uuid4().hex}.part", f"{root}/{name}"
        self.out = store.open_output_stream(self.part)
        self.zip, self.member, self.file = zipfile.ZipFile(self.out, "w"), None, None

    def add(self, member: str, data: bytes) -> None:
        if self.member != member:
            if self.file:
                self.file.close()
            info = zipfile.ZipInfo(member)
            info.compress_type = self.method
            self.member, self.file = member, self.zip.open(info, "w", force_zip64=True)
        self.file.write(data)

    def close(self) -> None:
        for part in (self.file, self.zip, self.out):
            part.close()
        self.store.move(self.part, self.path)
