"""Page archives and zip archives as data sources: stop rules, failed writes, members, ranges and odd bytes."""

import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources import paged, zips

RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("part", T.StructType([T.StructField("x", T.IntegerType())]))])


def land(root, stage, n, payload, total=None):
    folder = Path(root) / stage
    folder.mkdir(exist_ok=True)
    (folder / f"page_{n:04d}.json").write_text(json.dumps({"status": "OK", "paging": None if total is None else {"totalElements": total}, "payload": payload}))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_stop_rules(spark, tmp_path):
    rows = lambda *k: [{"id": i, "score": i / 10} for i in k]
    for stage, pages in {"total": [(rows(1, 2), 4), (rows(3, 4), 4)], "empty": [(rows(11), 9), ([], 9)], "gap": [(rows(21), 9)], "untold": [(rows(31, 32), None)], "long": [(rows(41), 9), (rows(42), 9), (rows(43), 9)]}.items():
        for n, (payload, total) in enumerate(pages):
            land(tmp_path, stage, n, payload, total)
        if stage not in ("gap", "long"):
            (tmp_path / stage / f"page_{len(pages):04d}.json").write_text("not JSON: reading this page would be an error")
    land(tmp_path, "gap", 2, rows(99), 9)
    assert ids(paged.read(spark, str(tmp_path), RECORD)) == [1, 2, 3, 4, 11, 21, 31, 32, 41, 42, 43]
    assert ids(paged.read(spark, str(tmp_path), RECORD, max_pages=2)) == [1, 2, 3, 4, 11, 21, 31, 32, 41, 42]
    assert ids(paged.read(spark, str(tmp_path), RECORD, max_pages=0)) == [1, 2, 11, 21, 31, 32, 41]  # a page is asked for before it is counted


def test_stages_and_tests_are_the_relations(spark, tmp_path):
    for stage in ("a", "b"):
        land(tmp_path, stage, 0, [{"id": i, "score": s, "name": stage} for i, s in ((1, 0.5), (2, None), (3, 0.9))], 3)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "page_0000.json").write_text("other stages are not opened")
    found = paged.read(spark, str(tmp_path), RECORD, stages=["a", "b", "none"])
    one, two = found.where("stage = 'a'"), found.where("stage = 'b' and score > 0.6")
    assert (found.count(), one.count(), found.count(), two.count(), one.union(two).count()) == (6, 3, 6, 1, 4)
    assert ids(paged.read(spark, str(tmp_path), RECORD, stages=["a"], where=[("score", ">=", 0.5), ("id", "in", [1, 2])])) == [1]
    assert ids(paged.read(spark, str(tmp_path), RECORD, stages=["b"], where=[("name", "<>", "a")])) == [1, 2, 3]
    with pytest.raises(Exception, match="cannot test"):
        paged.read(spark, str(tmp_path), RECORD, where=[("tags", "=", "x")]).collect()


def test_values_that_do_not_fit_and_folders_that_are_not_there(spark, tmp_path):
    land(tmp_path, "s", 0, [{"id": "x", "score": 1, "name": {"b": 1, "a": None}, "tags": ["t", 2], "part": {"x": 3, "y": 4}}, {"id": True, "score": "1", "tags": "t", "part": 5}, {}], 3)
    got = [tuple(r) for r in paged.read(spark, str(tmp_path), RECORD).orderBy("position").collect()]
    assert got == [("s", 0, 0, None, 1.0, '{"a": null, "b": 1}', ["t", "2"], (3,)), ("s", 0, 1, None, None, None, None, None), ("s", 0, 2, None, None, None, None, None)]
    assert paged.read(spark, f"{tmp_path}/none", RECORD).count() == 0
    with pytest.raises(ValueError, match="named as"):
        paged.read(spark, str(tmp_path), T.StructType.fromDDL("stage string"))


@pytest.fixture()
def pages(spark):
    rows = [(s, n, {"totalElements": 6}, [(f"{s}{n}{i}",) for i in range(2)], "OK" if n else None) for s in ("A", "B") for n in range(3)]
    return spark.createDataFrame(rows, "stage string, page long, paging struct<totalElements:long>, payload array<struct<id:string>>, status string").repartition(3)


@pytest.mark.parametrize("index", [True, False])
def test_pages_go_out_and_come_back(spark, pages, tmp_path, index):
    path = f"{tmp_path}/out"
    paged.write(pages, path, index)
    envelope = json.loads((Path(path) / "A" / "page_0000.json").read_text())
    assert envelope == {"paging": {"totalElements": 6}, "payload": [{"id": "A00"}, {"id": "A01"}], "status": None}
    assert sorted(p.name for p in (Path(path) / "B").iterdir()) == [f"page_000{n}.json" for n in range(3)]
    found = paged.read(spark, path, T.StructType.fromDDL("id string"), task_rows=4)
    assert sorted((r.stage, r.page, r.position, r.id) for r in found.collect()) == [(s, n, i, f"{s}{n}{i}") for s in "AB" for n in range(3) for i in range(2)]
    assert found.rdd.getNumPartitions() == (4 if index else 2)
    assert paged.read(spark, path, T.StructType.fromDDL("id string"), max_pages=2).count() == 8


def test_a_write_that_fails_leaves_no_page(spark, pages, tmp_path):
    broken = pages.withColumn("payload", F.when((F.col("stage") == "B") & (F.col("page") == 2), F.raise_error(F.lit("torn")).cast("array<struct<id:string>>")).otherwise(F.col("payload")))
    twice = pages.unionByName(pages.limit(1))
    for bad, error in ((broken, "torn"), (twice, "twice"), (pages.withColumn("stage", F.lit("../x")), "not a page"), (pages.withColumn("page", F.lit(None).cast("long")), "not a page"), (pages.withColumn("other", F.lit(1)), "other")):
        path = f"{tmp_path}/{abs(hash(error))}"
        with pytest.raises(Exception, match=error):
            paged.write(bad, path)
        assert not [p for p in Path(path).rglob("*") if p.is_file()]


def test_members_and_ranges(spark, tmp_path):
    rows = [("a.zip", f"m{i % 3}.txt", i, "x" * (i % 50) + "é") for i in range(600)] + [("b.zip", "only.txt", 0, "one"), ("b.zip", "only.txt", 1, None)]
    df = spark.createDataFrame(rows, "archive string, member string, at long, text string")
    for compress in (True, False):
        path = f"{tmp_path}/{compress}"
        zips.write(df, path, compress)
        assert sorted(p.name for p in Path(path).iterdir()) == ["a.zip", "b.zip"]
        for split in (700, 1 << 20):
            found = zips.lines(spark, path, split=split)
            assert found.rdd.getNumPartitions() == (4 if compress or split > 700 else found.rdd.getNumPartitions()) and found.rdd.getNumPartitions() >= 4
            got = found.collect()
            assert sorted(r.text for r in got) == sorted(r[3] or "" for r in rows)
            for r in got[:200]:  # `at` is the byte at which a line starts
                data = zipfile.ZipFile(r.archive).read(r.member)
                assert data[r.at :].split(b"\n", 1)[0].decode() == r.text
    assert zips.lines(spark, path, "m1*").count() == 200 and zips.lines(spark, f"{path}/b.zip").count() == 2


def test_odd_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/x.xml", '<r xmlns="u"><g><m><a>1</a><m><a>9</a></m></m></g><o/><m><a>2</a></m><m/></r>')
        z.writestr("e.txt", b"\xff\xfe bad\r\n\nlast")
        z.writestr("empty.txt", "")
        z.writestr("folder/", "")
    assert sorted((r.member, r.at, r.text) for r in zips.lines(spark, str(tmp_path), "*e*.txt").collect()) == [("e.txt", 0, "�� bad"), ("e.txt", 8, ""), ("e.txt", 9, "last")]
    found = zips.elements(spark, str(tmp_path), "m", T.StructType.fromDDL("a string"), "*.xml")
    assert [(r.at, r.a) for r in found.orderBy("at").collect()] == [(0, "1"), (1, "2"), (2, None)]
    assert zips.lines(spark, str(tmp_path), "none").count() == 0


def test_a_member_is_streamed(tmp_path):
    """300 MB of lines go through in batches, not as one."""
    from graphloom.sources.zips import Member, MemberReader

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.txt", "w") as f:
        for _ in range(300):
            f.write((b"x" * 1023 + b"\n") * 1024)
    reader = MemberReader({"path": str(tmp_path)})
    batches = [b.num_rows for b in reader.read(Member(str(tmp_path / "big.zip"), "big.txt", 0, None))]
    assert sum(batches) == 300 * 1024 and max(batches) * 1024 <= 17 << 20


@pytest.mark.parametrize("tasks", [3, 8])
def test_many_members_share_tasks(spark, tmp_path, monkeypatch, tasks):
    """Forty members of five archives are no forty tasks; with more archives than tasks, whole ones are dealt out."""
    rows = [(f"{i % 5}.zip", f"m{i % 8}.txt", i, f"{i} é") for i in range(400)]
    zips.write(spark.createDataFrame(rows, "archive string, member string, at long, text string"), str(tmp_path))
    monkeypatch.setattr(zips, "TASKS", tasks)
    reader = zips.MemberReader({"path": str(tmp_path), "member": "m[1-7]*"})
    parts = reader.partitions()
    assert len(parts) <= tasks + 2 and len({m.archive for p in parts for m in p.parts}) == 5
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["archive"].rpartition("/")[2], r["member"], r["text"]) for r in got) == sorted((a, m, t) for a, m, _, t in rows if m != "m0.txt")
    assert all(zipfile.ZipFile(r["archive"]).read(r["member"])[r["at"] :].startswith(r["text"].encode() + b"\n") for r in got)


def test_pages_of_a_batch_are_written_a_few_at_a_time(tmp_path):
    """A batch of 4,000 pages of 100 records is never a table of Python values."""
    import tracemalloc

    import pyarrow as pa

    schema = T.StructType.fromDDL("stage string, page int, payload array<struct<k:bigint,v:double>>, paging map<string,int>")
    records = [{"k": i, "v": None if i == 3 else i / 8} for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"stage": ["s"] * 4000, "page": list(range(4000)), "payload": [records] * 4000, "paging": [[("totalElements", 7)]] * 4000}, schema=pa.schema([("stage", pa.string()), ("page", pa.int32()), ("payload", pa.list_(pa.struct([("k", pa.int64()), ("v", pa.float64())]))), ("paging", pa.map_(pa.string(), pa.int32()))]))
    writer = paged.PageWriter({"path": str(tmp_path)}, schema)
    tracemalloc.start()
    done = writer.write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20, peak
    writer.commit([done])
    page = json.loads((tmp_path / "s" / "page_3999.json").read_text())
    assert page["paging"] == {"totalElements": 7} and page["payload"][2:4] == [{"k": 2, "v": 0.25}, {"k": 3}] and len(page["payload"]) == 100


def test_a_task_that_outlives_its_job_leaves_no_page(tmp_path):
    import pyarrow as pa

    schema = T.StructType.fromDDL("stage string, page int, payload array<int>")
    batch = pa.RecordBatch.from_pydict({"stage": ["s"], "page": pa.array([0], pa.int32()), "payload": [[1]]})
    writer = paged.PageWriter({"path": str(tmp_path)}, schema)
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([batch]))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
