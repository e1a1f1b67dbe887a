"""Named files: packed and by themselves, retries, look-up by name."""

import json
import zipfile
from pathlib import Path

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from pagesift.sources import archives
from pagesift.sources.archives import read_archives, texts_of, write_archives, write_files


def listed(out):
    return json.loads((Path(out) / "_index.json").read_text())["archives"]


@pytest.fixture
def table(spark):
    rows = [(f"{n % 7}/page {n}é.txt", f"body {n} " * (n % 40)) for n in range(500)] + [("empty", None)]
    return spark.createDataFrame(rows, "file string, body string").repartition(5)


def test_files_come_back_by_name_and_are_plain_zip_members(spark, table, tmp_path):
    out = write_archives(table, str(tmp_path / "out"), most=5000)
    expected = {r.file: r.body or "" for r in table.collect()}
    assert {r.file: r.body for r in texts_of(read_archives(spark, out)).collect()} == expected
    index = listed(out)
    assert len(index) > 10 and sum(a["files"] for a in index) == len(expected)
    # Sorted over all archives, which may meet but not overlap.
    assert all(a["last"] < b["first"] for a, b in zip(index, index[1:], strict=False))
    assert all(a["bytes"] < 5000 + 400 for a in index)
    names = [name for a in index for name in zipfile.ZipFile(Path(out) / a["archive"]).namelist()]
    assert sorted(names) == sorted(expected)
    assert {p.name for p in Path(out).glob("*.zip")} == {a["archive"] for a in index}


def test_one_file_opens_one_archive(spark, table, tmp_path):
    out = write_archives(table, str(tmp_path / "out"), most=5000)
    wanted = "3/page 10é.txt"
    one = read_archives(spark, out, [wanted])
    assert one.rdd.getNumPartitions() == 1
    assert [(r.file, r.body) for r in texts_of(one).collect()] == [(wanted, "body 10 " * 10)]
    several = read_archives(spark, out, [wanted, "0/page 0é.txt", "no such file", "zz"])
    assert sorted(r.file for r in several.collect()) == ["0/page 0é.txt", wanted]
    assert read_archives(spark, out, ["zz"]).collect() == [] == read_archives(spark, out, []).collect()


def test_a_second_write_adds(spark, table, tmp_path):
    out = str(tmp_path / "out")
    write_archives(table.filter("file = 'empty'"), out)
    write_archives(table.filter("file like '1/%'"), out)
    write_archives(table.filter("false"), out)
    assert read_archives(spark, out).count() == table.filter("file = 'empty' or file like '1/%'").count()


def test_a_task_that_is_tried_again_leaves_no_second_copy(tmp_path, monkeypatch):
    """The attempts of one task write archives of their own; the index lists those of the last."""
    import pyarrow as pa

    out, attempt = str(tmp_path / "out"), [0]

    class Task:
        def partitionId(self):
            return 3

        def taskAttemptId(self):
            return attempt[0]

    monkeypatch.setattr(TaskContext, "get", staticmethod(Task))
    writer = archives._Writer(out, "archives", 1 << 20)
    rows = pa.RecordBatch.from_pydict({"file": ["a", "b"], "body": ["1", "2"]})
    writer.write(iter([rows]))  # its message is lost with the executor
    attempt[0] = 1
    writer.commit([writer.write(iter([rows])), None])
    assert [(a["first"], a["last"], a["files"]) for a in listed(out)] == [("a", "b", 2)]
    assert len(list(Path(out).glob("*.zip"))) == 1
    attempt[0] = 2
    later = archives._Writer(out, "archives", 1 << 20)
    later.abort([later.write(iter([rows]))])
    assert len(list(Path(out).glob("*.zip"))) == 1 and len(listed(out)) == 1


@pytest.mark.parametrize("name", ["../up", "/root", "a/../../b", "", None, "a//b"])
def test_names_stay_inside(spark, tmp_path, name):
    rows = spark.createDataFrame([("good", "x"), (name, "y")], "file string, body string")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="Not a file name"):
        write_archives(rows, str(out))
    assert not (out / "_index.json").exists()
    assert not out.exists() or read_archives(spark, str(out)).count() == 0


def test_names_are_unique_in_a_write(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "y")], "file string, body string")
    with pytest.raises(Exception, match="Two files of one name"):
        write_archives(rows, str(tmp_path / "out"))


def test_loose_files_are_read_by_other_readers(spark, tmp_path):
    rows = spark.range(20).select(
        F.format_string("kind=%s/%s.bin", F.col("id") % 3, F.col("id")).alias("file"),
        F.col("id").cast("string").cast("binary").alias("body"),
    )
    out = write_files(rows, f"file://{tmp_path}/loose")
    found = spark.read.format("binaryFile").load(out)
    assert found.count() == 20
    one = found.filter("kind = 1")
    assert sorted(int(r.content) for r in one.collect()) == list(range(1, 20, 3))
    write_files(rows, out)
    assert spark.read.format("binaryFile").load(out).count() == 20
