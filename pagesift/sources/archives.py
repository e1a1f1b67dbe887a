"""Named files as output: packed into zip archives of bounded size, or each by itself.

``archives`` is a Spark data source for tables of ``file`` and ``body``. Every task streams its
rows into archives of its own; the commit writes an index with the first and last name
of each archive, and only what the index lists counts. So a task that is tried again leaves
no second copy, a job that fails leaves nothing, and one file is found with the index and the
directory of one archive. Whoever unpacks the archives has the named files.
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

# The code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOURCE = "pagesift_archives"
INDEX = "_index.json"
#: Bytes of bodies after which the next archive begins.
ARCHIVE_BYTES = 256 << 20
# Fixed value: every member has the same time, so that equal bodies make equal archives.
_TIME = (1980, 1, 1, 0, 0, 0)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    found, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return found, root.rstrip("/")


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def checked_name(name: str | None) -> str:
    """A name that stays inside its folder, else ``ValueError``."""
    if not name or name.startswith("/") or posixpath.normpath(name) != name or name.startswith(".."):
        raise ValueError(f"Not a file name inside the output: {name!r}")
    return name


@dataclass
class _Written(WriterCommitMessage):
    """What a task wrote: archives with their first and last name, or loose files."""

    archives: list[dict]
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, layout: str, most: int) -> None:
        self.path, self.layout, self.most, self.job = path, layout, most, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _place(self.path)
        rows = (
            (checked_name(name), body.encode() if isinstance(body, str) else body or b"")
            for batch in iterator
            for name, body in zip(batch["file"].to_pylist(), batch["body"].to_pylist(), strict=True)
        )
        done = _Written([], [])
        try:
            (self._loose if self.layout == "files" else self._packed)(store, root, rows, done)
        except BaseException:
            self._discard(store, root, [done])
            raise
        return done

    def _packed(self, store: fs.FileSystem, root: str, rows: Iterable[tuple[str, bytes]], done: _Written) -> None:
        task = TaskContext.get()
        prefix = f"{self.job}-{task.partitionId()}-{task.taskAttemptId()}"
        archive, out, last = None, None, None
        store.create_dir(root, recursive=True)
        try:
            for name, body in rows:
                if name == last:
                    raise ValueError(f"Two files of one name: {name!r}")
                if archive is None or done.archives[-1]["bytes"] >= self.most:
                    if archive is not None:
                        archive.close()
                        out.close()
                    listed = {"archive": f"{prefix}-{len(done.archives)}.zip", "first": name, "bytes": 0, "files": 0}
                    done.archives.append(listed)
                    out = store.open_output_stream(f"{root}/{listed['archive']}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(name, _TIME), body, zipfile.ZIP_DEFLATED)
                listed |= {"last": name, "bytes": listed["bytes"] + len(body), "files": listed["files"] + 1}
                last = name
        finally:
            if archive is not None:
                archive.close()
                out.close()

    def _loose(self, store: fs.FileSystem, root: str, rows: Iterable[tuple[str, bytes]], done: _Written) -> None:
        for name, body in rows:
            store.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            done.files.append(name)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(body)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.layout == "files":
            return
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        archives = [archive for message in messages if message for archive in message.archives]
        named = {archive["archive"] for archive in archives}
        # What attempts that do not count have left.
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(self.job) and info.base_name not in named:
                store.delete_file(info.path)
        index = {"archives": sorted(_index(self.path) + archives, key=lambda a: (a["first"], a["archive"]))}
        with store.open_output_stream(f"{root}/{self.job}.json") as out:
            out.write(json.dumps(index).encode())
        store.move(f"{root}/{self.job}.json", f"{root}/{INDEX}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        # A task that is still running may leave an archive behind; no index lists it.
        self._discard(*_place(self.path), [m for m in messages if m])

    def _discard(self, store: fs.FileSystem, root: str, messages: list[_Written]) -> None:
        for message in messages:
            for name in [archive["archive"] for archive in message.archives] + message.files:
                if _exists(store, f"{root}/{name}"):
                    store.delete_file(f"{root}/{name}")


def _index(path: str) -> list[dict]:
    """The archives that count: archive, first, last, files, bytes."""
    store, root = _place(path)
    if not _exists(store, f"{root}/{INDEX}"):
        return []
    with store.open_input_stream(f"{root}/{INDEX}") as file:
        return json.loads(file.read())["archives"]


@dataclass
class _Archive(InputPartition):
    archive: str
    names: list[str] | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str] | None) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        store, root = _place(self.path)
        if not _exists(store, root):
            raise ValueError(f"No archives in {self.path}")
        if self.names is None:
            return [_Archive(a["archive"], None) for a in _index(self.path)] or [_Archive("", [])]
        within = [
            _Archive(a["archive"], [name for name in self.names if a["first"] <= name <= a["last"]])
            for a in _index(self.path)
        ]
        return [part for part in within if part.names] or [_Archive("", [])]

    def read(self, partition: _Archive) -> Iterator[tuple[str, bytes]]:
        if not partition.archive:
            return
        store, root = _place(self.path)
        with store.open_input_file(f"{root}/{partition.archive}") as file, zipfile.ZipFile(file) as archive:
            held = set(archive.namelist()) if partition.names else ()
            for name in archive.namelist() if partition.names is None else partition.names:
                if partition.names is None or name in held:
                    yield name, archive.read(name)


class ArchiveSource(DataSource):
    """Options: ``path``; to write, ``layout`` (``archives`` or ``files``) and ``most`` (bytes of an
    archive); to read, ``names``, a JSON array of the files wanted."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "file string, body binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("Archives are added to, not overwritten")
        most = int(self.options.get("most", ARCHIVE_BYTES))
        return _Writer(self.options["path"], self.options.get("layout", "archives"), most)

    def reader(self, schema) -> _Reader:
        names = self.options.get("names")
        return _Reader(self.options["path"], None if names is None else json.loads(names))


def write_archives(df: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> str:
    """Pack the files of a table (``file``, and ``body`` as text or bytes) and return the folder.

    Names are sorted over all archives, so each is found by the index. A NULL body is an empty
    file; a missing name, one that leaves the folder, or one that occurs twice in a write
    fails the job, which then leaves nothing. Other columns are ignored. ``df`` should be a stored
    table: it is read once more to find the bounds of names.
    """
    spark = df.sparkSession
    spark.dataSource.register(ArchiveSource)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("file", "body").repartitionByRange(parts, "file").sortWithinPartitions("file")
    rows.write.format(SOURCE).mode("append").option("path", path).option("most", most).save()
    return path


def write_files(df: DataFrame, path: str) -> str:
    """Write each row of a table (``file``, ``body``) as a file of its own and return the folder:
    for readers of files, where there are not too many. A repeated name is written again."""
    df.sparkSession.dataSource.register(ArchiveSource)
    rows = df.select("file", "body")
    rows.write.format(SOURCE).mode("append").option("path", path).option("layout", "files").save()
    return path


def read_archives(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> DataFrame:
    """``file, body`` (bytes) of packed files, or of those with the given names, for which only the
    archives are opened that may hold them, and of those only their directory and the files."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(SOURCE).option("path", path)
    return (reader if names is None else reader.option("names", json.dumps(sorted(set(names))))).load()


def texts_of(files: DataFrame) -> DataFrame:
    """``file, body`` with the body as text."""
    return files.select("file", F.decode("body", "UTF-8").alias("body"))
