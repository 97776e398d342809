"""Request files within the limits of a batch service, as a data source with a manifest.

A service takes files up to some lines and bytes. Each task closes its file at the limit and opens the
next, in a folder of its own, and lists its files beside them. The manifest names the lists and is
written once all tasks are done. Readers follow it, so nothing of a job that failed is ever visible,
and the driver holds one entry per task, however many files there are.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "request_files"
MANIFEST = "manifest.jsonl"
_ENTRY = "name string, lines long, bytes long"
# Bytes that a task takes from a file at a time, and about so many that a task reads in all.
_BLOCK, _SHARE = 4 << 20, 128 << 20


@dataclass
class WrittenFiles(WriterCommitMessage):
    """The list of a task's files, by its name below the folder; none if the task had no rows."""

    listed: str | None


def _store(path: str):
    """The file system of a path and the path within it; any that Arrow knows by its scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + posixpath.abspath(path)
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, max_lines: int, max_bytes: int, job: str):
        self.folder, self.max_lines, self.max_bytes, self.job = folder, max_lines, max_bytes, job

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenFiles:
        store, folder = _store(self.folder)
        # Attempts of a task never share a folder.
        own = posixpath.join(self.job, uuid.uuid4().hex)
        listed, files, out = None, 0, None
        name, lines, size = "", 0, 0

        def close() -> None:
            out.close()
            entry = {"name": name, "lines": lines, "bytes": size}
            listed.write(json.dumps(entry).encode() + b"\n")

        try:
            for batch in batches:
                for value in batch.column(0):
                    line = (value.as_py() or "").encode() + b"\n"
                    if len(line) > self.max_bytes:
                        raise ValueError(f"a request of {len(line)} bytes exceeds the limit of {self.max_bytes}")
                    if out is not None and (lines == self.max_lines or size + len(line) > self.max_bytes):
                        close()
                        out = None
                    if out is None:
                        if listed is None:
                            store.create_dir(posixpath.join(folder, own), recursive=True)
                            listed = store.open_output_stream(posixpath.join(folder, own, "files"))
                        name, lines, size = posixpath.join(own, f"{files:09d}.jsonl"), 0, 0
                        out = store.open_output_stream(posixpath.join(folder, name))
                        files += 1
                    out.write(line)
                    lines, size = lines + 1, size + len(line)
            if out is not None:
                close()
        finally:
            for stream in (out, listed):
                if stream is not None:
                    stream.close()
        return WrittenFiles(listed and posixpath.join(own, "files"))

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        lists = sorted(m.listed for m in messages if m and m.listed)
        part = posixpath.join(folder, f"_{self.job}")
        with store.open_output_stream(part) as out:
            out.write("".join(json.dumps({"list": name}) + "\n" for name in lists).encode())
        store.move(part, posixpath.join(folder, MANIFEST))

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        """Remove what finished tasks wrote; files of broken ones are in no manifest and stay unseen."""
        store, folder = _store(self.folder)
        for message in messages:
            if message and message.listed:
                store.delete_dir(posixpath.join(folder, posixpath.dirname(message.listed)))


class RequestFiles(DataSource):
    """``df.write.format("request_files")`` with options ``path``, ``maxLines`` and ``maxBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("request files take one text column")
        most = [int(self.options.get(k, 1 << 62)) for k in ("maxLines", "maxBytes")]
        if min(most) < 1:
            raise ValueError("limits of request files are positive")
        return _Writer(self.options["path"], *most, uuid.uuid4().hex)


def write_request_files(
    lines: DataFrame, folder: str, max_lines: int = 50_000, max_bytes: int = 200 << 20
) -> None:
    """Write the only column of ``lines`` as files below a folder and publish their manifest.

    A folder written before gets a new manifest in one step; until then readers see the old files.
    A line that alone exceeds ``max_bytes`` is an error. Null lines are empty ones.
    """
    lines.sparkSession.dataSource.register(RequestFiles)
    writer = lines.write.format(FORMAT).mode("append").option("path", folder)
    writer.option("maxLines", max_lines).option("maxBytes", max_bytes).save()


def request_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``name, lines, bytes`` of the published files of a folder."""
    lists = spark.read.schema("list string").json(f"{folder}/{MANIFEST}")
    paths = [f"{folder}/{r['list']}" for r in lists.collect()]  # one per task that wrote
    if not paths:
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(paths)


def _lines(blocks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The whole lines of each block, the start of one that goes on in the next kept for it."""
    rest: list[bytes] = []
    for block in blocks:
        first, *more = block.split(b"\n")
        if more:
            yield [b"".join([*rest, first]), *more[:-1]]
            rest = [more[-1]]
        else:
            rest.append(first)


def read_request_files(spark: SparkSession, folder: str) -> DataFrame:
    """``value``: the lines of the published files, and of no others.

    Files are dealt over tasks by the bytes that the manifest states, and a task opens its own: their
    paths are neither fetched nor listed by the driver.
    """
    listed = request_manifest(spark, folder)
    total = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, below = _store(folder)
        held, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(below, name)) as file:
                    for some in _lines(iter(lambda: file.read(_BLOCK), b"")):
                        held += some
                        size += sum(map(len, some))
                        if size >= _BLOCK:
                            yield _values(held)
                            held, size = [], 0
        if held:
            yield _values(held)

    return listed.select("name").repartition(total // _SHARE + 1).mapInArrow(lines, "value string")


def _values(lines: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])


def request_files_report(spark: SparkSession, folder: str) -> DataFrame:
    """Published files, lines and bytes, and the most lines and bytes of a file."""
    return request_manifest(spark, folder).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.max("lines").alias("most_lines"),
        F.max("bytes").alias("most_bytes"),
    )
