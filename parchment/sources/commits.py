"""A table of JSON Lines to which each write is one commit: all of its rows or none, once.

Tasks write files of their own name, so that attempts never meet. A commit is one manifest: the files of the table after
it. Manifests are numbered and created only if their number is new, so that of two writers at once one has to try again.
Files that no manifest names are no rows: what failed, killed or speculative attempts left. A write with a batch name that
a manifest holds already is dropped, so that a job, or a stream's batch, which is run again adds nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, MANIFESTS, FILES = "committed_lines", "_manifests", "data"


@dataclass
class Written(WriterCommitMessage):
    """The files of a task's attempt, with their rows."""

    files: list[tuple[str, int]] = field(default_factory=list)


class Table:
    """Files and manifests under a folder, by pyarrow's file systems."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.at = self.at.rstrip("/")

    def manifests(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.at}/{MANIFESTS}", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """A manifest, the last one unless a number is given; an empty one before the first commit."""
        number = max(self.manifests(), default=0) if number is None else number
        if not number:
            return {"number": 0, "files": [], "batches": []}
        with self.fs.open_input_stream(f"{self.at}/{MANIFESTS}/{number:010d}") as f:
            return json.loads(f.read())

    def commit(self, messages: list[WriterCommitMessage | None], batch: str | None, overwrite: bool) -> bool:
        """Adds the files of messages, or replaces all by them; False if the batch was committed before."""
        files = [list(x) for m in messages if m for x in m.files]
        while True:
            last = self.manifest()
            if batch is not None and batch in last["batches"]:
                self.remove(messages)
                return False
            now = {"number": last["number"] + 1, "files": files if overwrite else last["files"] + files, "batches": last["batches"] + ([batch] if batch is not None else [])}
            if self._create(now):
                return True

    def _create(self, manifest: dict) -> bool:
        """Writes a manifest unless its number is taken: as a whole under another name, then linked or moved in place."""
        self.fs.create_dir(f"{self.at}/{MANIFESTS}", recursive=True)
        name = f"{self.at}/{MANIFESTS}/{manifest['number']:010d}"
        draft = f"{self.at}/{MANIFESTS}/draft-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        try:
            if self.fs.type_name == "local":
                import os

                os.link(draft, name)  # fails where the name exists
            elif self.manifest_exists(name):
                return False
            else:
                self.fs.move(draft, name)
            return True
        except FileExistsError:
            return False
        finally:
            if self.manifest_exists(draft):
                self.fs.delete_file(draft)

    def manifest_exists(self, name: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(name).type != fs.FileType.NotFound

    def remove(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for name, _ in m.files if m else []:
                if self.manifest_exists(f"{self.at}/{FILES}/{name}"):
                    self.fs.delete_file(f"{self.at}/{FILES}/{name}")


class _Tasks:
    """What a task does: its rows, one column of lines, go to a file of its attempt's own name."""

    def __init__(self, path: str, batch: str | None, overwrite: bool):
        self.path, self.batch, self.overwrite = path, batch, overwrite

    def write(self, iterator) -> Written:
        import pyarrow as pa

        table, name, rows, out = Table(self.path), f"{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    table.fs.create_dir(f"{table.at}/{FILES}", recursive=True)
                    out = table.fs.open_output_stream(f"{table.at}/{FILES}/{name}")
                column = batch.column(0)
                column = column.cast(pa.large_string()) if isinstance(column, pa.Array) else column.combine_chunks().cast(pa.large_string())
                out.write(("\n".join(column.to_pylist()) + "\n").encode())
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written([(name, rows)] if rows else [])


class _BatchWriter(_Tasks, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        Table(self.path).commit(messages, self.batch, self.overwrite)

    def abort(self, messages) -> None:
        Table(self.path).remove(messages)


class _StreamWriter(_Tasks, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        Table(self.path).commit(messages, f"{self.batch or 'stream'}-{batchId}", False)

    def abort(self, messages, batchId: int) -> None:
        Table(self.path).remove(messages)


class CommittedLines(DataSource):
    """Format `committed_lines`: a sink of one string column. Options: path, and batch, the name of a write that counts once;
    of a stream, whose batches have numbers, the stream's name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _BatchWriter:
        return _BatchWriter(self.options["path"], self.options.get("batch"), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"], self.options.get("batch"), overwrite)


def _lines(df: DataFrame) -> DataFrame:
    df.sparkSession.dataSource.register(CommittedLines)
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def append(df: DataFrame, path: str, batch: str | None = None) -> int:
    """Adds df's rows to a table in one commit; how many. With a batch name that was committed before, none and 0."""
    before = Table(path).manifest()
    writer = _lines(df).write.format(FORMAT).mode("append").option("path", path)
    (writer.option("batch", batch) if batch is not None else writer).save()
    return _count(Table(path).manifest()) - _count(before)


def overwrite(df: DataFrame, path: str) -> int:
    """Replaces a table's rows in one commit; how many. Readers see the old ones or the new ones."""
    _lines(df).write.format(FORMAT).mode("overwrite").option("path", path).save()
    return _count(Table(path).manifest())


def _count(manifest: dict) -> int:
    return sum(n for _, n in manifest["files"])


def read(spark: SparkSession, path: str, schema: StructType, number: int | None = None) -> DataFrame:
    """The rows of a table's last commit, or of an earlier one, by Spark's own reader."""
    files = [f"{path.rstrip('/')}/{FILES}/{name}" for name, _ in Table(path).manifest(number)["files"]]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(files) if files else spark.createDataFrame([], schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """Adds a stream's rows, each batch as one commit that counts once however often it is run."""
    return _lines(stream).writeStream.format(FORMAT).option("path", path).option("batch", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(path: str, keep: int = 1) -> int:
    """Deletes manifests but the last `keep`, and files that none of these names; how many files. Not beside a running write,
    whose files no manifest names yet."""
    from pyarrow import fs

    table = Table(path)
    numbers = table.manifests()
    for n in numbers[:-keep]:
        table.fs.delete_file(f"{table.at}/{MANIFESTS}/{n:010d}")
    named = {name for n in numbers[-keep:] for name, _ in table.manifest(n)["files"]}
    found = table.fs.get_file_info(fs.FileSelector(f"{table.at}/{FILES}", allow_not_found=True))
    stray = [f.path for f in found if f.base_name not in named]
    for p in stray:
        table.fs.delete_file(p)
    return len(stray)
