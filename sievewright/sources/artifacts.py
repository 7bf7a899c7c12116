"""JSON artifacts as a data source: an array that people read, written by many tasks and committed as one file.

``spark.dataSource.register(JsonArtifact)``, then ``df.write.format("json_artifact").mode("overwrite").save(path)``.
:func:`sievewright.sources.readers.json_artifact` reads it back. With the option ``part_bytes`` an artifact of any size is
a folder of such files, which :func:`sievewright.sources.readers.json_parts` reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ready

#: The list of a folder's files that count.
LISTED = "files.json"


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place, its file, its rows and bytes."""

    partition: int
    path: str
    rows: int
    size: int


@dataclass
class Files(WriterCommitMessage):
    """What a task wrote into a folder: its place, its files in their order, its rows."""

    partition: int
    names: list[str]
    rows: int


def plain(value):
    """A value as JSON has it: rows as objects, dates in ISO form, decimals as numbers, bytes as text."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict(recursive=False).items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value.decode("utf-8", "replace") if isinstance(value, (bytes, bytearray)) else value


class ArtifactWriter(DataSourceWriter):
    """Tasks write their rows beside the artifact, under names of their attempts; the commit joins the parts of those that count.

    Parts are joined in the order of their partitions as streams, so nobody holds an artifact. It replaces an earlier one
    by a rename once it is whole; a write that fails leaves that as it was, and its parts are deleted.
    """

    def __init__(self, path: str, names: list[str], overwrite: bool, most_bytes: int):
        self.path, self.names, self.overwrite, self.most_bytes = path, names, overwrite, most_bytes

    def _at(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def _raw(self, row: Row) -> bytes:
        """A row as it stands in the array, without what is between rows."""
        text = json.dumps({k: plain(v) for k, v in zip(self.names, row, strict=True)}, ensure_ascii=False, indent=2)
        return "\n".join("  " + line for line in text.split("\n")).encode()

    @staticmethod
    def _task() -> tuple[int, int]:
        from pyspark import TaskContext

        task = TaskContext.get()
        return (task.partitionId(), task.taskAttemptId()) if task else (0, 0)

    def write(self, iterator: Iterator[Row]) -> Part:
        number, attempt = self._task()
        path, rows, size = f"{self.path}.parts/{number:06d}-{attempt}", 0, 0
        system, name = self._at(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name, compression=None) as f:
            for row in iterator:
                raw = (b",\n" if rows else b"") + self._raw(row)
                f.write(raw)
                rows, size = rows + 1, size + len(raw)
        return Part(number, path, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        system, name = self._at(self.path)
        try:
            if sum(p.size for p in parts) > self.most_bytes:
                raise ValueError(f"an artifact of more than {self.most_bytes} bytes is not one that people read: use write_parts or write_json")
            if not self.overwrite and system.get_file_info(name).type != fs.FileType.NotFound:
                raise FileExistsError(self.path)
            system.create_dir(name.rpartition("/")[0] or ".", recursive=True)
            with system.open_output_stream(f"{name}.whole", compression=None) as out:
                out.write(b"[")
                for k, part in enumerate(parts):
                    out.write(b",\n" if k else b"\n")
                    source, at = self._at(part.path)
                    with source.open_input_stream(at) as f:
                        while chunk := f.read(1 << 20):
                            out.write(chunk)
                out.write(b"\n]\n" if parts else b"]\n")
            system.move(f"{name}.whole", name)
        finally:
            self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, name = self._at(f"{self.path}.parts")
        if system.get_file_info(name).type == fs.FileType.Directory:
            system.delete_dir(name)


class PartsWriter(ArtifactWriter):
    """Tasks write files of about ``part_bytes``, each an array of its own, under names of their attempts; the commit lists those that count.

    No row goes through the commit, and a reader holds one file at most. The list replaces an earlier one by a rename, after
    which files that it does not name are deleted; a write that fails leaves the earlier list and its files as they were.
    """

    def __init__(self, path: str, names: list[str], overwrite: bool, part_bytes: int):
        super().__init__(path, names, overwrite, 0)
        self.part_bytes, self.mark = part_bytes, uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Files:
        number, attempt = self._task()
        system, folder = self._at(self.path)
        system.create_dir(folder, recursive=True)
        names, rows, size, out = [], 0, 0, None
        try:
            for row in iterator:
                raw = self._raw(row)
                if out is not None and size + len(raw) > self.part_bytes:
                    out.write(b"\n]\n")
                    out.close()
                    out = None
                if out is None:
                    names.append(f"{number:06d}-{len(names):06d}-{attempt}-{self.mark}.json")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                out.write((b",\n" if size else b"[\n") + raw)
                rows, size = rows + 1, size + len(raw)
            if out is not None:
                out.write(b"\n]\n")
        finally:
            if out is not None:
                out.close()
        return Files(number, names, rows)

    def commit(self, messages: list[Files | None]) -> None:
        told = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        names = [n for m in told for n in m.names]
        system, folder = self._at(self.path)
        try:
            if not self.overwrite and system.get_file_info(f"{folder}/{LISTED}").type != fs.FileType.NotFound:
                raise FileExistsError(self.path)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{self.mark}.list", compression=None) as out:
                out.write(json.dumps({"rows": sum(m.rows for m in told), "files": names}, indent=2).encode())
            system.move(f"{folder}/{self.mark}.list", f"{folder}/{LISTED}")
        except BaseException:
            self._clear()
            raise
        self._delete(lambda n: n.endswith(".json") and n != LISTED, set(names))

    def _clear(self) -> None:
        self._delete(lambda n: self.mark in n, set())

    def _delete(self, ours: Callable[[str], bool], kept: set[str]) -> None:
        system, folder = self._at(self.path)
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.type == fs.FileType.File and ours(f.base_name) and f.base_name not in kept:
                system.delete_file(f.path)


class JsonArtifact(DataSource):
    """Options: ``path``; ``most_bytes`` (1 GB), above which an artifact is refused; ``part_bytes``, for a folder of files of about that size."""

    @classmethod
    def name(cls) -> str:
        return "json_artifact"

    def schema(self) -> str:
        raise ValueError("an artifact is read with a schema: see readers.json_artifact")

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        if "part_bytes" in self.options:
            return PartsWriter(self.options["path"], schema.names, overwrite, int(self.options["part_bytes"]))
        return ArtifactWriter(self.options["path"], schema.names, overwrite, int(self.options.get("most_bytes", 1 << 30)))


def write_artifact(df: DataFrame, path: str, overwrite: bool = True, most_bytes: int = 1 << 30) -> None:
    """One file: a JSON array of ``df``'s rows in the order of its partitions, indented, UTF-8 as it is, nulls kept."""
    spark: SparkSession = ready(df.sparkSession)
    spark.dataSource.register(JsonArtifact)
    df.write.format("json_artifact").option("path", path).option("most_bytes", str(most_bytes)).mode("overwrite" if overwrite else "append").save()


def write_parts(df: DataFrame, path: str, overwrite: bool = True, part_bytes: int = 16 << 20) -> None:
    """A folder of numbered files as :func:`write_artifact` writes them, of about ``part_bytes`` each, and their list: rows of any number."""
    spark: SparkSession = ready(df.sparkSession)
    spark.dataSource.register(JsonArtifact)
    df.write.format("json_artifact").option("path", path).option("part_bytes", str(part_bytes)).mode("overwrite" if overwrite else "append").save()
