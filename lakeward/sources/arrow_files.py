"""Folders of Arrow IPC files as a data source: ``format("arrow_files")``.

Every task writes one file below ``_temporary/<job>``. The commit moves the files
that the successful attempt of each task reported into the folder; an abort deletes
what the job wrote. So a task that fails and runs again leaves no second copy, and
readers, who look at the folder itself only, see nothing of a job that failed. A task
that is still running when its job is aborted can leave a file below ``_temporary``.
What reaches the driver is a name and a row count per file.

The folder is reached through ``pyarrow.fs``: a shared path, or a URI of a store
that it knows. Moves are renames where the store has them. An overwrite deletes the
older files after the new ones are in place; a reader that lists the folder in
between sees both.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "arrow_files"
CHUNK_ROWS = 10_000
_SUFFIX = ".arrow"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def _names(store: fs.FileSystem, root: str) -> list[str]:
    """Committed files of a folder, none where it does not exist."""
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(_SUFFIX))


@dataclass
class WrittenFile(WriterCommitMessage):
    """What a task tells the driver; no name where it had no rows."""

    name: str | None
    rows: int


class ArrowFilesWriter(DataSourceArrowWriter):
    """One file per task, visible from the commit on."""

    def __init__(self, path: str, chunk_rows: int, overwrite: bool):
        self.path, self.chunk_rows, self.overwrite = path, chunk_rows, overwrite
        self.job = uuid.uuid4().hex

    def _held(self, root: str) -> str:
        return f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        # An attempt has a name of its own: one that still runs cannot write into another's file.
        name = f"part-{number:05d}-{uuid.uuid4().hex}{_SUFFIX}"
        store, root = _folder(self.path)
        rows, sink, writer = 0, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    store.create_dir(self._held(root), recursive=True)
                    sink = store.open_output_stream(f"{self._held(root)}/{name}")
                    writer = pa.ipc.new_file(sink, batch.schema)
                for at in range(0, batch.num_rows, self.chunk_rows):
                    writer.write_batch(batch.slice(at, self.chunk_rows))
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
            if sink is not None:
                sink.close()
        return WrittenFile(name if rows else None, rows)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        older = _names(store, root) if self.overwrite else []
        for message in messages:
            if message is not None and message.name:
                store.move(f"{self._held(root)}/{message.name}", f"{root}/{message.name}")
        for name in older:
            store.delete_file(f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[WrittenFile | None]) -> None:
        self._clear(*_folder(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """Drop what failed attempts left, and the job's folder."""
        if store.get_file_info(self._held(root)).type == fs.FileType.Directory:
            store.delete_dir(self._held(root))


class OneFile(InputPartition):
    """A committed file; read by one task."""

    def __init__(self, name: str):
        super().__init__(name)


class ArrowFilesReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[OneFile]:
        return [OneFile(name) for name in _names(*_folder(self.path))]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files has one partition, which is none
            return
        store, root = _folder(self.path)
        with store.open_input_file(f"{root}/{partition.value}") as source, pa.ipc.open_file(source) as file:
            for k in range(file.num_record_batches):
                yield file.get_batch(k).select(self.columns)


class ArrowFiles(DataSource):
    """Options: ``path``, and for writes ``chunk_rows``, the rows of a batch at most."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError(f"{FORMAT} needs a path")
        return self.options["path"]

    def schema(self) -> StructType:
        """That of the first file; name one yourself to read a folder that may be empty."""
        store, root = _folder(self._path())
        names = _names(store, root)
        if not names:
            raise ValueError(f"{self._path()} holds no files: give the schema")
        with store.open_input_file(f"{root}/{names[0]}") as source, pa.ipc.open_file(source) as file:
            return from_arrow_schema(file.schema)

    def reader(self, schema: StructType) -> ArrowFilesReader:
        return ArrowFilesReader(self._path(), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowFilesWriter:
        chunk = int(self.options.get("chunk_rows", CHUNK_ROWS))
        if chunk < 1:
            raise ValueError("chunk_rows must be positive")
        return ArrowFilesWriter(self._path(), chunk, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its code goes to the workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArrowFiles)


def write(df: DataFrame, path: str, mode: str = "append", chunk_rows: int = CHUNK_ROWS) -> None:
    """Write the rows of a frame as Arrow files, ``append`` or ``overwrite``."""
    register(df.sparkSession)
    df.write.format(FORMAT).mode(mode).option("chunk_rows", chunk_rows).save(path)


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The committed rows of a folder; columns that ``schema`` leaves out are not decoded for Spark."""
    register(spark)
    reader = spark.read.format(FORMAT)
    return (reader.schema(schema) if schema is not None else reader).load(path)
