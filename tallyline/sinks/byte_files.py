"""Write records as bytes, one file a task, through Spark's data source interface."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from tallyline.errors import ConfigError
from tallyline.sinks.writers import write_mode
from tallyline.sources.variable import DESCRIPTOR, LONGEST

FORMAT = "tallyline_bytes"


@dataclass
class _Written(WriterCommitMessage):
    """A part file that a task has closed: where it lies, what it is to be called, and its bytes."""

    staged: str
    name: str
    size: int


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the place in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer(DataSourceArrowWriter):
    """Tasks write below a folder of this write's own; only the commit moves files to where readers look.

    A task that is run again writes another file, and only the file of the attempt that Spark accepted is moved.
    Parts are numbered by task, so their names' order is that of the rows.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.run = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}"
        staged = f"{self.staging}/{name}-{context.taskAttemptId()}"
        system, place = _at(staged)
        system.create_dir(posixpath.dirname(place), recursive=True)
        size = 0
        with system.open_output_stream(place, compression=None) as out:
            for batch in iterator:
                for record in batch.column(0).to_pylist():
                    if record is None:
                        raise ConfigError("a record of bytes must not be NULL")
                    size += len(record)
                    out.write(record)
        return _Written(staged, name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _at(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file]
        for m in messages:
            if m is not None and m.size:
                system.move(_at(m.staged)[1], f"{folder}/{m.name}")
        if self.overwrite:
            for path in old:
                system.delete_file(path)
        self._clear()
        system.open_output_stream(f"{folder}/_SUCCESS", compression=None).close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, place = _at(self.staging)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class ByteFiles(DataSource):
    """A sink for one binary column; option ``path`` is a folder that executors reach by pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, BinaryType):
            raise ConfigError("byte files take one binary column")
        return _Writer(self.options["path"], overwrite)


def with_descriptor(record: Column) -> Column:
    """A record behind its descriptor word; one too long for it is an error."""
    length = F.octet_length(record) + DESCRIPTOR
    word = F.unhex(F.concat(F.lpad(F.hex(length), 4, "0"), F.lit("0000")))
    too_long = F.raise_error(F.concat(F.lit(f"a record of more than {LONGEST - DESCRIPTOR} bytes: "), length.cast("string")))
    return F.when(length <= LONGEST, F.concat(word, record)).otherwise(too_long.cast("binary"))


def write_bytes(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the one binary column of a frame: part files whose names follow the order of the rows.

    Nothing but whole files of a finished write is ever found under names that do not begin with an underscore.
    """
    frame.sparkSession.dataSource.register(ByteFiles)
    frame.write.format(FORMAT).mode(write_mode(mode)).save(path)
