"""Results as folders of parts, written by the tasks: nothing passes through the driver but names and counts.

Every task writes a part of its own in a staging folder below the target.  When all
are done the driver moves the parts of the tasks that succeeded into place, in the
order of the partitions, and then writes `_SUCCESS`; a failed job's staging folder is removed.  A task
that is lost and done again, or done twice, leaves a file that no commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from cytolake.sources.stores import Stores, of_session


@dataclass
class Part(WriterCommitMessage):
    """What a task has written; a part without rows isn't kept."""

    partition: int
    path: str
    rows: int


class PartsWriter(DataSourceArrowWriter):
    """Staging, commit and abort; a subclass writes one part's rows in `fill`."""

    suffix = ""

    def __init__(self, path: str, stores: Stores, overwrite: bool):
        self.path, self.stores, self.overwrite = path, stores, overwrite
        self.staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def fill(self, sink: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
        """Write all rows, and say how many there were."""
        raise NotImplementedError

    def head(self, parts: list[Part]) -> bytes | None:
        """What goes before the first part, in a file of its own."""
        return None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        partition = TaskContext.get().partitionId()
        store, folder = self.stores.opened(self.staging)
        store.create_dir(folder, recursive=True)
        where = f"{folder}/{partition}-{uuid.uuid4().hex}"
        with store.open_output_stream(where) as sink:
            rows = self.fill(sink, iterator)
        return Part(partition, where, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        store, folder = self.stores.opened(self.path)
        store.create_dir(folder, recursive=True)
        old = [f for f, _ in self.stores.files(self.path)]
        if self.overwrite:
            for file in old:
                store.delete_file(file)
            old = []
        job = uuid.uuid4().hex[:12]
        head = self.head(parts)
        if head is not None:
            with store.open_output_stream(f"{folder}/part-{len(old):05d}-{job}-head{self.suffix}") as sink:
                sink.write(head)
        for i, part in enumerate(parts):
            store.move(part.path, f"{folder}/part-{len(old) + i + (head is not None):05d}-{job}{self.suffix}")
        self._clear()
        with store.open_output_stream(f"{folder}/_SUCCESS") as sink:
            sink.write(json.dumps({"job": job, "parts": len(parts), "rows": sum(p.rows for p in parts)}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = self.stores.opened(self.staging)
        if store.get_file_info(folder).type == arrow_fs.FileType.Directory:
            store.delete_dir(folder)


class ArrowWriter(PartsWriter):
    """Each part is an Arrow IPC stream."""

    suffix = ".arrows"

    def fill(self, sink: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
        rows, out = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or pa.ipc.new_stream(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return rows


@dataclass
class FilePart(InputPartition):
    path: str


class ArrowReader(DataSourceReader):
    """A partition a part; a part is read batch by batch."""

    def __init__(self, path: str, stores: Stores, schema: StructType):
        self.path, self.stores, self.names = path, stores, schema.fieldNames()

    def partitions(self) -> list[FilePart]:
        return [FilePart(file) for file, _ in self.stores.files(self.path)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        store, _ = self.stores.opened(self.path)
        with store.open_input_stream(partition.path) as source, pa.ipc.open_stream(source) as batches:
            for batch in batches:
                yield batch.select(self.names)


class ArrowParts(DataSource):
    """`spark.read.format("arrow_parts").load(folder)` and `df.write.format("arrow_parts").mode("append" | "overwrite").save(folder)`.

    The columns are those of the first part; a folder without parts needs a schema.
    """

    stores = Stores()

    @classmethod
    def name(cls) -> str:
        return "arrow_parts"

    def schema(self) -> StructType:
        files = self.stores.files(self.options["path"])
        if not files:
            raise ValueError("a folder without parts has no columns: give a schema")
        store, _ = self.stores.opened(self.options["path"])
        with store.open_input_stream(files[0][0]) as source, pa.ipc.open_stream(source) as batches:
            return from_arrow_schema(batches.schema)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], self.stores, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], self.stores, overwrite)


def registered(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Register data sources for this session, with what it knows about paths."""
    known = of_session(spark)
    for source in sources:
        bound = type(source.__name__, (source,), {"stores": known, "__module__": "__main__"})  # goes to the workers by value
        spark.dataSource.register(bound)
