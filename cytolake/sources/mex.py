"""MatrixMarket matrices as a Spark data source: ranges of bytes are read in parallel, and parts are written in parallel."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cytolake.sources.parts import PartsWriter
from cytolake.sources.stores import Stores

#: Fixed values of the file format: the banner's words.
BANNER = b"%%MatrixMarket"
FIELDS = ("real", "integer", "double", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric")

BLOCK = 4 << 20
SPLIT = 32 << 20
SCHEMA = "cell_id long, gene_id long, value double"
_ARROW = pa.schema([("cell_id", pa.int64()), ("gene_id", pa.int64()), ("value", pa.float64())])


class MatrixError(ValueError):
    """What a matrix file has wrong."""


@dataclass(frozen=True)
class Head:
    """rows, columns and entries that a matrix says it has, how its entries are given, and the byte after its sizes."""

    rows: int
    columns: int
    entries: int
    field: str
    symmetry: str
    end: int


@dataclass
class Range(InputPartition):
    """Lines that begin in start … end - 1 of a file (a compressed one is one range, read from its start)."""

    path: str
    start: int
    end: int
    head: Head
    whole: bool


def head_of(stream: pa.NativeFile, path: str) -> Head:
    """Read a banner, comments and sizes."""
    text, at, banner = b"", 0, None
    while True:
        stop = text.find(b"\n", at)
        if stop < 0:
            more = stream.read(1 << 16)
            if more:
                text += more
                continue
            stop = len(text)
            if at >= stop:
                raise MatrixError(f"{path}: ends before the line of sizes")
        line, at = text[at:stop].strip(), stop + 1
        if banner is None:
            banner = line.lower().split()
            if not line.startswith(BANNER) or len(banner) != 5 or banner[1:3] != [b"matrix", b"coordinate"]:
                raise MatrixError(f"{path}: not a coordinate matrix")
            field, symmetry = banner[3].decode(), banner[4].decode()
            if field not in FIELDS or symmetry not in SYMMETRIES:
                raise MatrixError(f"{path}: {field} {symmetry} can't be read")
        elif line and not line.startswith(b"%"):
            sizes = line.split()
            if len(sizes) != 3 or not all(s.isdigit() for s in sizes):
                raise MatrixError(f"{path}: the line of sizes can't be read")
            return Head(*map(int, sizes), field, symmetry, at)


def entries(text: bytes, head: Head, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column (from 0) and value of whole lines."""
    width = 2 if head.field == "pattern" else 3
    with warnings.catch_warnings():
        warnings.simplefilter("error")  # numpy warns where it stops at something that is no number
        try:
            numbers = np.fromstring(text, np.float64, sep=" ") if text.strip() else np.zeros(0)
        except (DeprecationWarning, ValueError) as error:
            raise MatrixError(f"{path}: an entry can't be read") from error
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begun = np.cumsum(~space & np.append(True, space[:-1]) if len(data) else space)
    each = np.diff(np.append(begun[data == 10], begun[-1:]), prepend=0)  # numbers of each line
    if not np.isin(each, (0, width)).all():
        raise MatrixError(f"{path}: an entry doesn't have {width} numbers")
    table = numbers.reshape(-1, width)
    row, column = table[:, 0].astype(np.int64) - 1, table[:, 1].astype(np.int64) - 1
    if len(row) and (row.min() < 0 or column.min() < 0 or row.max() >= head.rows or column.max() >= head.columns or (table[:, :2] % 1).any()):
        raise MatrixError(f"{path}: an entry lies outside of the matrix")
    value = np.ones(len(row)) if width == 2 else table[:, 2]
    if head.symmetry != "general":
        other = row != column
        sign = -1.0 if head.symmetry == "skew-symmetric" else 1.0
        row, column, value = np.append(row, column[other]), np.append(column, row[other]), np.append(value, sign * value[other])
    return row, column, value


class MexReader(DataSourceReader):
    def __init__(self, path: str, stores: Stores, transposed: bool, split: int):
        self.path, self.stores, self.transposed, self.split = path, stores, transposed, split

    def partitions(self) -> list[Range]:
        """Ranges of all files; the first file has the banner and the sizes, files that follow go on with its entries."""
        store, _ = self.stores.opened(self.path)
        files = self.stores.files(self.path)
        if not files:
            raise MatrixError(f"{self.path}: no file")
        with store.open_input_stream(files[0][0]) as stream:  # a name in .gz is decompressed
            head = head_of(stream, files[0][0])
        out = []
        for i, (file, size) in enumerate(files):
            begin = head.end if i == 0 else 0
            if file.endswith(".gz"):
                out.append(Range(file, begin, 1 << 62, head, True))
            else:
                out += [Range(file, max(begin, at), min(size, at + self.split), head, False) for at in range(0, size, self.split) if at + self.split > begin]
        return out

    def _lines(self, part: Range) -> Iterator[bytes]:
        store, _ = self.stores.opened(self.path)
        if part.whole:
            with store.open_input_stream(part.path) as stream:
                left = part.start
                while left:
                    left -= len(stream.read(min(left, BLOCK)))
                yield from self._cut(stream, 1 << 62)
            return
        with store.open_input_file(part.path) as stream:
            first = part.start == (part.head.end if part.start and part.start == part.head.end else 0)
            if first:
                stream.seek(part.start)
                skipped = 0
            else:  # a line that began before belongs to the range before
                stream.seek(part.start - 1)
                skipped = -1
                while True:
                    block = stream.read(1 << 12)
                    stop = block.find(b"\n")
                    if stop >= 0 or not block:
                        skipped += stop + 1 if stop >= 0 else 0
                        break
                    skipped += len(block)
                stream.seek(part.start + skipped)
            yield from self._cut(stream, part.end - part.start - skipped)

    @staticmethod
    def _cut(stream: pa.NativeFile, left: int) -> Iterator[bytes]:
        """Blocks of whole lines: all lines that begin within the next `left` bytes."""
        held = b""
        while left > 0:
            block = stream.read(min(BLOCK, left))
            if not block:
                break
            left -= len(block)
            held += block
            stop = held.rfind(b"\n") + 1
            if stop:
                yield held[:stop]
                held = held[stop:]
        if held and left <= 0:  # the last line goes on behind the range
            while block := stream.read(1 << 12):
                stop = block.find(b"\n")
                held += block if stop < 0 else block[:stop]
                if stop >= 0:
                    break
        if held:
            yield held

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for text in self._lines(partition):
            row, column, value = entries(text, partition.head, partition.path)
            cell, gene = (row, column) if self.transposed else (column, row)
            keep = value != 0
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(gene[keep]), pa.array(value[keep])], schema=_ARROW)


class MexWriter(PartsWriter):
    """Entries without a head a part; the head, with the number of entries, is written when all parts are there."""

    suffix = ".mtx"

    def __init__(self, path: str, stores: Stores, overwrite: bool, schema: StructType, cells: int, genes: int):
        super().__init__(path, stores, overwrite)
        if sorted(schema.fieldNames()) != ["cell_id", "gene_id", "value"]:
            raise MatrixError("a matrix has the columns cell_id, gene_id and value")
        if not overwrite:
            raise MatrixError("a matrix is written as a whole: mode overwrite")
        self.cells, self.genes = cells, genes

    def fill(self, sink: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> int:
        rows = 0
        for batch in batches:
            gene, cell, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("gene_id", "cell_id", "value"))
            if len(gene) and (min(gene.min(), cell.min()) < 0 or gene.max() >= self.genes or cell.max() >= self.cells):
                raise MatrixError("an id lies outside of the matrix")
            sink.write("".join(f"{g + 1} {c + 1} {v!r}\n" for g, c, v in zip(gene.tolist(), cell.tolist(), value.tolist(), strict=True)).encode())
            rows += batch.num_rows
        return rows

    def head(self, parts: list) -> bytes:
        return b"%%MatrixMarket matrix coordinate real general\n" + f"{self.genes} {self.cells} {sum(p.rows for p in parts)}\n".encode()


class Mex(DataSource):
    """`spark.read.format("mex").load(path)`: cell_id, gene_id, value (not 0) of a matrix of genes by cells.

    path: a file, compressed if its name ends in .gz, or a folder of parts as the writer leaves it.
    Options: transposed (the matrix is cells by genes), splitBytes (bytes of a partition).
    `x.write.format("mex").option("cells", n).option("genes", m).mode("overwrite").save(folder)` writes one.
    """

    stores = Stores()

    @classmethod
    def name(cls) -> str:
        return "mex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MexReader:
        o = self.options
        return MexReader(o["path"], self.stores, o.get("transposed", "false").lower() == "true", int(o.get("splitBytes", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> MexWriter:
        return MexWriter(self.options["path"], self.stores, overwrite, schema, int(self.options["cells"]), int(self.options["genes"]))
