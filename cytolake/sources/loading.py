"""From a folder of files, in any store, to datasets: heads, kinds, units, and a reader for each format.

Heads are read in the tasks, a few kilobytes a file; what they say is decided by expressions
over them.  Files that share a name up to their role are one unit; a unit that isn't
complete is refused, with what is missing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.sources import files
from cytolake.sources.mex import Mex
from cytolake.sources.parts import ArrowParts, registered
from cytolake.sources.stores import Stores, of_session

# What a head begins with, how much of it is read, names that say what a file is, and the shares that decide.
HDF5_MAGIC = b"\x89HDF\r\n\x1a\n"
GZIP_MAGIC = b"\x1f\x8b"
HEAD_BYTES = 32 << 10
HEAD_CHARS = 8192
NAME_HINTS = [("barcode", "barcodes"), ("feature", "features"), ("genes", "features"), ("matrix.mtx", "matrix")]
BARCODE_SHARE, GENE_SHARE, ENSEMBL_SHARE = 0.6, 0.6, 0.5
R_NAMES = [".rds", ".rdata", ".rda"]
ZARR_FILES = [".zgroup", ".zattrs", "zarr.json"]


class LoadError(ValueError):
    """Why a unit can't be read."""


def _text(data: bytes) -> tuple[bool, str | None]:
    """Whether bytes are compressed, and the text that they begin with (none: no text)."""
    zipped = data.startswith(GZIP_MAGIC)
    try:
        if zipped:
            data = zlib.decompressobj(31).decompress(data, 4 * HEAD_CHARS)
        cut = data[: 4 * HEAD_CHARS]
        text = cut.decode("utf-8", "strict") if len(cut) < 4 else (cut[:-4].decode() + cut[-4:].decode("utf-8", "ignore") if len(data) >= 4 * HEAD_CHARS else cut.decode())
    except (UnicodeDecodeError, zlib.error):
        return zipped, None
    return zipped, text[:HEAD_CHARS]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of what lies in a folder: files, folders of parts and folders of stores."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath().toString(), f.getPath().getName()) for f in store.listStatus(hadoop) if not f.getPath().getName().startswith(("_", "."))]
    return spark.createDataFrame(found, "path string, name string")


def heads(paths: DataFrame, stores: Stores) -> DataFrame:
    """`paths` (path, name) with there, folder, zarr, magic (the first 8 bytes, hexadecimal), zipped and text: what each begins with.

    A folder of parts begins as its first part does; text is null where the bytes are no text, or nothing can be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                row = {"there": False, "folder": False, "zarr": False, "magic": "", "zipped": False, "text": None}
                try:
                    store, where = stores.opened(path)
                    info = store.get_file_info(where)
                    row["there"] = info.type != arrow_fs.FileType.NotFound
                    row["folder"] = info.type == arrow_fs.FileType.Directory
                    parts = stores.files(path) if row["folder"] else [(where, info.size)]
                    row["zarr"] = row["folder"] and (where.endswith(".zarr") or any(i.type == arrow_fs.FileType.File for i in store.get_file_info([f"{where}/{z}" for z in ZARR_FILES])))
                    if row["there"] and parts and not row["zarr"]:
                        with store.open_input_stream(parts[0][0], compression=None) as stream:
                            data = stream.read(HEAD_BYTES)
                        row["magic"] = data[:8].hex()
                        row["zipped"], row["text"] = _text(data)
                except OSError:
                    pass  # unreadable: no head
                rows.append(row)
            made = pa.Table.from_pylist(rows, pa.schema([("there", pa.bool_()), ("folder", pa.bool_()), ("zarr", pa.bool_()), ("magic", pa.string()), ("zipped", pa.bool_()), ("text", pa.string())]))
            yield from pa.table([batch.column("path"), batch.column("name"), *made.columns], names=["path", "name", *made.column_names]).combine_chunks().to_batches()

    return paths.select("path", "name").mapInArrow(run, "path string, name string, there boolean, folder boolean, zarr boolean, magic string, zipped boolean, text string")


def _share(values: Column, matches: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(values, matches)), F.size(values)), F.lit(0.0))


def classified(found: DataFrame) -> DataFrame:
    """path, name, kind, confidence, hint of heads: their content decides, the name agrees, helps or conflicts."""
    small = F.lower("name")
    lines = F.filter(F.split(F.ltrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), "\r\n|[\r\n]"), lambda x: F.trim(x) != "")
    rows = found.withColumns({"_small": small, "_lines": lines})
    probe = F.coalesce(F.get("_lines", F.lit(1)), F.get("_lines", F.lit(0)))
    tabs, commas = (F.length(probe) - F.length(F.replace(probe, F.lit(c), F.lit(""))) for c in ("\t", ","))
    words = F.size(F.split(F.trim(probe), "\\s+"))
    rows = rows.withColumn("_by", F.when((tabs == 0) & (commas == 0), F.when(words > 1, "\\s+").otherwise("\t")).when(tabs >= commas, "\t").otherwise(","))
    rows = rows.withColumn("_wide", F.when(F.col("_by") == "\\s+", words).when(F.col("_by") == "\t", tabs + 1).otherwise(commas + 1))
    first = F.filter(F.transform(F.slice("_lines", 1, 10), lambda x: F.trim(F.get(F.split(F.when(F.col("_by") == "\\s+", F.trim(x)).otherwise(x), F.col("_by")), F.lit(0)))), lambda x: x != "")
    rows = rows.withColumn("_first", first)
    barcodes = _share(F.col("_first"), lambda x: x.rlike("(?i)" + files.BARCODE.pattern))
    ensembl = _share(F.col("_first"), lambda x: x.rlike("(?i)" + files.ENSEMBL.pattern))
    genes = _share(F.col("_first"), lambda x: x.rlike(files.GENE.pattern) & ~x.rlike("^[0-9]+$"))
    said = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    of_text = (
        F.when(F.col("text").isNull(), said("unknown", 0.0))
        .when(F.startswith(F.ltrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit("%%MatrixMarket")), said("matrix", 0.97))
        .when(F.size("_lines") == 0, said("unknown", 0.0))
        .when((F.col("_wide") == 1) & (barcodes >= BARCODE_SHARE), said("barcodes", 0.85))
        .when((F.col("_wide") == 1) & (genes >= GENE_SHARE), said("features", 0.5))
        .when((F.col("_by") == "\t") & F.col("_wide").between(2, 3) & ((ensembl >= ENSEMBL_SHARE) | (genes >= GENE_SHARE)), said("features", 0.85))
        .when(F.col("_wide") > 3, said("dense", 0.7))
        .otherwise(said("unknown", 0.2))
    )
    hint = F.lit(None).cast("string")
    for word, kind in reversed(NAME_HINTS):
        hint = F.when(F.contains("_small", F.lit(word)), F.lit(kind)).otherwise(hint)
    fixed = (
        F.when(~F.col("there"), said("missing", 0.0))
        .when(F.col("zarr"), said("zarr", 0.9))
        .when(F.col("folder") & (F.col("magic") == ""), said("unknown", 0.0))
        .when(F.exists(F.array(*map(F.lit, R_NAMES)), lambda x: F.endswith("_small", x)), said("seurat", 0.7))
        .when(F.col("magic") == HDF5_MAGIC.hex(), said("hdf5", 0.2))
    )
    rows = rows.withColumns({"_fixed": fixed, "_text": of_text, "_hint": hint})
    agrees = F.col("_text.kind") == F.col("_hint")
    helps = (F.col("_text.kind") == "unknown") & F.col("_hint").isNotNull()
    kind = F.when(helps, F.col("_hint")).otherwise(F.col("_text.kind"))
    confidence = F.when(agrees, F.least(F.lit(1.0), F.col("_text.confidence") + 0.1)).when(helps, F.lit(0.4)).otherwise(F.col("_text.confidence"))
    said_by_name = F.when(agrees, "agrees").when(helps, "applied").when(F.col("_hint").isNotNull(), "conflicts")
    own = F.col("_fixed").isNotNull()
    return rows.select(
        "path", "name", F.when(own, F.col("_fixed.kind")).otherwise(kind).alias("kind"),
        F.round(F.when(own, F.col("_fixed.confidence")).otherwise(confidence), 4).alias("confidence"), F.when(~own, said_by_name).alias("hint"),
    )


def detected(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind, confidence, hint of all files in a folder."""
    return classified(heads(listed(spark, folder), of_session(spark)))


#: A unit's format by the kind of its one file.
SINGLE = {"dense": "dense", "hdf5": "hdf5", "zarr": "zarr", "seurat": "seurat"}


def units(found: DataFrame) -> DataFrame:
    """sample, format, complete, missing, repeated, paths (role to path; a file alone has the role file) of detected files.

    A matrix, its barcodes and its features belong together by what stands before their role in their names, or in the
    absence of a name, by their folder; what kind they are is what their content says.
    """
    role = F.when(F.col("kind").isin("matrix", "barcodes", "features"), F.col("kind"))
    stem = F.regexp_replace("name", r"(\.(gz|mtx|tsv|csv|txt|h5|h5ad|loom|zarr|rds))+$", "")
    sample = F.when(role.isNotNull(), F.regexp_replace(stem, rf"(?i)[._-]?{files.ROLE}$", "")).otherwise(stem)
    rows = found.select(sample.alias("sample"), F.coalesce(role, F.lit("file")).alias("role"), "kind", "path")
    each = rows.filter("role <> 'file'").groupBy("sample", "role").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    triples = each.groupBy("sample").agg(F.collect_list("role").alias("_roles"), F.collect_list(F.when(F.col("n") > 1, F.col("role"))).alias("_twice"), F.map_from_entries(F.collect_list(F.struct("role", "path"))).alias("paths"))
    missing = F.array_except(F.array(*map(F.lit, ("barcodes", "features", "matrix"))), F.col("_roles"))
    repeated = F.array_sort("_twice")
    mex = triples.select("sample", F.lit("mex").alias("format"), ((F.size(missing) == 0) & (F.size(repeated) == 0)).alias("complete"), missing.alias("missing"), repeated.alias("repeated"), "paths")
    known = F.create_map(*(F.lit(x) for pair in SINGLE.items() for x in pair))
    none = F.array().cast("array<string>")
    single = rows.filter("role = 'file'").select(
        "sample", F.coalesce(F.element_at(known, F.col("kind")), F.lit("unknown")).alias("format"), F.lit(True).alias("complete"), none.alias("missing"), none.alias("repeated"), F.create_map("role", "path").alias("paths")
    )
    return mex.unionByName(single)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of a text file or a folder of parts in the order of their names, however Spark deals the files out."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block of a file
    return rows.join(F.broadcast(blocks.withColumn("_before", before)), ["_file", "_at"]).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def _names(spark: SparkSession, path: str) -> DataFrame:
    """id (by the lines with something in them), value."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.withColumnRenamed("line", "id")


def _mex(spark: SparkSession, paths: dict[str, str], options: dict) -> Dataset:
    reader = spark.read.format("mex").option("transposed", str(options.get("transposed", False)).lower())
    x = reader.load(paths["matrix"])
    obs = _names(spark, paths["barcodes"]).select(F.col("id").alias("cell_id"), F.trim("value").alias("name"))
    parts = F.split("value", "\t")
    var = _names(spark, paths["features"]).select(
        F.col("id").alias("gene_id"), parts[0].alias("gene_ids"), F.coalesce(F.get(parts, F.lit(1)), parts[0]).alias("name"), F.coalesce(F.get(parts, F.lit(2)), F.lit("Gene Expression")).alias("feature_type")
    )
    return Dataset(_unique(obs, "cell_id", "cell_name"), _unique(var, "gene_id", "gene"), x)


def _unique(names: DataFrame, key: str, name: str) -> DataFrame:
    return names.withColumn(name, files.unique_names(F.col("name"), F.col(key))).drop("name")


def _dense(spark: SparkSession, paths: dict[str, str], options: dict) -> Dataset:
    return Dataset(*files.read_dense(spark, paths["file"], options.get("genes_in_rows", True)))


#: A reader for each format of a unit.
LOADERS: dict[str, Callable[[SparkSession, dict[str, str], dict], Dataset]] = {"mex": _mex, "dense": _dense}


def load_unit(spark: SparkSession, unit, options: dict | None = None) -> Dataset:
    """The dataset of a unit (a row of `units`).  A unit that isn't complete, or of a format without reader, is a LoadError."""
    if not unit["complete"]:
        lacks = [f"no {r}" for r in unit["missing"]] + [f"{r} twice" for r in unit["repeated"]]
        raise LoadError(f"unit {unit['sample']!r} is not complete: {', '.join(lacks)}")
    loader = LOADERS.get(unit["format"])
    if loader is None:
        raise LoadError(f"no reader for unit {unit['sample']!r} of format {unit['format']}")
    registered(spark, Mex, ArrowParts)
    return loader(spark, dict(unit["paths"]), options or {})
