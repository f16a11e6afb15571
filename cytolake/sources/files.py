"""Single-cell files: what a file is, and reading text matrices as DataFrames."""

from __future__ import annotations

import gzip
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARCODE = re.compile(r"^[ACGT]{8,}(-\d+)?$", re.I)
ENSEMBL = re.compile(r"^ENS[A-Z]*G\d{6,}", re.I)
GENE = re.compile(r"^[A-Za-z][A-Za-z0-9.\-]{1,20}$")


@dataclass(frozen=True)
class Detected:
    kind: str
    confidence: float
    reason: str


def _share(pattern: re.Pattern, values: list[str]) -> float:
    return sum(bool(pattern.match(v)) for v in values) / len(values) if values else 0.0


def detect(path: str) -> Detected:
    """What a local file is, by its first bytes, with its name as a hint."""
    p = Path(path)
    name = p.name.lower()
    if not p.exists():
        return Detected("missing", 0.0, "no such file")
    if p.is_dir():
        zarr = name.endswith(".zarr") or any((p / x).exists() for x in (".zgroup", ".zattrs", "zarr.json"))
        return Detected("zarr", 0.9, "store") if zarr else Detected("unknown", 0.2, "folder")
    if name.endswith((".rds", ".rdata", ".rda")):
        return Detected("seurat", 0.9, "name")
    head = p.open("rb").read(8)
    if head.startswith(b"\x89HDF\r\n\x1a\n"):
        return Detected("hdf5", 0.6, "magic; needs an HDF5 reader to tell more")
    try:
        with (gzip.open(p, "rt", errors="replace") if head[:2] == b"\x1f\x8b" else p.open(errors="replace")) as f:
            lines = [x for x in f.read(8192).splitlines() if x.strip()][:10]
    except OSError as error:
        return Detected("unknown", 0.2, str(error))
    return hinted(of_lines(lines), name)


def of_lines(lines: list[str]) -> Detected:
    """What the first lines of a text file say."""
    if not lines:
        return Detected("unknown", 0.2, "empty")
    if lines[0].startswith("%%MatrixMarket"):
        return Detected("matrix", 0.97, "banner")
    probe = lines[min(1, len(lines) - 1)]
    sep = max(("\t", ",", ";"), key=lambda s: (probe.count(s), s == "\t"))
    width = probe.count(sep) + 1
    first = [x.split(sep)[0].strip().strip('"') for x in lines]
    if width == 1:
        if _share(BARCODE, first) >= 0.6:
            return Detected("barcodes", 0.85, "one column of barcodes")
        return Detected("features", 0.5, "one column of names") if _share(GENE, first) >= 0.6 else Detected("unknown", 0.2, "one column")
    if sep == "\t" and width <= 3 and max(_share(ENSEMBL, first), _share(GENE, first)) >= 0.5:
        return Detected("features", 0.85, "two or three columns of genes")
    return Detected("dense", 0.7, "columns") if width > 3 else Detected("unknown", 0.2, "few columns")


def hinted(d: Detected, name: str) -> Detected:
    """The name raises the confidence it agrees with, and decides where nothing else does."""
    words = {"matrix": "matrix", "barcodes": "barcodes", "features": "features", "genes": "features"}
    hint = next((k for w, k in words.items() if w in name.lower()), None)
    if hint is None:
        return d
    if d.kind == hint:
        return Detected(d.kind, min(1.0, d.confidence + 0.1), d.reason)
    return Detected(hint, 0.4, "name") if d.kind == "unknown" else Detected(d.kind, d.confidence, f"{d.reason}; the name says {hint}")


def numbered(rows: DataFrame, name: str = "line") -> DataFrame:
    """Rows with their number from 0 in the order they are read: the place within a partition and the sizes of the partitions before."""
    placed = rows.withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, number).drop("_id", "_part", "_before")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value in the order of one text file."""
    return numbered(spark.read.text(path))


def unique_names(name: Column, by: Column) -> Column:
    """A name that is there already gets -1, -2 and so on."""
    i = F.row_number().over(Window.partitionBy(name).orderBy(by)) - 1
    return F.when(i == 0, name).otherwise(F.concat(name, F.lit("-"), i.cast("string")))


def read_mex(spark: SparkSession, matrix: str, barcodes: str, features: str, transposed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, var, x) of a MatrixMarket triple of features by cells; `transposed` if it is cells by features.

    Features of one column are names, of two also have type Gene Expression; names are made unique.
    The lists of names are numbered in order; the matrix itself is read in parallel.
    """
    body = spark.read.text(matrix).filter(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    parts = body.select(F.split(F.trim("value"), "\\s+").alias("p")).filter(F.size("p") >= 3)
    header = body.first()["value"].split()
    triples = parts.select(*(F.col("p")[i].cast("double").alias(c) for i, c in enumerate("rcv")))
    dims = [float(v) for v in header[:3]]
    # the line of sizes is the first; a value equal to it elsewhere would be out of range or zero
    is_dims = (F.col("r") == dims[0]) & (F.col("c") == dims[1]) & (F.col("v") == dims[2])
    first = triples.filter(is_dims).count()
    x = triples.filter(~is_dims) if first == 1 else triples.filter(~is_dims).unionByName(triples.filter(is_dims).limit(first - 1))
    gene, cell = ("c", "r") if transposed else ("r", "c")
    x = x.select((F.col(cell) - 1).cast("long").alias("cell_id"), (F.col(gene) - 1).cast("long").alias("gene_id"), F.col("v").alias("value")).filter("value <> 0")
    obs = _lines(spark, barcodes).select(F.col("line").cast("long").alias("cell_id"), unique_names(F.trim("value"), F.col("line")).alias("cell_name"))
    f = F.split("value", "\t")
    named = _lines(spark, features).select(F.col("line").cast("long").alias("gene_id"), f[0].alias("gene_ids"), F.coalesce(F.get(f, F.lit(1)), f[0]).alias("name"), F.coalesce(F.get(f, F.lit(2)), F.lit("Gene Expression")).alias("feature_type"))
    return obs, named.withColumn("gene", unique_names(F.col("name"), F.col("gene_id"))).drop("name"), x


def read_dense(spark: SparkSession, path: str, genes_in_rows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, var, x) of a delimited matrix with names in the first row and column."""
    head = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    sep = max(("\t", ",", ";"), key=lambda s: (head[-1].count(s), s == "\t"))
    table = spark.read.csv(path, sep=sep, header=True)
    first, *rest = table.columns
    lines = numbered(table, "_i")
    x = lines.select(F.col("_i").alias("i"), F.posexplode(F.array(*(F.col(f"`{c}`").cast("double") for c in rest))).alias("col", "value")).filter("value is not null and value <> 0").select("i", F.col("col").cast("long").alias("j"), "value")
    columns = spark.createDataFrame([(i, c) for i, c in enumerate(rest)], "i long, name string")
    names = lines.select(F.col("_i").alias("i"), F.col(f"`{first}`").alias("name"))
    genes, cells, g, c = (names, columns, "i", "j") if genes_in_rows else (columns, names, "j", "i")
    obs = cells.select(F.col("i").alias("cell_id"), unique_names(F.col("name"), F.col("i")).alias("cell_name"))
    var = genes.select(F.col("i").alias("gene_id"), unique_names(F.col("name"), F.col("i")).alias("gene"))
    return obs, var, x.select(F.col(c).alias("cell_id"), F.col(g).alias("gene_id"), "value")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_name, gene of a JSON file {set: {"geneSymbols": [...]}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<geneSymbols:array<string>>>").alias("m"))
    return raw.select(F.explode("m").alias("set_name", "s")).select("set_name", F.explode("s.geneSymbols").alias("gene"))


#: What a file of a triple is called, and how its role reads.
ROLE = "(matrix|barcodes|features|genes)"


def bundles(files: DataFrame) -> DataFrame:
    """sample, files, roles, missing, repeated, complete of file names (column name): the files of a sample share what stands before their role.

    genes is the same role as features.  Names without a role are samples of their own, without missing roles.
    """
    stem = F.regexp_replace(F.col("name"), r"(\.(gz|mtx|tsv|csv|txt|h5|h5ad|loom))+$", "")
    role = F.lower(F.regexp_extract(stem, rf"(?i){ROLE}$", 1))
    sample = F.when(role != "", F.regexp_replace(stem, rf"(?i)[._-]?{ROLE}$", "")).otherwise(F.regexp_replace(stem, "_(unfiltered_|filtered_|raw_|cellbender_filter_)?matrix$", ""))
    named = files.select("name", sample.alias("sample"), F.when(role == "genes", "features").otherwise(F.nullif(role, F.lit(""))).alias("role"))
    counts = F.collect_list("role")
    own = named.groupBy("sample").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("role")).alias("roles"), counts.alias("_all"))
    missing = F.when(F.size("roles") > 0, F.array_except(F.array(*map(F.lit, ("barcodes", "features", "matrix"))), F.col("roles"))).otherwise(F.array().cast("array<string>"))
    repeated = F.filter("roles", lambda r: F.size(F.filter("_all", lambda x: x == r)) > 1)
    return own.select("sample", "files", "roles", missing.alias("missing"), repeated.alias("repeated"), ((F.size(missing) == 0) & (F.size(repeated) == 0)).alias("complete"))


def bundle_issues(found: DataFrame) -> DataFrame:
    """sample, code: triples without all files, or with a file twice."""
    codes = F.array_compact(F.array(F.when(F.size("missing") > 0, "mex_incomplete"), F.when(F.size("repeated") > 0, "mex_duplicate_role")))
    return found.select("sample", F.explode(codes).alias("code"))


def mex_issues(header: tuple[int, int] | None, n_features: int, n_barcodes: int) -> list[str]:
    """Codes of what is wrong with a triple's sizes."""
    if header is None:
        return ["mtx_header_unreadable"]
    if header == (n_features, n_barcodes):
        return []
    return ["mtx_transposed"] if header == (n_barcodes, n_features) else ["mtx_dimension_mismatch"]


def mex_sizes(spark: SparkSession, matrix: str, barcodes: str, features: str) -> tuple[tuple[int, int] | None, int, int]:
    """Rows and columns in a matrix's head (None if they can't be read), and the lines with something in them of both lists."""
    lines = spark.read.text(matrix).filter(~F.startswith("value", F.lit("%")) & (F.trim("value") != "")).limit(1).collect()
    m = re.match(r"\s*(\d+)\s+(\d+)\s+\d+\s*$", lines[0]["value"]) if lines else None
    count = lambda path: spark.read.text(path).filter(F.trim("value") != "").count()
    return (int(m[1]), int(m[2])) if m else None, count(features), count(barcodes)


def validate_mex(spark: SparkSession, matrix: str, barcodes: str, features: str) -> list[str]:
    """Codes of what is wrong with a triple's files; a compressed file that ends early is gzip_truncated."""
    try:
        header, n_features, n_barcodes = mex_sizes(spark, matrix, barcodes, features)
    except Exception as error:  # noqa: BLE001  the reader's error tells
        if "EOFException" in str(error) or "Unexpected end" in str(error):
            return ["gzip_truncated"]
        raise
    return mex_issues(header, n_features, n_barcodes)


def write_csv(frame: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, nulls empty."""
    frame.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="", mode="overwrite")


def arrow_stream(frame: DataFrame) -> bytes:
    """A result as an Arrow IPC stream; for results that fit the driver."""
    import pyarrow as pa

    table, sink = frame.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()
