"""Data sources, sinks with commit and abort, detection by expressions, units, and the reader of each format."""

import gzip
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytolake.sources import files, loading, mex
from cytolake.sources.parts import ArrowParts, registered
from cytolake.sources.stores import Stores, of_session


@pytest.fixture(scope="module")
def sources(spark):
    registered(spark, mex.Mex, ArrowParts)
    return spark


def triples(frame):
    return sorted(map(tuple, frame.select("cell_id", "gene_id", "value").collect()))


def made(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, gene_id long, value double")


def test_paths_as_the_session_means_them():
    stores = Stores("hdfs://nn:8020", (("viewfs://c/deep/in", "file:///data/x"), ("viewfs://c/deep", "s3a://bucket/y")))
    assert stores.resolved("viewfs://c/deep/in/a/b.mtx") == "file:///data/x/a/b.mtx"
    assert stores.resolved("viewfs://c/deep/z") == "s3://bucket/y/z" and stores.resolved("viewfs://c/deeper/z") == "viewfs://c/deeper/z"
    assert stores.resolved("/a/b") == "hdfs://nn:8020/a/b" and Stores().resolved("/a/b") == "file:///a/b" and Stores().resolved("file:/a") == "file:///a"
    with pytest.raises(ValueError, match="no Arrow file system"):
        stores.opened("viewfs://other/x")


def test_a_store_that_only_the_configuration_knows(sources, tmp_path):
    """viewfs is a store of Spark's; its mount table goes to the workers with the source."""
    conf = sources.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.unit.link./in", f"file://{tmp_path}")
    try:
        registered(sources, mex.Mex, ArrowParts)
        rows = [(i % 7, i % 11, float(i)) for i in range(1, 78)]
        made(sources, rows).repartition(3).write.format("mex").option("cells", 7).option("genes", 11).mode("overwrite").save("viewfs://unit/in/m.mtx")
        assert triples(sources.read.format("mex").load("viewfs://unit/in/m.mtx")) == sorted(rows)
        (tmp_path / "one.mtx").write_text("%%MatrixMarket matrix coordinate real general\n11 7 77\n" + "".join(f"{g + 1} {c + 1} {v}\n" for c, g, v in rows))
        assert triples(sources.read.format("mex").load("viewfs://unit/in/one.mtx")) == sorted(rows)
        (tmp_path / "b.tsv").write_text("".join(f"ACGTACGTA{'ACGT'[i % 4]}-1\n" for i in range(7)))
        (tmp_path / "f.tsv").write_text("".join(f"ENSG{i:08d}\tG{i}\n" for i in range(11)))
        _, _, x = files.read_mex(sources, "viewfs://unit/in/one.mtx", "viewfs://unit/in/b.tsv", "viewfs://unit/in/f.tsv")
        assert triples(x) == sorted(rows)
        found = {r["name"]: r["kind"] for r in loading.detected(sources, "viewfs://unit/in").collect()}
        assert found == {"m.mtx": "matrix", "one.mtx": "matrix", "b.tsv": "barcodes", "f.tsv": "features"}
        assert of_session(sources).mounts == (("viewfs://unit/in", f"file://{tmp_path}"),)
    finally:
        conf.unset("fs.viewfs.mounttable.unit.link./in")
        registered(sources, mex.Mex, ArrowParts)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", ""])
def test_ranges_of_bytes_read_every_line_once(sources, tmp_path, split, end):
    rows = [(c, g, float(c * g + 1)) for c in range(6) for g in range(0, 9, 2)]
    text = "%%MatrixMarket matrix coordinate real general\n% a comment\n\n9 6 30\n" + "\n".join(f"{g + 1} {c + 1}  {v!r}" for c, g, v in rows) + end
    (tmp_path / "m.mtx").write_text(text)
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as f:
        f.write(text)
    for name in ("m.mtx", "m.mtx.gz"):
        frame = sources.read.format("mex").option("splitBytes", split).load(str(tmp_path / name))
        assert triples(frame) == sorted(rows)
    turned = sources.read.format("mex").option("transposed", "true").load(str(tmp_path / "m.mtx"))
    assert triples(turned) == sorted((g, c, v) for c, g, v in rows)


def test_blocks_smaller_than_lines(sources, tmp_path, monkeypatch):
    reader = mex.MexReader(str(tmp_path / "m.mtx"), Stores(), False, 11)
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 3\n1 1 1.25\n2 2 2.5\r\n3 3 3e3\n")
    monkeypatch.setattr(mex, "BLOCK", 3)
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["cell_id"], r["gene_id"], r["value"]) for r in got] == [(0, 0, 1.25), (1, 1, 2.5), (2, 2, 3000.0)]


def test_patterns_and_symmetry(sources, tmp_path):
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 1\n2 1\n")
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate integer symmetric\n2 2 2\n1 1 4\n2 1 5\n")
    (tmp_path / "k.mtx").write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 5\n")
    read = lambda n: triples(sources.read.format("mex").load(str(tmp_path / n)))
    assert read("p.mtx") == [(0, 0, 1.0), (0, 1, 1.0)] and read("s.mtx") == [(0, 0, 4.0), (0, 1, 5.0), (1, 0, 5.0)] and read("k.mtx") == [(0, 1, 5.0), (1, 0, -5.0)]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("%%MatrixMarket matrix array real general\n2 2\n1\n", "not a coordinate"), ("%%MatrixMarket matrix coordinate complex general\n2 2 1\n1 1 1 1\n", "can't be read"), ("hello\n", "not a coordinate"),
        ("%%MatrixMarket matrix coordinate real general\n", "before the line of sizes"), ("%%MatrixMarket matrix coordinate real general\n2 x 1\n", "sizes can't be read"),
        ("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 5\n", "outside"), ("%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1\n2 2 5 1\n1 1 1\n", "numbers"),
        ("%%MatrixMarket matrix coordinate real general\n2 2 1\n1 one 5\n", "can't be read"),
    ],
)
def test_what_is_wrong_with_a_matrix_is_said(sources, tmp_path, text, message):
    (tmp_path / "m.mtx").write_text(text)
    with pytest.raises(Exception, match=message):
        sources.read.format("mex").load(str(tmp_path / "m.mtx")).collect()


def test_a_matrix_is_written_as_a_whole(sources, tmp_path):
    path = str(tmp_path / "m.mtx")
    write = lambda rows, n=5: made(sources, rows).repartition(4).write.format("mex").option("cells", n).option("genes", n).mode("overwrite").save(path)
    write([(i, i, i + 0.125) for i in range(5)])
    write([(4, 0, 1e-300), (0, 4, -2.0)])
    assert triples(sources.read.format("mex").load(path)) == [(0, 4, -2.0), (4, 0, 1e-300)]
    assert json.load(open(f"{path}/_SUCCESS"))["rows"] == 2 and not [f for f in os.listdir(path) if f.startswith("_staging")]
    with pytest.raises(Exception, match="outside"):
        write([(9, 9, 1.0)])
    assert triples(sources.read.format("mex").load(path)) == [(0, 4, -2.0), (4, 0, 1e-300)]  # the failed job left all as it was
    write([])
    assert triples(sources.read.format("mex").load(path)) == []


def test_arrow_streams_with_every_type(sources, tmp_path):
    path = str(tmp_path / "a")
    frame = sources.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("d"), F.concat(F.lit('é,"\n'), F.col("id").cast("string")).alias("s"), F.array("id", F.lit(None)).alias("a"), F.struct(F.col("id").alias("x")).alias("st"),
        F.when(F.col("id") > 500, F.lit(True)).alias("b"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("decimal(20,3)").alias("dec"),
    )
    frame.repartition(5).write.format("arrow_parts").mode("append").save(path)
    again = sources.read.format("arrow_parts").load(path)
    assert again.columns == frame.columns and again.exceptAll(frame).count() == 0 and frame.exceptAll(again).count() == 0
    frame.limit(10).write.format("arrow_parts").mode("append").save(path)
    assert sources.read.format("arrow_parts").load(path).count() == 1010
    frame.limit(3).write.format("arrow_parts").mode("overwrite").save(path)
    assert sources.read.format("arrow_parts").load(path).select("s").count() == 3
    part = next(f for f in os.listdir(path) if f.endswith(".arrows"))
    assert pa.ipc.open_stream(f"{path}/{part}").read_all().num_columns == 8  # any reader of Arrow streams reads a part


def test_a_failed_job_leaves_nothing(sources, tmp_path):
    path = str(tmp_path / "a")
    bad = sources.range(1000, numPartitions=4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("arrow_parts").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="give a schema"):
        sources.read.format("arrow_parts").load(path).count()


def test_no_row_of_a_large_result_is_on_the_driver(sources, tmp_path):
    frame = sources.range(10_000_000, numPartitions=8).select("id", (F.col("id") % 1000).alias("k"))
    frame.write.format("arrow_parts").mode("append").save(str(tmp_path / "a"))
    again = sources.read.format("arrow_parts").load(str(tmp_path / "a"))
    assert tuple(again.agg(F.count("*"), F.sum("id"), F.sum("k"), F.count_distinct("id")).first()) == (10_000_000, 49_999_995_000_000, 4_995_000_000, 10_000_000)


def test_csv_doubles_quotes_and_leaves_nulls_empty(spark, tmp_path):
    rows = [("a,b", 'say "x"', 1.5), ("two\nlines", None, None), ("", "plain", 2.0)]
    files.write_csv(spark.createDataFrame(rows, "a string, b string, c double").coalesce(1), str(tmp_path / "c"))
    part = next(f for f in os.listdir(tmp_path / "c") if f.endswith(".csv"))
    assert (tmp_path / "c" / part).read_text() == 'a,b,c\n"a,b","say ""x""",1.5\n"two\nlines",,\n,plain,2.0\n'
    import csv

    with open(tmp_path / "c" / part, newline="") as f:
        assert list(csv.reader(f))[1:] == [["a,b", 'say "x"', "1.5"], ["two\nlines", "", ""], ["", "plain", "2.0"]]


CASES = {
    "matrix.mtx": ("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n", "matrix", 1.0, "agrees"),
    "m": ("\n  %%MatrixMarket matrix coordinate integer general\n3 2 3\n", "matrix", 0.97, None),
    "b.tsv": ("AAACCTGAAAAAAAAA-1\nAAACCTGCCCCCCCCC-1\nx y\n", "barcodes", 0.85, None),
    "s1_barcodes.tsv": ("aaacctgaaaaaaaaa\nAAACCTGCCCCCCCCC-12\n", "barcodes", 0.95, "agrees"),
    "s1_barcodes_odd.tsv": ("1\n2\n", "barcodes", 0.4, "applied"),
    "features.tsv": ("ENSG00000000001\tTP53\tGene Expression\nENSMUSG00000000002\tMYC\tGene Expression\n", "features", 0.95, "agrees"),
    "f2.tsv": ("TP53\tx\nMYC\ty\n1\tz\n", "features", 0.85, None),
    "list.txt": ("TP53\nMYC\nB2M\n12\n", "features", 0.5, None),
    "d.csv": ("gene,a,b,c\nG1,0,1,2\n", "dense", 0.7, None),
    "genes_table.csv": ("gene,a,b,c\nG1,0,1,2\n", "dense", 0.7, "conflicts"),
    "w.txt": ("g a b c\nG1 0 1 2\n", "dense", 0.7, None),
    "few.csv": ("gene,a\nG1,0\n", "unknown", 0.2, None),
    "e.txt": ("", "unknown", 0.0, None),
    "blank.txt": (" \n\n", "unknown", 0.0, None),
    "x.RDS": ("anything", "seurat", 0.7, None),
}


def test_detection_by_expressions(sources, tmp_path):
    for name, (text, *_) in CASES.items():
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "z_matrix.mtx.gz", "wt") as f:
        f.write(CASES["matrix.mtx"][0] + "1 1 1\n" * 50_000)
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe\x00" * 9000)
    (tmp_path / "half.gz").write_bytes(b"\x1f\x8b\x08broken")
    (tmp_path / "h5.h5").write_bytes(loading.HDF5_MAGIC + b"rest")
    (tmp_path / "cut.txt").write_text("é" * 40_000)
    (tmp_path / "store.zarr").mkdir()
    (tmp_path / "v3").mkdir()
    (tmp_path / "v3" / "zarr.json").write_text("{}")
    (tmp_path / "plain").mkdir()
    found = {r["name"]: (r["kind"], r["confidence"], r["hint"]) for r in loading.detected(sources, str(tmp_path)).collect()}
    want = {name: tuple(rest) for name, (_, *rest) in CASES.items()}
    want |= {"z_matrix.mtx.gz": ("matrix", 1.0, "agrees"), "bin.dat": ("unknown", 0.0, None), "half.gz": ("unknown", 0.0, None), "h5.h5": ("hdf5", 0.2, None), "cut.txt": ("unknown", 0.2, None)}
    want |= {"store.zarr": ("zarr", 0.9, None), "v3": ("zarr", 0.9, None), "plain": ("unknown", 0.0, None)}
    assert found == want
    gone = sources.createDataFrame([(str(tmp_path / "none"), "none")], "path string, name string")
    assert loading.classified(loading.heads(gone, of_session(sources))).first()["kind"] == "missing"


def test_units_are_loaded_or_refused(sources, tmp_path):
    text = "%%MatrixMarket matrix coordinate integer general\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n"
    for sample in ("s1", "s2", "s3"):
        (tmp_path / f"{sample}_matrix.mtx").write_text(text)
        (tmp_path / f"{sample}_barcodes.tsv").write_text("AACCGGTT-1\nAACCGGTT-1\n")
    for name in ("s1_genes.tsv", "s3_features.tsv", "s3_genes.tsv"):
        (tmp_path / name).write_text("ENSG0000001\tA\nENSG0000002\tB\nENSG0000003\tA\n")
    (tmp_path / "grid.csv").write_text("gene,c1,c2,c3\nA,0,3,1\nB,4,0,0\n")
    (tmp_path / "big.h5ad").write_bytes(loading.HDF5_MAGIC)
    found = {r["sample"]: r for r in loading.units(loading.detected(sources, str(tmp_path))).collect()}
    assert {k: (r["format"], r["complete"], r["missing"], r["repeated"]) for k, r in found.items()} == {
        "s1": ("mex", True, [], []), "s2": ("mex", False, ["features"], []), "s3": ("mex", False, [], ["features"]), "grid": ("dense", True, [], []), "big": ("hdf5", True, [], []),
    }
    d = loading.load_unit(sources, found["s1"])
    assert triples(d.x) == [(0, 0, 5.0), (0, 2, 2.0), (1, 1, 7.0)]
    assert [tuple(r) for r in d.obs.orderBy("cell_id").collect()] == [(0, "AACCGGTT-1"), (1, "AACCGGTT-1-1")]
    assert [(r["gene_ids"], r["gene"], r["feature_type"]) for r in d.var.orderBy("gene_id").collect()][2] == ("ENSG0000003", "A-1", "Gene Expression")
    grid = loading.load_unit(sources, found["grid"])
    assert triples(grid.x) == [(0, 1, 4.0), (1, 0, 3.0), (2, 0, 1.0)]
    assert triples(loading.load_unit(sources, found["grid"], {"genes_in_rows": False}).x) == [(0, 1, 3.0), (0, 2, 1.0), (1, 0, 4.0)]
    for sample, message in (("s2", "no features"), ("s3", "features twice"), ("big", "no reader")):
        with pytest.raises(loading.LoadError, match=message):
            loading.load_unit(sources, found[sample])


def test_parts_are_numbered_in_the_order_of_their_names(spark, tmp_path):
    sizes = [3000, 1, 0, 500, 4]
    at = 0
    for i, n in enumerate(sizes):
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{at + k}\n" for k in range(n)))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        rows = loading.numbered_lines(spark, str(tmp_path))
        assert rows.filter("cast(value as long) <> line").count() == 0 and rows.count() == at
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_totals_of_loaded_cells_move_no_names_with_the_values(spark):
    from cytolake.model import Dataset
    from cytolake.sources import source_queries as Q

    obs = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "cell_id long, cell_name string")
    var = spark.createDataFrame([(i, f"G{i}") for i in range(30)], "gene_id long, gene string")
    x = spark.createDataFrame([(0, 9, 1.0), (0, 10, 2.0), (0, 2, 4.0), (1, 29, 3.0), (1, 3, 5.0), (7, 1, 1.0)], "cell_id long, gene_id long, value double")
    out = Q._totals(Dataset(obs, var, x))
    assert {tuple(r) for r in out.collect()} == {("A", 3, 7.0, "G10"), ("B", 2, 8.0, "G29")}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
