import gzip

import pytest

from cytolake.plans import provenance as P
from cytolake.sources import files as S


def test_detection(tmp_path):
    cases = {
        "matrix.mtx": ("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n", "matrix"), "b.tsv": ("AAACCTGAAAAAAAAA-1\nAAACCTGCCCCCCCCC-1\n", "barcodes"),
        "f.tsv": ("ENSG00000000001\tTP53\tGene Expression\nENSG00000000002\tMYC\tGene Expression\n", "features"), "d.csv": ("gene,a,b,c\nG1,0,1,2\n", "dense"), "e.txt": ("", "unknown"),
    }
    for name, (text, kind) in cases.items():
        (tmp_path / name).write_text(text)
        assert S.detect(str(tmp_path / name)).kind == kind, name
    with gzip.open(tmp_path / "matrix2.mtx.gz", "wt") as f:
        f.write(cases["matrix.mtx"][0])
    assert S.detect(str(tmp_path / "matrix2.mtx.gz")).confidence == 1.0
    assert S.detect(str(tmp_path / "none")).kind == "missing" and S.detect(str(tmp_path)).kind == "unknown"


def test_mex_and_dense(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    (tmp_path / "b.tsv").write_text("AA-1\nCC-1\n")
    (tmp_path / "f.tsv").write_text("E1\tA\nE2\tB\nE3\tA\n")
    obs, var, x = S.read_mex(spark, *(str(tmp_path / n) for n in ("m.mtx", "b.tsv", "f.tsv")))
    assert sorted(map(tuple, x.collect())) == [(0, 0, 5.0), (0, 2, 2.0), (1, 1, 7.0)]
    assert [r["gene"] for r in var.orderBy("gene_id").collect()] == ["A", "B", "A-1"] and obs.count() == 2
    (tmp_path / "d.csv").write_text("gene,c1,c2\nA,0,3\nB,4,0\n")
    obs, var, x = S.read_dense(spark, str(tmp_path / "d.csv"))
    assert sorted(map(tuple, x.collect())) == [(0, 1, 4.0), (1, 0, 3.0)] and [r["cell_name"] for r in obs.orderBy("cell_id").collect()] == ["c1", "c2"]


def test_gene_sets(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"A": {"geneSymbols": ["x", "y"]}, "B": {"geneSymbols": []}}')
    assert S.gene_sets(spark, str(tmp_path / "s.json")).count() == 2


def test_sizes():
    assert S.mex_issues((3, 2), 3, 2) == [] and S.mex_issues((2, 3), 3, 2) == ["mtx_transposed"] and S.mex_issues((9, 9), 3, 2) == ["mtx_dimension_mismatch"]


def test_bundles_and_validation(spark, tmp_path):
    names = ["s1_matrix.mtx.gz", "s1_barcodes.tsv.gz", "s1_genes.tsv", "s2_matrix.mtx", "s2_features.tsv", "s3_matrix.mtx", "s3.matrix.mtx", "s3_barcodes.tsv", "s3_features.tsv", "lung_filtered_matrix.h5ad", "x.csv"]
    found = {r["sample"]: r for r in S.bundles(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert found["s1"]["complete"] and found["s2"]["missing"] == ["barcodes"] and found["s3"]["repeated"] == ["matrix"] and found["x"]["complete"]
    issues = {(r["sample"], r["code"]) for r in S.bundle_issues(S.bundles(spark.createDataFrame([(n,) for n in names], "name string"))).collect()}
    assert {("s2", "mex_incomplete"), ("s3", "mex_duplicate_role")} <= issues
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 1\n1 1 5\n")
    (tmp_path / "b.tsv").write_text("AA-1\nCC-1\n\n")
    (tmp_path / "f.tsv").write_text("E1\tA\nE2\tB\nE3\tA\n")
    paths = [str(tmp_path / n) for n in ("m.mtx", "b.tsv", "f.tsv")]
    assert S.mex_sizes(spark, *paths) == ((2, 3), 3, 2) and S.validate_mex(spark, *paths) == ["mtx_transposed"]
    whole = gzip.compress(b"AAACCC-1\n" * 5000)
    (tmp_path / "b2.tsv.gz").write_bytes(whole[: len(whole) // 2])
    assert S.validate_mex(spark, paths[0], str(tmp_path / "b2.tsv.gz"), paths[2]) == ["gzip_truncated"]


def test_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = S._lines(spark, str(tmp_path / "n.txt"))
        assert rows.filter("cast(value as long) <> line").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_provenance_chain_and_rerun():
    h = P.record([], "pca", {"n": 50, "empty": ""}, "2024-01-01")
    h = P.record(h, "clustering", {"resolution": 0.5}, "2024-01-02")
    assert h[1].parent == h[0].commit_id and h[0].params == {"n": 50} and P.loaded(P.dumped(h)) == h and P.loaded("nonsense") == []
    plan = P.plan_rerun(["pca", "neighbors", "clustering", "embeddings", "marker_genes"], "clustering")
    assert plan.rerun == ["clustering", "marker_genes"] and plan.kept == ["pca", "neighbors", "embeddings"] and not plan.requires_reprocess
    assert P.plan_rerun(["pca"], "normalization").requires_reprocess
    with pytest.raises(ValueError):
        P.plan_rerun([], "nothing")
