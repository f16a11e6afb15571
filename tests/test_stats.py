"""Planted signals and small exact cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators import expression as E
from cytolake.operators import ingest as I
from cytolake.operators import metadata as M
from cytolake.operators import qc
from cytolake.operators import stats as S


def dataset(spark, m, **columns):
    n, g = m.shape
    obs = spark.createDataFrame([(i, f"C{i}", *(columns[c][i] for c in columns)) for i in range(n)], ["cell_id", "cell_name", *columns])
    var = spark.createDataFrame([(j, f"G{j}" if j > 1 else f"MT-{j}", j < 2) for j in range(g)], "gene_id long, gene string, mt boolean")
    x = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(g) if m[i, j]], "cell_id long, gene_id long, value double")
    return Dataset(obs, var, x)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    m = rng.poisson(0.5, (60, 30)).astype(float)
    m[:30, :5] += 6
    m[59] = 0
    return m, dataset(spark, m, cluster=["a"] * 30 + ["b"] * 30)


def test_qc_counts_cells_without_values(planted):
    m, d = planted
    got = {r["cell_id"]: r for r in qc.cell_qc(d).collect()}
    assert len(got) == 60 and got[59]["total_counts"] == 0 and got[59]["pct_mt"] == 0
    assert got[0]["total_counts"] == m[0].sum() and got[0]["n_genes"] == (m[0] > 0).sum()


def test_rank_sums_equal_a_dense_computation(planted):
    m, d = planted
    got = {(r["group"], r["gene_id"]): r for r in S.rank_sums(qc.log1p(d), d.obs.select("cell_id", F.col("cluster").alias("group"))).collect()}
    for j in (0, 7, 29):
        order = m[:, j]
        ranks = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
        z = (ranks[:30].sum() - 30 * 61 / 2) / np.sqrt(30 * 30 * 61 / 12)
        assert abs(got["a", j]["z"] - z) < 1e-9
    best = sorted((k for k in got if k[0] == "a"), key=lambda k: got[k]["padj"])[:5]
    assert {j for _, j in best} == set(range(5)) and all(got[k]["lfc"] > 0 for k in best)


def test_selection_needs_three_cells(planted):
    with pytest.raises(ValueError):
        S.selection_against_rest(planted[1], [0, 0, 1, 9999])
    assert S.selection_against_rest(qc.log1p(planted[1]), [0, 1, 2, 3]).count() == 30


def test_scores_and_labels(spark, planted):
    _, d = planted
    sets = spark.createDataFrame([("up", j) for j in range(5)] + [("flat", j) for j in range(20, 25)], "term string, gene_id long")
    scores = S.set_scores(d, sets, controls=5)
    assert {r["cluster"]: r["label"] for r in S.labels_by_score(scores, d.obs.select("cell_id", "cluster")).collect()}["a"] == "up"


def test_over_representation_of_a_whole_set(spark):
    sets = spark.createDataFrame([("s", j) for j in range(5)] + [("t", j) for j in range(5, 50)], "term string, gene_id long")
    got = {r["term"]: r for r in S.over_representation(spark.createDataFrame([("g", j) for j in range(5)], "`group` string, gene_id long"), sets).collect()}
    assert abs(got["s"]["pval"] - 1 / 2118760) < 1e-9 and "t" not in got


def test_lookup_keeps_order_and_drops_unknown(planted):
    out = E.lookup(planted[1], ["G7", "nope", "G3"])
    assert out.columns == ["cell_id", "G7", "G3"] and out.count() == 60


def test_stride_positions():
    assert len(E.positions(12_000, 5_000)) == 5_000 and E.positions(3, 5) == [0, 1, 2]


def test_stride_sample_equals_positions(spark):
    frame = spark.range(1234).withColumnRenamed("id", "i")
    assert sorted(r["i"] for r in E.stride_sample(frame, "i", 1234, 100).collect()) == E.positions(1234, 100)


def test_histogram_of_one_value(spark):
    got = qc.histogram(spark.createDataFrame([(5.0,)] * 4, "v double"), "v").collect()
    assert sum(r["n"] for r in got) == 4 and len(got) == 40


def test_mixing_is_one_for_even_batches(spark):
    obs = spark.createDataFrame([("x", b) for b in "ab" * 5] + [("y", "a")] * 3, "c string, b string")
    got = {r["cluster"]: r["entropy"] for r in M.batch_mixing(obs, "c", "b").collect()}
    assert abs(got["x"] - 1) < 1e-12 and got["y"] == 0


def test_embedding_codes_and_third_dimension(spark):
    e = spark.createDataFrame([(0, [1.0, 2.0, 3.0], "q"), (1, [1.0, 2.0, 3.0], None), (2, [0.0, 0.0, 0.0], "a")], "cell_id long, coords array<float>, c string")
    assert [(r["color_code"], r["z"]) for r in M.colored_embedding(e, "c").orderBy("cell_id").collect()] == [(0, 3.0), (-1, 3.0), (1, 0.0)]


def test_merge_inner_and_outer(spark):
    x = spark.createDataFrame([("s", 0, "G1", 1.0), ("s", 0, "G2", 1.0), ("t", 0, "G2", 2.0), ("t", 1, "G3", 1.0)], "sample string, cell_id long, gene string, value double")
    assert {r["gene"] for r in I.merged(x, "inner").collect()} == {"G2"} and I.merged(x, "outer").count() == 4
    assert I.plan_counts(x).first()["shared"] == 1


@pytest.mark.parametrize(("name", "label"), [("SampleA_raw_matrix.mtx.gz", "SampleA"), ("S1_cellbender_filter_matrix", "S1"), ("Donor3_unfiltered_matrix", "Donor3"), ("matrix", "matrix")])
def test_labels_of_files(name, label):
    assert I.clean_label(name) == label


@pytest.mark.parametrize("digits", [None, 0])
def test_ranks_of_one_gene_in_all_cells(spark, digits):
    """One gene in all of 200,000 cells, with all values unlike or a few that most cells share: no task has more than twice the median."""
    rng = np.random.default_rng(6)
    n = 200_000
    v = rng.normal(0.3, 1, n) if digits is None else np.round(rng.normal(0.3, 0.6, n), digits)
    group = np.where(rng.random(n) < 0.3, "a", "b")
    import pandas as pd

    frame = pd.DataFrame({"cell_id": np.arange(n), "gene_id": 0, "value": v})
    few = pd.DataFrame({"cell_id": [0, 1, 2], "gene_id": [1, 1, 2], "value": [2.0, 2.0, -1.0]})
    x = spark.createDataFrame(pd.concat([frame, few])).filter("value <> 0")
    d = Dataset(spark.range(n).withColumnRenamed("id", "cell_id"), spark.range(4).withColumnRenamed("id", "gene_id"), x)
    groups = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "group": group}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    seen = []
    plain = S._ranked_within
    try:
        got = {(r["group"], r["gene_id"]): r for r in S.rank_sums(d, groups).collect()}
        rows = x.join(groups, "cell_id").repartitionByRange("gene_id", "value", "cell_id").sortWithinPartitions("gene_id", "value").select("gene_id", "value", "group")
        seen = [r["n"] for r in rows.mapInArrow(plain, S._RANKED).groupBy("part").agg(F.sum("m").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 16 and max(seen) <= 2 * np.median(seen)
    dense = np.zeros((3, n))
    dense[0] = v
    dense[1, :2], dense[2, 2] = 2.0, -1.0
    for g in range(3):
        order = pd.Series(dense[g]).rank(method="average").to_numpy()
        for name in "ab":
            m = (group == name).sum()
            z = (order[group == name].sum() - m * (n + 1) / 2) / np.sqrt(m * (n - m) * (n + 1) / 12)
            assert abs(got[name, g]["z"] - z) < 1e-6 * max(1, abs(z)), (g, name)


def test_many_genes_of_few_values_are_ranked_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "TaskContext", type("Task", (), {"get": lambda: type("T", (), {"partitionId": lambda self: 3})()}))
    gene = np.repeat(np.arange(3000), 4)
    value = np.tile([-1.0, 2.0, 2.0, 5.0], 3000)
    t = pa.table({"gene_id": gene, "value": value, "group": np.tile(["a", "a", "b", "b"], 3000)})
    out = list(S._ranked_within(t.to_batches(max_chunksize=4002)))
    assert len(out) <= 4 and all(b.column("part").to_pylist() == [3] * b.num_rows for b in out)
    got = {(r["gene_id"], r["group"], r["run"]): r for b in out for r in b.to_pylist()}
    assert len(got) == sum(b.num_rows for b in out) == 6002
    assert all((got[j, "a", None]["ranks"], got[j, "b", None]["ranks"], got[j, "a", None]["neg"], got[j, "b", None]["m"]) == (3.5, 6.5, 1, 2) for j in range(1, 2999))
    assert got[0, "a", -1.0]["less"] == 0 and got[0, "a", None]["ranks"] == 2.5 and got[2999, "b", 5.0]["less"] == 3 and got[2999, "b", None]["ranks"] == 2.5


def test_adjusted_p_values_of_a_group_come_from_many_tasks(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(4000), 2)
    rows = [("a", i, float(v)) for i, v in enumerate(p)] + [(None, i, float(v) / 2) for i, v in enumerate(p[:7])]
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, "false")
    try:
        out = S.benjamini_hochberg(spark.createDataFrame(rows, "g string, i long, p double"), "p", ["g"], "i")
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(off)
    for g in ("a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        q = [r[2] * len(own) / (k + 1) for k, r in enumerate(own)]
        assert {r["i"]: r["padj"] for r in got if r["g"] == g} == {r[1]: min(1.0, *q[k:]) if q[k:][1:] else min(1.0, q[k]) for k, r in enumerate(own)}
    tasks = [r["task"] for r in got if r["g"] == "a"]
    assert len(tasks) == 4000 and len(set(tasks)) > 1


def test_whole_genes_are_ranked_where_they_are(spark):
    """Of rows sorted by gene alone, in one partition: the first and last gene are marked, others have their sums over groups."""
    rows = [(g, float((7 * i + g) % 5 - 1), "ab"[i % 2]) for g in range(4) for i in range(20 + g) if (7 * i + g) % 5 != 1]
    found = spark.createDataFrame(rows, "gene_id long, value double, group string").coalesce(1).sortWithinPartitions("gene_id").mapInArrow(S._ranked_within, S._RANKED).collect()
    assert {r["gene_id"] for r in found if r["cut"]} == {0, 3}
    inner = {(r["gene_id"], r["group"]): r for r in found if not r["cut"]}
    assert set(inner) == {(g, c) for g in (1, 2) for c in "ab"}
    for (gene, group), r in inner.items():
        of = [(v, c) for g, v, c in rows if g == gene]
        rank = lambda v: sum(w < v for w, _ in of) + (sum(w == v for w, _ in of) + 1) / 2  # noqa: B023, E731
        assert r["ranks"] == sum(rank(v) for v, c in of if c == group) and r["m"] == sum(c == group for _, c in of)
        assert (r["nnz"], r["all_neg"], r["ts"]) == (len(of), sum(v < 0 for v, _ in of), sum(v for v, _ in of))
