import numpy as np
import pytest

from pyspark.sql import functions as F

from cytolake.functions import text as T
from cytolake.plans import assess as A
from cytolake.plans import pipeline as P
from tests.test_stats import dataset


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.poisson(0.2, (90, 45)).astype(float)
    for b in range(3):
        m[30 * b : 30 * b + 30, 15 * b : 15 * b + 15] += rng.poisson(6, (30, 15))
    return dataset(spark, m, batch=["x", "y"] * 45)


def test_chain_finds_the_blocks(blocks):
    steps = ["clustering", "qc_metrics", "nonsense", "normalization", "log_transform", "pca", "neighbors", "marker_genes", "enrichment"]
    events = list(P.run(P.State(blocks), steps, P.Params(n_comps=10, n_neighbors=10), now=lambda: "t"))
    order = [e.step for e in events if e.kind == "step_start"]
    assert order == ["qc_metrics", "normalization", "log_transform", "pca", "neighbors", "clustering", "marker_genes", "enrichment"]
    assert [e.step for e in events if e.kind == "step_error"] == ["enrichment"]  # no gene sets here
    state = events[-1].state
    assert state.active_clustering == "cluster_louvain_r0_5" and [c.step for c in state.history][-1] == "marker_genes"
    rows = state.data.obs.select("cell_id", state.active_clustering).collect()
    groups = {}
    for i, c in rows:
        groups.setdefault(c, set()).add(i // 30)
    assert len(groups) >= 2 and all(len(v) == 1 for v in groups.values())
    assert state.tables["markers:cluster_louvain_r0_5"].filter("padj < 0.01 and lfc > 0").count() > 10
    done = {s.step: s.done for s in A.assess(state.data, frozenset(state.tables), frozenset(c.step for c in state.history))}
    assert done["clustering"] and done["pca"] and not done["cell_cycle"]
    back = list(P.run(state, ["reset_to_counts"]))[-1].state
    assert "cluster_louvain_r0_5" not in back.data.obs.columns and A.value_facts(back.data)["counts"]


def test_cycle_and_types_are_steps(spark):
    from cytolake.operators import celltypes as C

    rng = np.random.default_rng(4)
    names = [*C.S_GENES[:8], *C.G2M_GENES[:8], *"CD3D CD3E CD3G TRAC CD79A CD79B MS4A1 CD19".split(), *(f"X{i}" for i in range(60))]
    m = rng.poisson(0.5, (60, len(names))).astype(float)
    m[:20, :8] += 6
    m[20:40, 8:16] += 6
    m[:30, 16:20] += 8
    m[30:, 20:24] += 8
    d = dataset(spark, m)
    var = spark.createDataFrame([(i, n, False) for i, n in enumerate(names)], "gene_id long, gene string, mt boolean")
    obs = d.obs.withColumn("cluster", F.when(F.col("cell_id") < 30, "a").otherwise("b"))
    state = P.State(P.Dataset(obs, var, d.x))
    events = list(P.run(state, ["cell_cycle", "cell_type_annotation", "normalization", "log_transform"], now=lambda: "t"))
    assert not [e.message for e in events if e.kind == "step_error"]
    out = events[-1].state.data.obs.orderBy("cell_id").collect()
    assert {r["phase"] for r in out[:20]} == {"S"} and {r["phase"] for r in out[20:40]} == {"G2M"}
    assert [r["cell_type"] for r in out] == ["T cell"] * 30 + ["B cell"] * 30
    assert [c.step for c in events[-1].state.history] == ["normalization", "log_transform", "cell_cycle", "cell_type_annotation"]
    few = list(P.run(P.State(dataset(spark, m)), ["cell_cycle"]))
    assert few[1].kind == "step_error" and "genes" in few[1].message


def test_all_chosen_genes_take_part(spark):
    """620 variable genes: components use them all, scaled."""
    rng = np.random.default_rng(6)
    d = dataset(spark, rng.poisson(2.0, (40, 620)).astype(float))
    state = list(P.run(P.State(d), ["normalization", "log_transform", "scaling", "pca"], P.Params(n_comps=5)))[-1].state
    x = d.x.toPandas().pivot(index="cell_id", columns="gene_id", values="value").fillna(0).to_numpy()
    x = np.log1p(x / x.sum(1, keepdims=True) * 1e4)
    factors = state.tables["scale_factors"].orderBy("gene_id").toPandas()
    z = np.clip((x - factors["mean"].to_numpy()) / factors["sd"].to_numpy(), -10, 10)
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    got = np.array([r["pc"] for r in state.tables["pca"].orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :5]), atol=1e-6)


def test_batch_correction_needs_a_key(blocks):
    assert [e.kind for e in P.run(P.State(blocks), ["batch_correction"])] == ["step_start", "step_error", "complete"]


def test_assessment_of_counts(blocks):
    s = A.assess(blocks)
    assert not {x.step: x.done for x in s}["normalization"] and "batch_correction" not in A.default_steps(s)
    assert A.insight(blocks, s).startswith("raw counts") and A.recommended(1000, 3000)["n_neighbors"] == 10
    assert P.Params(resolution=9).problems() and not P.Params().problems()


def test_text_rules(spark):
    assert T.listed(["a", "b", "c"]) == "a, b and c" and T.labels_from_reply("0: B cell\n- 1: T cell", ["0", "1"]) == {"0": "B cell", "1": "T cell"}
    from pyspark.sql import functions as F

    r = spark.range(1).select(T.p_value(F.lit(0.0001)).alias("p"), T.short_number(F.lit(1500)).alias("n"), T.safe_name(F.lit("a b/c")).alias("s"), T.parsed_citation(F.lit("lit:PMID:12")).alias("c")).first()
    assert (r["p"], r["n"], r["s"], r["c"]["pmid"]) == ("1.00e-04", "1.5K", "a_b_c", "12")
