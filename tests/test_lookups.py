"""Look-ups by column and group, orders, routes, and what an assessment concludes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators import metadata as M
from cytolake.operators import retrieval as R
from cytolake.operators import stats as S
from cytolake.plans import assess as A
from cytolake.plans import pipeline as P


@pytest.fixture(scope="module")
def data(spark):
    """120 cells of three groups, each with genes of its own."""
    rng = np.random.default_rng(0)
    v = rng.poisson(0.3, (120, 12)).astype(float)
    for g in range(3):
        v[40 * g : 40 * g + 40, 4 * g : 4 * g + 4] += 3
    rows = [(i, j, float(v[i, j])) for i in range(120) for j in range(12) if v[i, j]]
    obs = spark.createDataFrame([(i, "abc"[i // 40], i % 2 == 0, "all", ("x", "y")[i % 2]) for i in range(120)], "cell_id long, kind string, even boolean, one string, batch string")
    var = spark.createDataFrame([(j, f"G{j}", False, f"S{j // 4}") for j in range(12)], "gene_id long, gene string, mt boolean, set_name string")
    return Dataset(obs.cache(), var.cache(), spark.createDataFrame(rows, "cell_id long, gene_id long, value double").cache())


def test_markers_of_any_column(data):
    rows = S.markers_of(data, "kind", 4).collect()
    assert {r["group"]: {x["gene_id"] for x in rows if x["group"] == r["group"]} for r in rows} == {"a": {0, 1, 2, 3}, "b": {4, 5, 6, 7}, "c": {8, 9, 10, 11}}
    assert sorted(r["rank"] for r in S.markers_of(data, "even", 2).collect()) == [1, 1, 2, 2]
    for column, message in (("one", "one group only"), ("none", "no column")):
        with pytest.raises(ValueError, match=message):
            S.markers_of(data, column)


def test_stored_tables_by_column_and_group(data):
    state = P.State(data)
    for event in P.run(state, ["marker_genes", "enrichment"], P.Params(marker_columns=("kind",), enrichment_n_genes=10)):
        state = event.state or state
    assert {r["gene_id"] for r in P.stored_markers(state, "kind", "b", 4).collect()} == {4, 5, 6, 7}
    assert P.stored_markers(state, "even", "true", 3).count() == 3  # not stored: computed
    assert P.stored_enrichment(state, "kind", "c", 1).first()["group"] == "c"
    with pytest.raises(ValueError, match="there is: kind"):
        P.stored_enrichment(state, "even", "true")


def test_labels_in_the_order_of_both_shares(spark):
    a = spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)] * 2, "label string")
    b = spark.createDataFrame([("y",)] * 9 + [("w",)], "label string")
    assert [r["label"] for r in M.by_abundance(M.compare(a, b, "label")).orderBy("place").collect()] == ["y", "x", "z", "w"]


def test_a_column_of_cells(data):
    assert [r["value"] for r in M.column_values(data.obs, "even").limit(2).collect()] == ["true", "false"]
    assert M.column_values(data.obs.withColumn("n", F.lit(2)), "n").first()["value"] == 2.0
    with pytest.raises(ValueError, match="no column"):
        M.column_values(data.obs, "none")


def test_sets_by_name(spark):
    sets = spark.createDataFrame([("c1", "Hallmark_A", 1), ("c1", "Hallmark_A", 2), ("c2", "other", 3), ("c0", "a hallmark", 4)], "collection string, set_name string, gene_id long")
    assert [tuple(r) for r in S.search_sets(sets, "HALLmark").collect()] == [("c0", "a hallmark", 1), ("c1", "Hallmark_A", 2)] and S.search_sets(sets, "", 1).count() == 1


def test_questions_are_routed(spark):
    asked = {"Which MARKER genes are known to define T cells?": ["literature"], "How do I choose the resolution?": ["docs"], "what's in my dataset, and how many cells?": ["data"], "hello": ["data"], "Is this cluster an immune one, should I filter it?": ["data", "docs", "literature"]}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").withColumn("r", R.routed(F.col("q"))).collect()
    assert {r["q"]: r["r"] for r in rows} == asked


def status(d, step, tables=frozenset()):
    return next(s for s in A.assess(d, frozenset(tables)) if s.step == step)


def test_scaled_values_are_told_by_their_spread(spark, data):
    rng = np.random.default_rng(1)
    made = lambda v: data.with_x(spark.createDataFrame([(i, j, float(v[i, j])) for i in range(120) for j in range(12)], "cell_id long, gene_id long, value double"))
    z = rng.normal(size=(120, 12))
    assert (status(made(z), "scaling").done, status(made(z), "scaling").confidence) == (True, "high")
    assert status(made(z * 1.8), "scaling").confidence == "medium" and status(made(z * 1.8), "scaling").done
    assert not status(made(z * 9), "scaling").done and not status(made(np.abs(z)), "scaling").done
    assert (status(data, "scaling").done, status(data, "scaling").confidence) == (False, "high") and status(data, "scaling", {"scale_factors"}).done


def test_a_split_by_batches_is_pointed_out(data):
    done = [A.Status(s, True, "high") for s in ("normalization", "clustering")]
    assert A.insight(data, done) == "cells split by batch: correct for batches"
    assert A.insight(data, [*done, A.Status("batch_correction", True, "high")]) == "clusters have no labels"
    few = Dataset(data.obs.withColumn("batch", F.when(F.col("cell_id") < 5, "x").otherwise("y")), data.var, data.x)
    assert A.insight(few, done) == "clusters have no labels"
    assert A.condition_columns(["Batch", "donor_cell_type", "n", "SampleID"]) == ["Batch", "SampleID"]
