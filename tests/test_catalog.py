"""Small rules on columns, and datasets as folders."""

import numpy as np
from pyspark.sql import functions as F

from cytolake.functions import text as T
from cytolake.operators import catalog as C
from cytolake.operators import metadata, qc
from cytolake.operators import retrieval as R
from cytolake.plans import pipeline as P
from cytolake.plans import provenance
from cytolake.sources import datasets as D
from tests.test_stats import dataset


def test_column_rules(spark):
    obs = spark.createDataFrame([(i, float(i), "a", i % 3, "x") for i in range(10)], "cell_id long, dpt_1 double, cluster_leiden_r1 string, k int, pseudotime_name string")
    assert C.pseudotime_columns(obs) == ["dpt_1"] and C.picked(["X_pca", "X_tsne"]) == "X_tsne" and C.picked(["a"]) == "a" and C.picked([]) is None
    assert C.shared_columns(obs, obs.select("cell_id", "pseudotime_name")) == ["pseudotime_name"]
    info = metadata.columns_info(obs, ["cluster_leiden_r1", "k", "pseudotime_name"])
    kinds = dict(obs.dtypes)
    assert {r["column"] for r in C.groupable(info, kinds).collect()} == {"cluster_leiden_r1", "k", "pseudotime_name"}
    assert C.cluster_like(info, kinds, "cluster_leiden_r1") == ["cluster_leiden_r1"] and C.cluster_like(info.filter("column = 'pseudotime_name'"), kinds) == ["pseudotime_name"]
    assert [r["column"] for r in C.toolbar(info, kinds | {"leiden": "string"}, 100).orderBy("position").collect()] == ["cluster_leiden_r1", "pseudotime_name", "k"]


def test_text_rules_in_columns(spark):
    one = spark.range(1).select(
        T.pretty_label(F.lit("cluster_leiden_r0_5")).alias("a"), T.pretty_label(F.lit("x_celltypeAnno")).alias("b"), T.pretty_label(F.lit("plain")).alias("c"), T.overlap(F.lit("3/40")).alias("o"), T.overlap(F.lit("?")).alias("bad"),
        T.genes_of(F.lit("A; B;;C")).alias("g"), T.vector_text(F.array(F.lit(1.0), F.lit(2.5))).alias("v"), T.viridis(F.lit(2.0)).alias("high"), T.safe_name(F.lit(" a b ")).alias("s"),
    ).first()
    assert (one["a"], one["b"], one["c"], one["s"]) == ("Leiden (res 0.5)", "x · cell types", "plain", "a_b") and tuple(one["o"]) == (3, 40) and tuple(one["bad"]) == (None, None)
    assert one["g"] == ["A", "B", "C"] and one["v"] == "[1.0,2.5]" and all(0 <= x <= 255 for x in one["high"])


def test_sections(spark):
    def plain(text, most, overlap):
        import re

        pieces = []
        for p in re.split(r"\n\s*\n|\n#{1,6}\s", text):
            for x in p.split("\n") if len(p) > most else [p]:
                x = x.strip()
                n = max(0, -(-(len(x) - most) // (most - overlap)))
                pieces += [x[i * (most - overlap) :][:most] for i in range(n + 1)] if x else []
        out, cur = [], ""
        for p in pieces:
            if cur and len(cur) + len(p) + 1 > most:
                out.append(cur.strip())
                cur = cur[-overlap:] + " " + p
            else:
                cur = f"{cur} {p}" if cur else p
        return out + ([cur.strip()] if cur.strip() else [])

    texts = ["", "one\n\ntwo\n# three\nfour", "word " * 100, "\n".join(f"line {i} of text" for i in range(60)), "a" * 500 + "\n\n" + "b" * 95]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in frame.select("i", R.sections(F.col("t"), 100, 20).alias("s")).collect()}
    assert all(got[i] == plain(t, 100, 20) for i, t in enumerate(texts))


def test_mixing_summary_and_bars(spark):
    m = spark.createDataFrame([("a", 30, 0.5), ("b", 10, 0.1)], "cluster string, n long, entropy double")
    rows = metadata.mixing_summary(m).collect()
    assert [r["cluster"] for r in rows] == ["b", "a"] and abs(rows[0]["weighted"] - 0.4) < 1e-12
    h = qc.histogram(spark.createDataFrame([(0.0,), (4.0,)], "v double"), "v", 4)
    assert [(r["mid"], r["width"], r["n"]) for r in D.bars(h).orderBy("mid").collect()] == [(0.5, 1.0, 1), (1.5, 1.0, 0), (2.5, 1.0, 0), (3.5, 1.0, 1)]


def test_datasets_are_saved_and_loaded(spark, tmp_path):
    d = dataset(spark, np.random.default_rng(1).poisson(2.0, (30, 20)).astype(float))
    state = list(P.run(P.State(d), ["qc_metrics", "normalization", "log_transform"], now=lambda: "t"))[-1].state
    D.save(state, str(tmp_path / "d"))
    back = D.load(spark, str(tmp_path / "d"))
    assert back.history == state.history and D.info(back) == D.info(state) and back.data.x.count() == state.data.x.count()
    assert provenance.recipe(list(back.history))[0][0] == "qc_metrics" and "log transform" in provenance.methods_text(list(back.history))
    assert provenance.mismatches({"embeddings": ["pca"]}, {"embeddings": []}) == ["embeddings: pca is recorded and not there"]
    again = list(P.reprocess(back, now=lambda: "u"))[-1].state
    assert [c.step for c in again.history] == ["reset_to_counts", "qc_metrics", "normalization", "log_transform"]
    assert abs(again.data.x.agg(F.sum("value")).first()[0] - state.data.x.agg(F.sum("value")).first()[0]) < 1e-6
    assert D.without_results(state).tables == {}


def test_embedding_by_a_function(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id long, t string")
    out = D.embedded(texts, "t", lambda xs: [[len(x), 1] for x in xs], batch=1)
    assert {r["id"]: r["embedding"] for r in out.collect()} == {1: [2.0, 1.0], 2: None, 3: [1.0, 1.0]}
