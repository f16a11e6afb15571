import pytest

from cytolake.queries import oracle_sql, queries
from tests.oracle import SF, check, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    check(spark, con, queries()[name], oracle_sql()[name])


def test_every_query_has_a_name_of_its_own():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 50


def test_components_are_orthogonal(spark):
    import numpy as np

    p = queries()["pca_scores"](spark, SF).toPandas().sort_values("cell_id").drop(columns="cell_id").to_numpy()
    c = np.corrcoef(p.T)
    assert np.abs(c - np.eye(len(c))).max() < 1e-6 and (np.diff(p.var(0)) <= 1e-9).all()


def test_communities_beat_chance(spark):
    from cytolake.operators import graph as G

    edges = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 10) for b in range(base, base + 10) if a != b] + [(0, 10, 0.1), (10, 0, 0.1), (10, 20, 0.1), (20, 10, 0.1)]
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = G.communities(frame, resolution=1.0)
    got = {r["cell_id"]: r["community"] for r in labels.collect()}
    assert len(set(got.values())) == 3 and G.modularity(frame, labels) > 0.6


def test_correction_brings_batches_together(spark):
    import numpy as np

    from cytolake.operators import graph as G

    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 5))
    v[100:] += 3
    frame = spark.createDataFrame([(i, "a" if i < 100 else "b", v[i].tolist()) for i in range(200)], "cell_id long, batch string, v array<double>")
    out = np.array([r["v"] for r in G.corrected(frame, clusters=2).orderBy("cell_id").collect()])
    assert out.shape == v.shape and np.abs(out[:100].mean(0) - out[100:].mean(0)).max() < 1.0


def test_ties_among_many_copies_go_by_id(spark, monkeypatch):
    import numpy as np

    from cytolake.operators import graph as G

    monkeypatch.setattr(G, "PAIRS", 500)
    ids = np.random.default_rng(1).permutation(300)
    rows = [(int(i), [0.1, 0.7, 0.3] if i < 200 else [float(i), 1.0, 2.0]) for i in ids]
    vectors = spark.createDataFrame(rows, "cell_id long, v array<double>").coalesce(1)
    got = {}
    for r in G.nearest(vectors, vectors.filter("cell_id in (0, 2, 150, 250)"), 4).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert got == {0: [1, 2, 3, 4], 2: [0, 1, 3, 4], 150: [0, 1, 2, 3], 250: [249, 251, 248, 252]}
