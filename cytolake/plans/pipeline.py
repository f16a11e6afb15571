"""The preprocessing pipeline: named steps over an immutable dataset, in one canonical order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators import catalog, celltypes, graph, qc, stats
from cytolake.plans import provenance
from cytolake.sources.tables import stored


@dataclass(frozen=True)
class Params:
    """Parameters of all steps, with their defaults."""

    min_genes: int = 200
    min_cells: int = 3
    max_pct_mt: float = 20.0
    drop_doublets: bool = False
    doublet_rate: float = 0.06
    target_sum: float = 1e4
    n_top_genes: int = 2000
    n_comps: int = 50
    n_neighbors: int = 15
    resolution: float = 0.5
    layout_dims: int = 2
    batch_key: str = ""
    marker_columns: tuple[str, ...] = ()
    enrichment_n_genes: int = 100
    annotation_target: str = "cell_type"
    annotator: Callable[[dict[str, DataFrame], str], DataFrame] | None = None

    #: What a user may choose.
    BOUNDS = {"doublet_rate": (0, 0.5), "min_genes": (0, 5000), "min_cells": (0, 100), "max_pct_mt": (0, 100), "target_sum": (1e3, 1e5), "n_top_genes": (500, 10000), "n_comps": (10, 200), "n_neighbors": (5, 100), "resolution": (0.1, 3), "layout_dims": (2, 3), "enrichment_n_genes": (10, 500)}  # noqa: RUF012

    def problems(self) -> list[str]:
        return [f"{k} is outside {lo} to {hi}" for k, (lo, hi) in self.BOUNDS.items() if not lo <= getattr(self, k) <= hi]


@dataclass(frozen=True)
class State:
    """A dataset with what the steps have made so far."""

    data: Dataset
    counts: DataFrame | None = None  # values before normalisation
    raw: DataFrame | None = None  # log values of all genes, before genes are chosen
    tables: dict[str, DataFrame] = field(default_factory=dict)
    active_clustering: str | None = None
    history: tuple[provenance.Commit, ...] = ()

    def put(self, **tables: DataFrame) -> State:
        return replace(self, tables={**self.tables, **tables})


def _reset(s: State, p: Params) -> State:
    source = s.counts if s.counts is not None else s.raw
    drop = [c for c in s.data.obs.columns if c.startswith("cluster_") or c in ("doublet_score", "predicted_doublet")]
    return State(Dataset(s.data.obs.drop(*drop), s.data.var.drop("highly_variable"), s.data.x if source is None else source), history=s.history)


def _qc(s: State, p: Params) -> State:
    return s.put(cell_qc=qc.cell_qc(s.data), gene_qc=qc.gene_qc(s.data))


def _doublets(s: State, p: Params) -> State:
    counts = s.data if s.counts is None else s.data.with_x(s.counts)
    chosen = qc.highly_variable(qc.log1p(qc.normalized(counts, p.target_sum)), p.n_top_genes).filter("highly_variable")
    scores = stored(graph.doublet_scores(counts.x, counts.obs, chosen.select("gene_id"), rate=p.doublet_rate), "doublets")
    return replace(s, data=replace(s.data, obs=s.data.obs.drop("doublet_score", "predicted_doublet").join(scores, "cell_id", "left")))


def _filter(s: State, p: Params) -> State:
    drop = "predicted_doublet" if p.drop_doublets and "predicted_doublet" in s.data.obs.columns else None
    return replace(s, data=qc.filtered(s.data, min_genes=p.min_genes, min_cells=p.min_cells, max_pct_mt=p.max_pct_mt, doublets=drop))


def _normalize(s: State, p: Params) -> State:
    return replace(s, data=qc.normalized(s.data, p.target_sum), counts=s.data.x if s.counts is None else s.counts)


def _log(s: State, p: Params) -> State:
    return replace(s, data=qc.log1p(s.data))


def _hvg(s: State, p: Params) -> State:
    h = qc.highly_variable(s.data, p.n_top_genes).select("gene_id", "highly_variable")
    return replace(s, data=replace(s.data, var=s.data.var.drop("highly_variable").join(h, "gene_id", "left")))


def _scale(s: State, p: Params) -> State:
    return replace(s.put(scale_factors=qc.scale_factors(s.data)), raw=s.data.x)


def _pca(s: State, p: Params) -> State:
    """Components of the chosen genes (all, if none were chosen), scaled and clipped where the scaling step ran."""
    var = s.data.var.filter("highly_variable") if "highly_variable" in s.data.var.columns else s.data.var
    transform = None
    if "scale_factors" in s.tables:
        rows = s.tables["scale_factors"].join(var.select("gene_id"), "gene_id", "left_semi").orderBy("gene_id").select("mean", "sd").collect()  # a row a chosen gene
        mean, sd = np.array([r["mean"] for r in rows]), np.array([r["sd"] for r in rows])
        transform = lambda v: np.clip((v - mean) / np.where(sd > 0, sd, 1.0), -10, 10)
    vectors = stored(graph.dense(s.data.x, var.select("gene_id"), s.data.obs, transform), "rows")
    scores, ratios = graph.principal_components(vectors, p.n_comps)
    spark = s.data.x.sparkSession
    return s.put(pca=stored(scores, "pca"), variance_ratio=spark.createDataFrame(list(enumerate(ratios)), "component int, ratio double"))


def _batch(s: State, p: Params) -> State:
    if not p.batch_key or p.batch_key not in s.data.obs.columns or "pca" not in s.tables:
        raise ValueError("batch correction needs a batch column and components")
    rows = s.tables["pca"].join(s.data.obs.select("cell_id", F.col(p.batch_key).alias("batch")), "cell_id").select("cell_id", "batch", F.col("pc").alias("v"))
    return s.put(harmony=stored(graph.corrected(rows), "harmony"))


def _neighbors(s: State, p: Params) -> State:
    rep = s.tables["harmony"] if "harmony" in s.tables else s.tables["pca"].select("cell_id", F.col("pc").alias("v"))
    return s.put(graph=stored(graph.fuzzy_graph(graph.neighbours(rep, p.n_neighbors - 1)), "graph"))


def _cluster(s: State, p: Params) -> State:
    name = f"cluster_louvain_r{p.resolution}".replace(".", "_")  # a dot would need quoting in every select
    labels = graph.communities(s.tables["graph"], p.resolution).withColumnRenamed("community", name)
    return replace(s, data=replace(s.data, obs=s.data.obs.drop(name).join(labels, "cell_id", "left")), active_clustering=name)


def _layout(s: State, p: Params) -> State:
    start = s.tables["pca"].select("cell_id", *(F.col("pc")[i].alias(c) for i, c in enumerate("xyz"[: p.layout_dims])))
    return s.put(layout=graph.layout(s.tables["graph"], start))


def grouping_columns(s: State, asked: tuple[str, ...]) -> list[str]:
    """The active clustering and what is asked for; else the first usual column that is there."""
    first = [c for c in (s.active_clustering, *asked) if c and c in s.data.obs.columns]
    usual = [c for c in ("leiden", "louvain", "cluster", "clusters", "seurat_clusters", "cell_type") if c in s.data.obs.columns]
    return list(dict.fromkeys(first)) or usual[:1]


def _markers(s: State, p: Params) -> State:
    columns = grouping_columns(s, p.marker_columns)
    if not columns:
        raise ValueError("no column to group by")
    d = s.data.with_x(s.raw) if s.raw is not None else s.data
    return s.put(**{f"markers:{c}": stats.rank_sums(d, s.data.obs.filter(F.col(c).isNotNull()).select("cell_id", F.col(c).cast("string").alias("group"))) for c in columns})


def _enrich(s: State, p: Params) -> State:
    if "set_name" not in s.data.var.columns:
        raise ValueError("no gene sets")
    sets = s.data.var.select(F.col("set_name").alias("term"), "gene_id")
    found = {k.split(":", 1)[1]: v for k, v in s.tables.items() if k.startswith("markers:")}
    return s.put(**{f"enrichment:{c}": stats.over_representation(stats.top_markers(m, p.enrichment_n_genes).select("group", "gene_id"), sets) for c, m in found.items()})


def _logged(s: State) -> Dataset:
    return s.data.with_x(s.raw) if s.raw is not None else s.data


def _cycle(s: State, p: Params) -> State:
    phases = stored(celltypes.cell_cycle(_logged(s)), "phases")
    return replace(s, data=replace(s.data, obs=s.data.obs.drop("s_score", "g2m_score", "phase").join(phases, "cell_id", "left")))


def _annotate(s: State, p: Params) -> State:
    """A cell-type column by cluster: by marker sets, or by a function of the caller's (a model behind it, for instance)."""
    columns = grouping_columns(s, ())
    if not columns:
        raise ValueError("annotation needs a clustering")
    if p.annotator is not None:
        labels = p.annotator({k: v for k, v in s.tables.items() if k.startswith("markers:")}, columns[0])
    else:
        labels = stored(celltypes.by_markers(_logged(s), columns[0]), "labels")
    obs = s.data.obs.withColumn("_group", F.col(columns[0]).cast("string"))
    return replace(s.put(annotation=labels), data=replace(s.data, obs=catalog.mapped(obs, "_group", labels, p.annotation_target).drop("_group")))


STEPS: dict[str, Callable[[State, Params], State]] = {
    "reset_to_counts": _reset, "qc_metrics": _qc, "doublet_detection": _doublets, "filtering": _filter, "normalization": _normalize, "log_transform": _log, "highly_variable_genes": _hvg, "scaling": _scale, "pca": _pca,
    "batch_correction": _batch, "neighbors": _neighbors, "clustering": _cluster, "embeddings": _layout, "marker_genes": _markers, "enrichment": _enrich,
    "cell_cycle": _cycle, "cell_type_annotation": _annotate,
}


@dataclass(frozen=True)
class Event:
    kind: str  # step_start, step_done, step_error, complete
    step: str | None = None
    message: str = ""
    state: State | None = None


def _settled(after: State, before: State) -> tuple[State, dict]:
    """The state with what a step has made new in tables, so that its errors are its own and no later step does its work again; and its effect."""
    keep = lambda new, old, name: new if new is old else stored(new, name)
    d, was = after.data, before.data
    data = Dataset(keep(d.obs, was.obs, "obs"), keep(d.var, was.var, "var"), keep(d.x, was.x, "x"))
    tables = {k: v if v is before.tables.get(k) else stored(v, "table") for k, v in after.tables.items()}
    effect = {"n_cells": data.obs.count(), "n_genes": data.var.count()} if data.obs is not was.obs or data.var is not was.var else {}
    return replace(after, data=data, tables=tables), effect


def run(state: State, steps: list[str], params: Params | None = None, now: Callable[[], str] | None = None) -> Iterator[Event]:
    """Run steps in their canonical order; unknown ones are passed over, one that fails is reported and the others go on."""
    params = params or Params()
    now = now or (lambda: datetime.now(UTC).isoformat())
    for step in [x for x in provenance.ORDER if x in set(steps) and x in STEPS]:
        yield Event("step_start", step)
        try:
            after = STEPS[step](state, params)
            after, effect = _settled(after, state)
        except Exception as error:  # noqa: BLE001  the step's own failure is its result
            yield Event("step_error", step, str(error).splitlines()[0])
            continue
        used = {k: v for k, v in vars(params).items() if k != "annotator"}
        state = replace(after, history=tuple(provenance.record(list(after.history), step, used, now(), effect)))
        yield Event("step_done", step, state=state)
    yield Event("complete", state=state)


def stored_markers(state: State, column: str, group: str | None = None, n: int = 100) -> DataFrame:
    """The n first stored markers of each group of a column (or of one group); those of a column without any are computed."""
    found = state.tables.get(f"markers:{column}")
    if found is None:
        d = state.data.with_x(state.raw) if state.raw is not None else state.data
        return stats.markers_of(d, column, n, group)
    return stats.top_markers(found if group is None else found.filter(F.col("group") == group), n)


def stored_enrichment(state: State, column: str, group: str, most: int = 50) -> DataFrame:
    """The first stored terms of a column's group; a column that has none is an error that says which have."""
    found = state.tables.get(f"enrichment:{column}")
    if found is None:
        there = sorted(k.split(":", 1)[1] for k in state.tables if k.startswith("enrichment:"))
        raise ValueError(f"no enrichment by {column!r}; there is: {', '.join(there) or 'none'}")
    return stats.enrichment_top(found.filter(F.col("group") == group), most)


def reprocess(state: State, params: Params | None = None, steps: list[str] | None = None, now: Callable[[], str] | None = None) -> Iterator[Event]:
    """Everything again from the counts: the steps that the history has (or those named), with new parameters."""
    again = [c.step for c in state.history] if steps is None else steps
    yield from run(replace(state, history=()), ["reset_to_counts", *again], params, now)
