"""What has been done to a dataset, and what to do next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators import catalog


@dataclass(frozen=True)
class Status:
    step: str
    done: bool
    confidence: str
    details: str = ""


def value_facts(d: Dataset) -> dict:
    """Facts of the stored values, in one pass: extremes, whether they are counts, totals' spread."""
    v = F.col("value")
    one = d.x.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.bool_and((v >= 0) & (F.abs(v - F.round(v)) < 1e-6)).alias("counts")).first()
    return {"least": one["least"] or 0.0, "most": one["most"] or 0.0, "counts": one["counts"] is not False}


def assess(d: Dataset, tables: frozenset[str] = frozenset(), recorded: frozenset[str] = frozenset()) -> list[Status]:
    """A status of each step from the data; what the provenance has recorded is done."""
    f = value_facts(d)
    columns = set(d.obs.columns)
    per_cell = d.x.groupBy("cell_id").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    clusterings = [c for c in d.obs.columns if c.startswith("cluster_") or c in ("leiden", "louvain", "clusters", "seurat_clusters")]
    found = [
        Status("qc_metrics", {"total_counts", "n_genes"} <= columns or "cell_qc" in tables, "high"),
        Status("doublet_detection", "predicted_doublet" in columns, "high"),
        Status("filtering", per_cell >= 200, "medium", f"least genes of a cell: {per_cell}"),
        Status("normalization", not f["counts"], "high" if f["counts"] else "medium"),
        Status("log_transform", not f["counts"] and f["most"] <= 20, "low" if f["least"] < 0 else "medium"),
        Status("highly_variable_genes", "highly_variable" in d.var.columns, "high"),
        _scaling(d, f, tables),
        Status("pca", "pca" in tables, "high"), Status("batch_correction", "harmony" in tables, "high"), Status("neighbors", "graph" in tables, "high"),
        Status("clustering", bool(clusterings), "high", ", ".join(clusterings)), Status("embeddings", "layout" in tables, "high"),
        Status("marker_genes", any(t.startswith("markers") for t in tables), "high"), Status("enrichment", any(t.startswith("enrichment") for t in tables), "high"),
        Status("cell_cycle", "phase" in columns, "high"),
    ]
    return [Status(s.step, True, "high", "recorded") if s.step in recorded else s for s in found]


def _scaling(d: Dataset, f: dict, tables: frozenset[str]) -> Status:
    """Scaled values lie about 0 with a spread of about 1 per gene; counts never do."""
    if "scale_factors" in tables:
        return Status("scaling", True, "high", "factors are there")
    if f["counts"]:
        return Status("scaling", False, "high", "raw counts")
    facts = catalog.scaling_facts(d.x, d.obs, d.var).first()
    told = {"scaled": (True, "high"), "possibly scaled": (True, "medium"), "unknown": (False, "low"), "not scaled": (False, "high" if (facts["least"] or 0) >= 0 else "medium")}
    return Status("scaling", *told[facts["verdict"]], facts["verdict"])


# What the name of a column that tells batches or conditions holds, and what that of cell types does.
CONDITION = ["condition", "stim", "treat", "disease", "status", "genotype", "batch", "donor", "patient", "sample", "orig.ident", "origident", "group", "timepoint", "sex", "tissue"]
CELL_TYPE = ["cell_type", "celltype"]


def condition_columns(columns: list[str]) -> list[str]:
    """Columns whose name says batch or condition, and not cell type."""
    has = lambda c, words: any(w in c.lower() for w in words)
    return [c for c in columns if has(c, CONDITION) and not has(c, CELL_TYPE)]


def recommended(n_cells: int, n_genes: int) -> dict:
    """Parameters by size."""
    k, pcs, resolution = (10, 20, 0.8) if n_cells < 5_000 else (15, 50, 1.0) if n_cells < 50_000 else (20, 50, 1.0)
    return {"n_neighbors": k, "n_comps": pcs, "resolution": resolution, "n_top_genes": min(2000, n_genes - 1) if n_genes > 2000 else max(500, n_genes // 2)}


def default_steps(statuses: list[Status]) -> list[str]:
    """Steps to run: those not done, but not the two that need a choice."""
    return [s.step for s in statuses if not s.done and s.step not in ("batch_correction", "enrichment")]


def insight(d: Dataset, statuses: list[Status], *, pct_mt: DataFrame | None = None) -> str:
    """The one thing to look at next."""
    done = {s.step for s in statuses if s.done}
    if "normalization" not in done:
        return "raw counts: normalise first"
    if "predicted_doublet" in d.obs.columns and (d.obs.agg(F.avg(F.col("predicted_doublet").cast("double"))).first()[0] or 0) >= 0.08:
        return "many doublets: drop them"
    if pct_mt is not None and (pct_mt.agg(F.median("pct_mt")).first()[0] or 0) >= 15:
        return "high mitochondrial share: filter"
    named = condition_columns(d.obs.columns)
    if named and "batch_correction" not in done:
        split = {r["column"] for r in catalog.condition_split(d.obs, named).collect()}  # a row a column
        first = next((c for c in named if c in split), None)
        if first:
            return f"cells split by {first}: correct for batches"
    if "clustering" not in done:
        return "no clusters yet"
    if not any(c == "cell_type" or c.endswith("_cell_type") for c in d.obs.columns):
        return "clusters have no labels"
    return "done"
