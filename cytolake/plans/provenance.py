"""Provenance of processing steps: a history table, its chain, and what a change makes stale.

Which step uses what another one made is a relation of two columns.  Its closure
(`upstream`) is read off in one pass, as the steps are listed in an order in which
they can run; everything about re-runs is a filter on it.  Histories are rows,
so they are stored, joined and compared as DataFrames too.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The steps in the order they run, and what each uses.
USES = (
    ("reset_to_counts", ""),
    ("qc_metrics", ""),
    ("doublet_detection", "qc_metrics"),
    ("filtering", "qc_metrics"),
    ("normalization", "filtering"),
    ("log_transform", "normalization"),
    ("highly_variable_genes", "log_transform"),
    ("scaling", "highly_variable_genes"),
    ("pca", "scaling"),
    ("batch_correction", "pca"),
    ("neighbors", "pca batch_correction"),
    ("clustering", "neighbors"),
    ("embeddings", "neighbors"),
    ("marker_genes", "clustering"),
    ("enrichment", "marker_genes"),
    ("cell_cycle", "log_transform"),
    ("cell_type_annotation", "clustering"),
)
ORDER = tuple(step for step, _ in USES)
#: Steps that only add to what is there: they can run again without the matrix or the graph being made anew.
ADDING = frozenset("clustering embeddings marker_genes enrichment cell_cycle cell_type_annotation".split())


def _closure() -> dict[str, frozenset[str]]:
    found: dict[str, frozenset[str]] = {}
    for step, used in USES:
        found[step] = frozenset(used.split()).union(*(found[u] for u in used.split()))
    return found


#: Every step with all it rests on, directly or through others.
UPSTREAM = _closure()


def stale(ran: DataFrame | None, edited: str, spark: SparkSession | None = None) -> DataFrame:
    """step, position, state of the steps that ran, or of all if no table is given, when the parameters of `edited` change.

    state: "rerun" for the edited step and what rests on it, "kept" for the rest.
    ran: one column, step; steps that repeat count once, unknown ones and null are left out.
    """
    spark = spark or ran.sparkSession
    relation = spark.createDataFrame([(s, i, s == edited or edited in UPSTREAM[s]) for i, s in enumerate(ORDER)], "step string, position int, _hit boolean")
    own = relation if ran is None else relation.join(ran.select("step").distinct().withColumn("_ran", F.lit(True)), "step", "left").filter(F.col("_ran") | (F.col("step") == edited))
    return own.select("step", "position", F.when(F.col("_hit"), "rerun").otherwise("kept").alias("state"))


@dataclass(frozen=True)
class Rerun:
    rerun: list[str]
    kept: list[str]
    requires_reprocess: bool


def plan_rerun(ran: list[str], edited: str) -> Rerun:
    """What has to run again after a step's parameters changed, and what stays.

    A step that makes the matrix or the graph needs all to be processed from the counts.
    """
    if edited not in UPSTREAM:
        raise ValueError(f"unknown step {edited}")
    there = [s for s in ORDER if s == edited or s in ran]
    again = [s for s in there if s == edited or edited in UPSTREAM[s]]
    return Rerun(again, [s for s in there if s not in again], edited not in ADDING)


@dataclass(frozen=True)
class Commit:
    """A step that ran."""

    commit_id: str
    parent: str | None
    step: str
    params: dict
    timestamp: str
    effect: dict = field(default_factory=dict)
    note: str = ""


def named(parent: str | None, step: str, params: dict, timestamp: str) -> str:
    """Twelve hex digits that stand for a commit's content and, through its parent, for all before it."""
    digest = hashlib.sha1(f"{parent or 'root'}\n{timestamp}\n{step}\n".encode())
    for key in sorted(params):
        digest.update(f"{key}={json.dumps(params[key], sort_keys=True, default=str)}\n".encode())
    return digest.hexdigest()[:12]


def record(history: list[Commit], step: str, params: dict, timestamp: str, effect: dict | None = None, note: str = "") -> list[Commit]:
    """The history with one more commit, whose parent is the last; parameters without a value are left out."""
    listed = {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}
    clean = {k: v for k, v in listed.items() if v is not None and v != "" and v != []}
    parent = history[-1].commit_id if history else None
    return [*history, Commit(named(parent, step, clean, timestamp), parent, step, clean, timestamp, effect or {}, note)]


def dumped(history: list[Commit]) -> str:
    return json.dumps({"version": 2, "commits": [asdict(c) for c in history]})


def loaded(text: str | None) -> list[Commit]:
    """A stored history; what can't be read is an empty one."""
    known = {f.name for f in fields(Commit)}
    try:
        return [Commit(**{k: v for k, v in c.items() if k in known}) for c in json.loads(text or "{}").get("commits", [])]
    except (ValueError, TypeError, AttributeError):
        return []


def recipe(history: list[Commit]) -> list[tuple[str, dict]]:
    """Steps and parameters, to do the same to another dataset."""
    return [(c.step, c.params) for c in history]


def mismatches(claims: dict[str, list[str]], there: dict[str, list[str]]) -> list[str]:
    """What a record says there is (by kind: embeddings, columns, markers) and the data doesn't have."""
    return [f"{kind}: {name} is recorded and not there" for kind in sorted(claims) for name in claims[kind] if name not in there.get(kind, [])]


def methods_text(history: list[Commit]) -> str:
    """A paragraph of what was done, one clause a step, with its parameters; of a repeated step the last counts."""
    last = {c.step: c for c in history}
    said = [f"{s.replace('_', ' ')}{' (' + ', '.join(f'{k} = {v}' for k, v in sorted(last[s].params.items())) + ')' if last[s].params else ''}" for s in ORDER if s in last]
    return f"Processing: {'; '.join(said)}." if said else ""


def chain(events: DataFrame, by: str, order: list[str], payload: Column) -> DataFrame:
    """Each row as a commit named by its content, with the one before it in its own chain as parent."""
    with_id = events.withColumn("commit_id", F.substring(F.sha1(payload), 1, 12))
    return with_id.withColumn("parent", F.lag("commit_id").over(Window.partitionBy(by).orderBy(*order)))
