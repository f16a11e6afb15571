"""A dataset as a folder of tables, with its history."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.plans import provenance
from cytolake.plans.pipeline import State


def save(state: State, path: str, mode: str = "errorifexists") -> None:
    """obs, var, x and every result table as Parquet below `path`, and the history as a line of JSON."""
    d = state.data
    for name, table in {"obs": d.obs, "var": d.var, "x": d.x, **({"counts": state.counts} if state.counts is not None else {}), **({"raw": state.raw} if state.raw is not None else {})}.items():
        table.write.mode(mode).parquet(f"{path}/{name}")
    for name, table in state.tables.items():
        table.write.mode(mode).parquet(f"{path}/tables/{name.replace(':', '=')}")
    spark = d.obs.sparkSession
    line = spark.createDataFrame([(provenance.dumped(list(state.history)), state.active_clustering, sorted(state.tables))], "history string, clustering string, tables array<string>")
    line.coalesce(1).write.mode(mode).json(f"{path}/state")


def load(spark: SparkSession, path: str) -> State:
    """The state that `save` has written."""
    line = spark.read.schema("history string, clustering string, tables array<string>").json(f"{path}/state").first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")

    def optional(name: str) -> DataFrame | None:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return read(name) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None

    tables = {name: read(f"tables/{name.replace(':', '=')}") for name in line["tables"]}
    return State(Dataset(read("obs"), read("var"), read("x")), optional("counts"), optional("raw"), tables, line["clustering"], tuple(provenance.loaded(line["history"])))


def info(state: State) -> dict:
    """What there is: sizes, columns, layers, embeddings, clustering and markers."""
    d = state.data
    return {
        "n_cells": d.obs.count(), "n_genes": d.var.count(), "obs_columns": [c for c in d.obs.columns if c != "cell_id"], "layers": [*(["raw"] if state.raw is not None else []), "X", *(["counts"] if state.counts is not None else [])],
        "default_layer": "raw" if state.raw is not None else "X", "embeddings": [k for k in ("layout", "harmony", "pca") if k in state.tables], "clustering": state.active_clustering, "markers_for": sorted(k.split(":", 1)[1] for k in state.tables if k.startswith("markers:")),
    }


def embedded(texts: DataFrame, text: str, embed, batch: int = 64) -> DataFrame:
    """`texts` with a column embedding, by a function of a list of at most `batch` texts; null texts have none.

    embed runs in the tasks, so it has to be something that they can load.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            values = b.column(b.schema.names.index(text)).to_pylist()
            there = [i for i, v in enumerate(values) if v is not None]
            out = [None] * len(values)
            for s in range(0, len(there), batch):
                own = there[s : s + batch]
                for i, v in zip(own, embed([values[i] for i in own]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

    own = texts.drop("embedding")
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def without_results(state: State) -> State:
    """The state before any step: for a fresh start from the counts."""
    return replace(state, tables={}, active_clustering=None, history=(), data=replace(state.data, x=state.counts if state.counts is not None else state.data.x), counts=None, raw=None)


def bars(histogram: DataFrame) -> DataFrame:
    """mid, width, n of a histogram's bins."""
    return histogram.select(((F.col("lower") + F.col("upper")) / 2).alias("mid"), (F.col("upper") - F.col("lower")).alias("width"), "n")
