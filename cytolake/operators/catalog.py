"""Catalogues of datasets, layers, embeddings, columns and gene sets, and small rules on result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- datasets -----------------------------------------------------------------------------------------------


def orphans(catalog: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Entries of the catalogue without data; a null key is an orphan."""
    return catalog.join(there.select(key).distinct(), key, "left_anti")


def pruned(catalog: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """The catalogue without its orphans."""
    return catalog.join(there.select(key).distinct(), key, "left_semi")


def listed(catalog: DataFrame, key: str, openable: Column, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """The entries that can be opened, by key, without the columns that hold values."""
    return catalog.filter(openable).drop(*leave_out).orderBy(key)


def resolved(files: DataFrame, dataset: str, layer: str, name: str, precedence: tuple[str, ...]) -> DataFrame:
    """One file a dataset: of the first layer in `precedence` (others last), the first by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, precedence)), F.col(layer)), F.lit(0)), F.lit(len(precedence) + 1))
    best = files.groupBy(dataset).agg(F.min(F.struct(rank.alias("r"), F.col(name).alias("name"), F.col(layer).alias("layer"))).alias("b"))
    return best.select(dataset, F.col("b.layer").alias(layer), F.col("b.name").alias(name))


def expired(sessions: DataFrame, created: str, now: Column, hours: int = 24) -> DataFrame:
    """Sessions older than `hours`; one without a time stays."""
    return sessions.filter(F.col(created) < now - F.expr(f"interval {hours} hours"))


def updated(entries: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Each entry's properties (key, name, value) with those of `changes` in place of its own of the same name; new ones are added."""
    both = entries.withColumn("_v", F.lit(0)).unionByName(changes.withColumn("_v", F.lit(1)))
    return both.groupBy(key, "name").agg(F.max_by("value", "_v").alias("value"))


# --- layers, embeddings, columns ----------------------------------------------------------------------------


def layers(x: DataFrame, n_genes_main: int | None = None) -> DataFrame:
    """layer, label, n_genes, is_default of long values (layer, gene_id, …).  The default is raw, if there is one, else X."""
    sizes = x.groupBy("layer").agg(F.count_distinct("gene_id").alias("n_genes"))
    wide = sizes.agg(F.max(F.when(F.col("layer") == "raw", F.col("n_genes"))).alias("raw"))  # one row
    label = F.when(F.col("layer") == "raw", "Log-normalized (raw)").when((F.col("layer") == "X") & (F.col("n_genes") < F.col("raw")), F.concat(F.lit("Scaled/HVG ("), F.col("n_genes").cast("string"), F.lit(" genes)"))).when(F.col("layer") == "X", "Main matrix (X)").otherwise(F.col("layer"))
    return sizes.join(F.broadcast(wide)).select("layer", label.alias("label"), "n_genes", (F.col("layer") == F.when(F.col("raw").isNotNull(), "raw").otherwise("X")).alias("is_default"))


def embeddings(coords: DataFrame, name: str, vector: str) -> DataFrame:
    """name, dims, n: the embeddings there are."""
    return coords.groupBy(F.col(name).alias("name")).agg(F.max(F.size(vector)).alias("dims"), F.count("*").alias("n"))


def picked(names: list[str], order: tuple[str, ...] = ("X_umap", "X_tsne", "X_pca")) -> str | None:
    """The embedding to show first."""
    return next((x for x in order if x in names), names[0] if names else None)


def pseudotime_columns(obs: DataFrame) -> list[str]:
    """Numeric columns whose name says pseudotime."""
    numeric = {"double", "float", "integer", "long", "short", "byte", "decimal"}
    return [f.name for f in obs.schema.fields if f.dataType.typeName().split("(")[0] in numeric and any(w in f.name.lower() for w in ("pseudotime", "dpt_", "latent_time", "monocle"))]


def groupable(info: DataFrame, kinds: dict[str, str], most: int = 100) -> DataFrame:
    """Columns that cells can be grouped by for enrichment: text, or whole numbers with at most `most` values.  info: column, n_unique, …"""
    kind = F.element_at(F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv)), F.col("column"))
    return info.withColumn("kind", kind).filter((F.col("kind") == "string") | (F.col("kind").isin("int", "bigint", "smallint", "tinyint") & (F.col("n_unique") <= most)))


def toolbar(info: DataFrame, kinds: dict[str, str], n_cells: int, prefix: str = "cluster_") -> DataFrame:
    """Columns to offer, in order: categorical ones first, then own ones (by prefix), then by name.

    Categorical ones need at most 100 values and less than nine tenths of the cells; a bare clustering gives way to an own copy of it.
    """
    kind = F.element_at(F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv)), F.col("column"))
    category, own = kind.isin("string", "boolean"), F.startswith("column", F.lit(prefix))
    copied = [c for c in ("leiden", "louvain") if any(k.startswith(f"{prefix}{c}_r") for k in kinds)]
    kept = info.filter(~F.col("column").isin(copied) & (~category | ((F.col("n_unique") <= 100) & (F.col("n_unique") < 0.9 * n_cells))))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(category), F.desc(own), "column"))  # a row a column
    return kept.select("column", "n_unique", category.alias("categorical"), rank.alias("position"))


def cluster_like(info: DataFrame, kinds: dict[str, str], active: str | None = None) -> list[str]:
    """Columns for markers by default: those named like clusterings with 2 to 100 values, the active one first; else the first categorical one."""
    rows = [r for r in info.select("column", "n_unique").collect() if kinds.get(r["column"]) == "string"]  # a row a column
    found = [r["column"] for r in rows if 2 <= r["n_unique"] <= 100 and any(p in r["column"].lower() for p in ("leiden", "louvain", "cluster", "cell_type", "celltype"))]
    if active and active not in found:
        found.insert(0, active)
    return sorted(found, key=lambda c: c != active) or [r["column"] for r in rows][:1]


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Text columns that two datasets have in common, in the first one's order."""
    text = lambda d: [f.name for f in d.schema.fields if f.dataType.typeName() == "string"]
    return [c for c in text(a) if c in text(b)]


def extremes(rows: DataFrame, column: str) -> DataFrame:
    """lo and hi of the finite values."""
    v = F.col(column).cast("double")
    return rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def condition_split(obs: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values, smallest: columns that split the cells into 2 to 8 values, the four largest with 20 cells and 2 % each."""
    long = obs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s")).select("s.*")
    counts = long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    k = F.count("*").over(Window.partitionBy("column"))
    cells = obs.agg(F.count("*").alias("cells"))
    per = counts.withColumns({"i": rank, "k": k}).filter("i <= 4").groupBy("column").agg(F.first("k").alias("n_values"), F.min("n").alias("smallest"))
    return per.join(F.broadcast(cells)).filter((F.col("n_values") >= 2) & (F.col("n_values") <= 8) & (F.col("smallest") >= F.greatest(F.lit(20.0), 0.02 * F.col("cells")))).select("column", "n_values", "smallest")


def scaling_facts(x: DataFrame, obs: DataFrame, var: DataFrame, cells: int = 2000, genes: int = 100) -> DataFrame:
    """One row: mean_of_means, mean_of_sds (over genes that vary), least, verdict, over the first cells and genes, zeros included."""
    some_cells, some_genes = obs.select("cell_id").orderBy("cell_id").limit(cells), var.select("gene_id").orderBy("gene_id").limit(genes)
    n = some_cells.agg(F.count("*").alias("n"))
    own = x.join(F.broadcast(some_cells), "cell_id", "left_semi").join(F.broadcast(some_genes), "gene_id", "left_semi")
    sums = some_genes.join(own.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("lo"), F.count("*").alias("c")), "gene_id", "left").fillna(0, ["s", "q", "c"])
    each = sums.join(F.broadcast(n)).select((F.col("s") / F.col("n")).alias("m"), F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("sd"), F.when(F.col("c") < F.col("n"), F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo")).alias("lo"))
    varies = F.col("sd") > 1e-6
    one = each.agg(F.avg(F.when(varies, F.col("m"))).alias("mean_of_means"), F.avg(F.when(varies, F.col("sd"))).alias("mean_of_sds"), F.min("lo").alias("least"), F.count_if(varies).alias("k"))
    near = lambda a, lo, hi: (F.abs("mean_of_means") < a) & (F.col("mean_of_sds") > lo) & (F.col("mean_of_sds") < hi)
    verdict = F.when(F.col("least") >= 0, "not scaled").when(F.col("k") < 5, "unknown").when(near(0.5, 0.5, 1.5), "scaled").when(near(1.0, 0.3, 2.0), "possibly scaled").otherwise("not scaled")
    return one.select("mean_of_means", "mean_of_sds", "least", verdict.alias("verdict"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same each time: the first by a hash of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def step_effects(obs: DataFrame, kept: DataFrame, x: DataFrame) -> DataFrame:
    """One row: cells and genes before and after a filter, for the record of the step."""
    seen = x.join(kept.select("cell_id"), "cell_id", "left_semi").agg(F.count_distinct("gene_id").alias("genes_after"))
    one = lambda d, name: d.agg(F.count("*").alias(name))
    return one(obs, "cells_before").join(one(kept, "cells_after")).join(x.agg(F.count_distinct("gene_id").alias("genes_before"))).join(seen)  # one row each


def camera(coords: DataFrame, width: float = 800.0, height: float = 600.0, padding: float = 0.05) -> DataFrame:
    """One row: centre and zoom (log2 of pixels a unit) that show all points with a margin."""
    b = coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = lambda a, z: F.when(F.col(z) > F.col(a), F.col(z) - F.col(a)).otherwise(1.0)
    zoom = F.log2(F.least(width / (side("x0", "x1") * (1 + 2 * padding)), height / (side("y0", "y1") * (1 + 2 * padding))))
    return b.select((F.col("x0") + side("x0", "x1") / 2).alias("cx"), (F.col("y0") + side("y0", "y1") / 2).alias("cy"), zoom.alias("zoom"))


# --- gene sets ----------------------------------------------------------------------------------------------


def gene_set(sets: DataFrame, name: str, collection: str | None = None) -> DataFrame:
    """The genes of a set by its exact name, of the first collection (by `ordinal`) that has it."""
    own = sets.filter(F.col("set_name") == name)
    own = own if collection is None else own.filter(F.col("collection") == collection)
    first = own.agg(F.min("ordinal").alias("_o"))
    return own.join(F.broadcast(first), F.col("ordinal") == F.col("_o")).drop("_o")


def last_wins(sets: DataFrame) -> DataFrame:
    """set_name, collection, gene_id of merged collections: a later one (by `ordinal`) replaces a set of the same name whole."""
    last = sets.groupBy("set_name").agg(F.max("ordinal").alias("ordinal"))
    return sets.join(last, ["set_name", "ordinal"]).select("set_name", "collection", "gene_id")


def first_collection(terms: DataFrame, sets: DataFrame) -> DataFrame:
    """term, collection: the first collection (by `ordinal`) that has a set of this name, null if none has."""
    first = sets.groupBy(F.col("set_name").alias("term")).agg(F.min_by("collection", "ordinal").alias("collection"))
    return terms.join(first, "term", "left")


def nested_catalog(sets: DataFrame) -> DataFrame:
    """collection, n_sets, sets: each collection's sets with their sizes, by name."""
    sizes = sets.groupBy("collection", "set_name").agg(F.count_distinct("gene_id").alias("n_genes"))
    return sizes.groupBy("collection").agg(F.count("*").alias("n_sets"), F.sort_array(F.collect_list(F.struct("set_name", "n_genes"))).alias("sets"))


def found_and_missing(asked: list[str], var: DataFrame) -> DataFrame:
    """position, gene, found of asked names in their order; repeated names come once."""
    names = list(dict.fromkeys(asked))
    rows = var.sparkSession.createDataFrame(list(enumerate(names)), "position int, gene string")
    there = var.select("gene").distinct().withColumn("_f", F.lit(True))
    return rows.join(there, "gene", "left").select("position", "gene", F.coalesce("_f", F.lit(False)).alias("found"))


def mapped(obs: DataFrame, by: str, mapping: DataFrame, target: str, missing: str = "Unknown") -> DataFrame:
    """obs with `target`: the label that `mapping` (group, label) gives a cell's group."""
    own = mapping.select(F.col("group").alias(by), F.col("label").alias(target))
    return obs.drop(target).join(F.broadcast(own), by, "left").withColumn(target, F.coalesce(target, F.lit(missing)))


# --- merging samples ----------------------------------------------------------------------------------------


def merge_warnings(plan: DataFrame, basis: DataFrame, counts: DataFrame) -> DataFrame:
    """warning, one a row: few shared genes, names of different kinds, counts mixed with other values.

    plan, basis, counts: as `ingest.plan_counts`, `id_basis` and `counts_like` give them.
    """
    few = plan.filter("suspicious").select(F.format_string("only %d of %d genes are shared", "shared", "smallest").alias("warning"))
    kinds = basis.agg(F.sort_array(F.collect_set("basis")).alias("k")).filter(F.size("k") > 1).select(F.concat(F.lit("gene names are of different kinds: "), F.array_join("k", ", ")).alias("warning"))
    mixed = counts.agg(F.count_if("counts_like").alias("c"), F.count("*").alias("n")).filter((F.col("c") > 0) & (F.col("c") < F.col("n"))).select(F.format_string("%d of %d samples look like counts", "c", "n").alias("warning"))
    return few.unionByName(kinds).unionByName(mixed)


def reindexed(var: DataFrame, column: str) -> DataFrame:
    """gene_id, gene: names taken from another column; of equal ones all but the first (by gene_id) get "-1", "-2", …; a null one keeps its name."""
    name = F.coalesce(F.col(column).cast("string"), F.col("gene"))
    named = var.select("gene_id", name.alias("gene"))
    i = F.row_number().over(Window.partitionBy("gene").orderBy("gene_id")) - 1
    return named.withColumn("_i", i).select("gene_id", F.when(F.col("_i") > 0, F.concat("gene", F.lit("-"), F.col("_i").cast("string"))).otherwise(F.col("gene")).alias("gene"))


def merged_obs(samples: dict[str, DataFrame], join: str) -> DataFrame:
    """cell, sample and the columns of all samples ("inner": those that all have; "outer": any, null where missing)."""
    columns = [c for d in samples.values() for c in d.columns if c != "cell_id"]
    keep = [c for c in dict.fromkeys(columns) if join == "outer" or all(c in d.columns for d in samples.values())]
    out = None
    for name, d in samples.items():
        own = d.select(F.concat_ws(":", F.col("cell_id").cast("string"), F.lit(name)).alias("cell"), F.lit(name).alias("sample"), *[c for c in keep if c in d.columns])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
