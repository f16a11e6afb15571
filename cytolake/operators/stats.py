"""Rank-sum markers, over-representation and gene-set scores, without stored zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.sources.tables import stored

#: Coefficients of a published rational approximation of erfc (fractional error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """P(|N| > |z|) = erfc(|z| / sqrt 2)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_sql(z: str) -> str:
    x = f"(abs({z}) / 1.4142135623730951)"
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def benjamini_hochberg(tests: DataFrame, p: str, by: list[str], tie: str, alias: str = "padj") -> DataFrame:
    """Adjusted p-values within `by`: the least of p m / rank over this and all larger p, at most 1.

    Tests are dealt out by ranges of `by` and p, so those of one group are ranked by many tasks: ranks in a range are moved
    up by the sizes of the ranges before, and the least of a range counts for those before it.
    """
    dealt = stored(tests.repartitionByRange(*by, p, tie).withColumn("_part", F.spark_partition_id()), "tests")
    within = [*by, "_part"]

    def joined(rows: DataFrame, parts: DataFrame) -> DataFrame:  # a row a group and range; a group may be null
        named = parts.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(within)})
        same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(within)]
        return rows.join(F.broadcast(named), same).drop(*(f"_by{i}" for i in range(len(within))))

    ranges = Window.partitionBy(*by).orderBy("_part")
    sizes = dealt.groupBy(*within).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumns({"_m": F.sum("_n").over(Window.partitionBy(*by)), "_before": F.sum("_n").over(ranges) - F.col("_n")}).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(p, tie)) + F.col("_before")
    ranked = joined(dealt, sizes).withColumn("_q", F.col(p) * F.col("_m") / rank).drop("_m", "_before")
    least = ranked.groupBy(*within).agg(F.min("_q").alias("_least"))
    least = least.withColumn("_later", F.min("_least").over(ranges.rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    after = Window.partitionBy(*within).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return joined(ranked.withColumn("_q", F.min("_q").over(after)), least).withColumn(alias, F.least(F.lit(1.0), "_q", "_later")).drop("_q", "_later", "_part")


_RANKED = "part int, gene_id long, group string, m long, neg long, pos long, s double, ranks double, run double, less long, cut boolean, nnz long, all_neg long, ts double"


def _ranked_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gene_id, value, group) sorted by gene, as rows of _RANKED: per gene and group, what the ranks within this partition sum to.

    The values at which a partition's first gene begins and its last one ends may go on in the
    partitions beside it: those are given by themselves (run, and how many values are less here), and what is given of
    such a gene is marked (cut); of all others nnz, all_neg and ts are the sums over groups.
    The genes that end in a batch are ranked together, as there may be many of few values.
    """
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    first = True

    def genes(rows: list[pa.RecordBatch], last: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        gene, value, coded = t["gene_id"].to_numpy(), t["value"].to_numpy(), t["group"].combine_chunks().dictionary_encode("encode")
        order = np.lexsort((value, gene))
        gene, value = gene[order], value[order]
        code, k = coded.indices.to_numpy().astype(np.int64)[order], len(coded.dictionary)
        begins = np.append(True, gene[1:] != gene[:-1])
        starts = np.flatnonzero(begins | np.append(True, value[1:] != value[:-1]))
        size = np.diff(np.append(starts, len(value)))
        run, which, own = np.repeat(np.arange(len(starts)), size), np.cumsum(begins) - 1, np.flatnonzero(begins)
        less = starts - own[which[starts]]
        apart = np.zeros(len(starts), bool)
        apart[0] |= first
        apart[-1] |= last
        inner = ~apart[run]
        keys, at = np.unique((which * k + code)[inner], return_inverse=True)
        sums = lambda w: np.bincount(at, w[inner], minlength=len(keys))
        cut = np.zeros(len(own), bool)
        cut[0] |= first
        cut[-1] |= last
        of_gene = [np.bincount(which, w, minlength=len(own))[keys // k] for w in (None, value < 0, value)]
        columns = [[gene[own[keys // k]], keys % k, np.bincount(at, minlength=len(keys)), sums(value < 0), sums(value > 0), sums(value), sums(less[run] + (size[run] + 1) / 2.0), np.zeros(len(keys)), np.zeros(len(keys), np.int64), np.ones(len(keys), bool), cut[keys // k], *of_gene]]
        for i in np.flatnonzero(apart):
            v, all_ = value[starts[i]], np.bincount(code[run == i], minlength=k)
            some = np.flatnonzero(all_)
            m, one = all_[some], np.ones(len(some))
            columns.append([np.repeat(gene[starts[i]], len(some)), some, m, m * (v < 0), m * (v > 0), m * v, 0.0 * one, v * one, np.repeat(less[i], len(some)), np.zeros(len(some), bool), np.ones(len(some), bool), *(0 * m for _ in range(3))])
        at_gene, group, m, neg, pos, s, ranks, runs, lower, whole, cut, nnz, all_neg, ts = (np.concatenate(c) for c in zip(*columns, strict=True))
        whole_numbers = [pa.array(c.astype(np.int64)) for c in (at_gene, m, neg, pos)]
        made = [pa.array([part] * len(m), pa.int32()), whole_numbers[0], coded.dictionary.take(pa.array(group)), *whole_numbers[1:], pa.array(s), pa.array(ranks), pa.array(runs, mask=whole), pa.array(lower, mask=whole), pa.array(cut), pa.array(nnz.astype(np.int64)), pa.array(all_neg.astype(np.int64)), pa.array(ts.astype(np.float64))]
        return pa.RecordBatch.from_arrays(made, names=["part", "gene_id", "group", "m", "neg", "pos", "s", "ranks", "run", "less", "cut", "nnz", "all_neg", "ts"])

    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))  # the last gene may go on in the next batch
        if cut or (held and held[-1].column(0)[-1].as_py() != int(g[0])):
            yield genes([*held, b.slice(0, cut)], False)
            held, first = [], False
        held.append(b.slice(cut))
    if held:
        yield genes(held, True)


def rank_sums(d: Dataset, groups: DataFrame, only: str | None = None) -> DataFrame:
    """One-against-rest Wilcoxon of every gene and group: group, gene_id, z, pval, padj, lfc, pct_in, pct_out.

    groups: cell_id, group.  only: the one group to test.  Ranks are average ranks over all cells: stored
    values rank among themselves above (below) the block of zeros, and a
    group's cells without a stored value take the block's rank.  Values are dealt out by ranges of gene, value and cell, so a
    gene that all cells have, or a value that most have, is ranked by many tasks; ranks within a partition are moved up by the sizes of those before.  That is only for
    the genes that a partition begins or ends with: all others are whole in it.
    No tie correction.  lfc: log2 of the ratio of mean expm1 values.
    """
    n = groups.groupBy("group").agg(F.count("*").alias("ng"))
    cells = groups.agg(F.count("*").alias("n"))
    rows = stored(d.x.join(groups, "cell_id").select("gene_id", F.col("value").cast("double").alias("value"), F.col("group").cast("string").alias("group"), "cell_id"), "values")
    order = rows.repartitionByRange("gene_id", "value", "cell_id").sortWithinPartitions("gene_id").select("gene_id", "value", "group")
    ranked = stored(order.mapInArrow(_ranked_within, _RANKED), "ranked")
    own, inner = ranked.filter("cut"), ranked.filter("not cut")
    gene = Window.partitionBy("gene_id")
    before = F.coalesce(F.sum("m").over(gene.orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = Window.partitionBy("gene_id", "run")
    tied = F.min(F.col("before") + F.col("less")).over(same) + (F.sum("m").over(same) + 1) / 2.0
    placed = own.withColumn("before", before).withColumn("r", F.when(F.col("run").isNull(), F.col("ranks") + F.col("before") * F.col("m")).otherwise(F.col("m") * tied))
    # the log ratio wants the mean of the values before log1p
    sums = placed.groupBy("gene_id", "group").agg(F.sum("r").alias("rs"), F.sum("m").alias("nz"), F.sum("s").alias("s"), F.sum("neg").alias("_neg"), F.sum("pos").alias("pos"))
    sums = sums.withColumns({"nnz": F.sum("nz").over(gene), "neg": F.sum("_neg").over(gene), "ts": F.sum("s").over(gene)}).join(F.broadcast(cells))  # cells is one row
    lifted = (F.col("rs") + F.col("pos") * (F.col("n") - F.col("nnz"))).alias("rs")
    cut = stored(sums.select("gene_id", "group", lifted, "nz", "s", "nnz", "neg", "ts"), "ranks")
    inner = inner.join(F.broadcast(cells)).withColumnRenamed("ranks", "rs").select("gene_id", "group", lifted, F.col("m").alias("nz"), "s", "nnz", F.col("all_neg").alias("neg"), "ts")
    part = cut.unionByName(inner)
    total = part.groupBy("gene_id").agg(F.first("nnz").alias("nnz"), F.first("neg").alias("neg"), F.first("ts").alias("ts"))
    if only is not None:
        n, part = n.filter(F.col("group") == only), part.filter(F.col("group") == only)
    grid = d.var.select("gene_id").join(F.broadcast(n.join(cells)))  # groups are few
    full = grid.join(total, "gene_id", "left").fillna(0, ["nnz", "neg", "ts"]).join(part.select("gene_id", "group", "rs", "nz", "s"), ["gene_id", "group"], "left").fillna(0, ["rs", "nz", "s"])
    ng, all_, nz = F.col("ng"), F.col("n"), F.col("nz")
    block = F.col("neg") + (all_ - F.col("nnz") + 1) / 2.0
    r = F.col("rs") + (ng - nz) * block
    sd = F.sqrt(ng * (all_ - ng) * (all_ + 1) / 12.0)
    mean_in, mean_out = F.col("s") / ng, F.try_divide(F.col("ts") - F.col("s"), all_ - ng)
    scored = full.select(
        "group", "gene_id", F.try_divide(r - ng * (all_ + 1) / 2.0, sd).alias("z"), F.log2((F.expm1(mean_in) + 1e-9) / (F.expm1(mean_out) + 1e-9)).alias("lfc"),
        (nz / ng).alias("pct_in"), F.try_divide(F.col("nnz") - nz, all_ - ng).alias("pct_out"),
    ).filter("z is not null").withColumn("pval", two_sided(F.col("z")))
    return benjamini_hochberg(stored(scored, "scored"), "pval", ["group"], "gene_id")  # ranges of p are read twice


def selection_against_rest(d: Dataset, indices: list[int] | DataFrame) -> DataFrame:
    """Markers of a selection of cells (ids, or a table with cell_id); repeated and absent ids don't count, and each side needs three cells."""
    if isinstance(indices, list):
        indices = d.obs.sparkSession.createDataFrame([(i,) for i in indices], "cell_id long")
    wanted = indices.select("cell_id").filter("cell_id >= 0").distinct().withColumn("_in", F.lit(True))
    groups = d.obs.select("cell_id").join(wanted, "cell_id", "left").select("cell_id", F.when(F.col("_in"), "selection").otherwise("rest").alias("group"))
    sizes = dict(groups.groupBy("group").count().collect())
    if min(sizes.get("selection", 0), sizes.get("rest", 0)) < 3:
        raise ValueError("the selection and the rest need three cells each")
    return rank_sums(d, groups, only="selection").drop("group")


def volcano(de: DataFrame, fold: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """y = -log10 of padj (1e-300 at least), and up, down or ns."""
    sig = (F.col("padj") <= alpha) & (F.abs("lfc") >= fold)
    return de.withColumns({"y": -F.log10(F.greatest("padj", F.lit(1e-300))), "class": F.when(sig & (F.col("lfc") > 0), "up").when(sig, "down").otherwise("ns")})


def significant(de: DataFrame, fold: float = 1.0, alpha: float = 0.05, most: int = 200) -> DataFrame:
    """Genes with padj <= alpha and |lfc| >= fold, by padj, then the larger |lfc|, then gene_id; the first `most`."""
    return de.filter((F.col("padj") <= alpha) & (F.abs("lfc") >= fold)).orderBy("padj", F.desc(F.abs("lfc")), "gene_id").limit(most)


def marker_table(markers: DataFrame, text: str = "", least_lfc: float = 0.0, sort: str = "score", descending: bool = True, names: DataFrame | None = None) -> DataFrame:
    """Markers whose gene contains `text` in any case and whose |lfc| is at least `least_lfc`, in the order of a column, then gene.

    sort: gene, lfc, pval, padj, pct_in or score (z).  names: gene_id, gene.
    """
    rows = markers if names is None else markers.join(names.select("gene_id", "gene"), "gene_id")
    found = rows.filter(F.contains(F.lower("gene"), F.lit(text.lower())) & (F.abs("lfc") >= least_lfc))
    key = F.col("z" if sort == "score" else sort)
    return found.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "group", "gene")


def enrichment_top(enriched: DataFrame, n: int) -> DataFrame:
    """The first n terms of each group, by padj, then pval, then name."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy("padj", "pval", "term"))
    return enriched.withColumn("rank", rank).filter(F.col("rank") <= n)


def enrichment_groups(markers: DataFrame, enriched: DataFrame) -> DataFrame:
    """group, n_markers, computed: the groups that have markers, and whether they have enrichment."""
    done = enriched.select("group").distinct().withColumn("_e", F.lit(True))
    return markers.groupBy("group").agg(F.count("*").alias("n_markers")).join(done, "group", "left").select("group", "n_markers", F.coalesce("_e", F.lit(False)).alias("computed"))


def top_markers(markers: DataFrame, n: int) -> DataFrame:
    return markers.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("z"), "gene_id"))).filter(F.col("rank") <= n)


def markers_of(d: Dataset, column: str, n: int = 100, group: str | None = None) -> DataFrame:
    """The n first markers of each value of any column of obs (or of one value), with their rank; fewer than two values are an error."""
    if column not in d.obs.columns:
        raise ValueError(f"no column {column!r}")
    groups = d.obs.filter(F.col(column).isNotNull()).select("cell_id", F.col(column).cast("string").alias("group"))
    if groups.select("group").distinct().limit(2).count() < 2:
        raise ValueError(f"column {column!r} has one group only; markers need two")
    return top_markers(rank_sums(d, groups, only=group), n)


def search_sets(sets: DataFrame, text: str, most: int = 40) -> DataFrame:
    """collection, set_name, n_genes of the gene sets (collection, set_name, gene_id) whose name contains a text in any case; the first `most` by name."""
    found = sets.filter(F.contains(F.upper("set_name"), F.upper(F.lit(text))))
    return found.groupBy("collection", "set_name").agg(F.count("*").alias("n_genes")).orderBy("collection", "set_name").limit(most)


def log_factorial(n: Column) -> Column:
    """ln n! of whole n >= 0, by Stirling's series at n + 9 (error below 1e-12 of the value)."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * F.pow(x, 5))
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n.cast("double") + float(i))
    return series - F.log(product)


def over_representation(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """group, term, overlap, set_size, pval, padj: hypergeometric tails of gene sets among each group's genes.

    queries: group, gene_id; sets: term, gene_id.  The population is the union
    of the sets; genes outside of it don't count as drawn.  Sets without overlap are left out.
    """
    s = sets.select("term", "gene_id").distinct()
    universe = s.select("gene_id").distinct()
    sizes = s.groupBy("term").agg(F.count("*").alias("k"))
    drawn = queries.select("group", "gene_id").distinct().join(universe, "gene_id", "left_semi")
    draws = drawn.groupBy("group").agg(F.count("*").alias("n"))
    over = drawn.join(s, "gene_id").groupBy("group", "term").agg(F.count("*").alias("x")).join(sizes, "term").join(draws, "group")
    size = universe.agg(F.count("*").alias("big"))  # one row
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    N, K, m = F.col("big"), F.col("k"), F.col("n")
    low = F.greatest(F.col("x"), m - (N - K))
    p = F.aggregate(F.sequence(low, F.least(K, m)), F.lit(0.0), lambda a, i: a + F.exp(choose(K, i) + choose(N - K, m - i) - choose(N, m)))
    tails = over.join(F.broadcast(size)).select("group", "term", F.col("x").alias("overlap"), F.col("k").alias("set_size"), F.least(F.lit(1.0), p).alias("pval"))
    return benjamini_hochberg(tails, "pval", ["group"], "term")


#: An arithmetic order that looks random and is the same everywhere.
def arithmetic_key(c: Column, seed: int) -> Column:
    return (c * 2654435761 + seed * 40503) % 4294967296


def set_scores(d: Dataset, sets: DataFrame, *, bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """term, cell_id, score: mean of a set's genes less the mean of control genes of like mean expression.

    sets: term, gene_id.  Genes are ranked by mean into equal bins; every bin
    a set is in gives `controls` genes outside of the set, by an arithmetic order of the ids.
    """
    n = d.obs.agg(F.count("*").alias("n"))
    g = d.var.agg(F.count("*").alias("g"))
    sums = d.var.select("gene_id").join(d.x.groupBy("gene_id").agg(F.sum("value").alias("s")), "gene_id", "left").fillna(0.0, ["s"])
    order = Window.partitionBy().orderBy("s", "gene_id")  # a row a gene
    placed = sums.withColumn("i", F.row_number().over(order) - 1).join(F.broadcast(g)).select("gene_id", F.floor(F.col("i") * bins / F.col("g")).alias("bin"))
    own = sets.select("term", "gene_id").distinct().join(placed, "gene_id")
    cells = own.select("term", "bin").distinct().join(placed, "bin").join(own.select("term", "gene_id", F.lit(True).alias("_in")), ["term", "gene_id"], "left").filter("_in is null")
    pick = Window.partitionBy("term", "bin").orderBy(arithmetic_key(F.col("gene_id"), seed), "gene_id")
    chosen = cells.withColumn("i", F.row_number().over(pick)).filter(F.col("i") <= controls)
    genes = own.select("term", "gene_id", F.lit(1.0).alias("side")).unionByName(chosen.select("term", "gene_id", F.lit(-1.0).alias("side")))
    weight = genes.join(genes.groupBy("term", "side").agg(F.count("*").alias("m")), ["term", "side"]).select("term", "gene_id", (F.col("side") / F.col("m")).alias("w"))
    scores = d.x.join(weight, "gene_id").groupBy("term", "cell_id").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    # a row a cell with all its scores; the terms it has none of are zeros
    terms = sets.groupBy().agg(F.collect_set("term").alias("all"))  # one row
    own = scores.groupBy("cell_id").agg(F.collect_list(F.struct("term", "score")).alias("some"))
    each = d.obs.select("cell_id").join(own, "cell_id", "left").join(F.broadcast(terms))
    some = F.coalesce("some", F.array().cast("array<struct<term:string,score:double>>"))
    rest = F.transform(F.array_except("all", some["term"]), lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("score")))
    return each.select("cell_id", F.explode(F.concat(some, rest)).alias("s")).select("s.term", "cell_id", "s.score")


def labels_by_score(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, label: the set with the highest mean score in a cluster, the first by name if several have it."""
    means = scores.join(clusters, "cell_id").groupBy("cluster", "term").agg(F.round(F.avg("score"), 9).alias("m"))
    best = means.groupBy("cluster").agg(F.min(F.struct((-F.col("m")).alias("m"), "term")).alias("b"))
    return best.select("cluster", F.col("b.term").alias("label"))


def cell_cycle(s: DataFrame, g2m: DataFrame) -> DataFrame:
    """cell_id, s_score, g2m_score, phase: S, or G2M if that scores higher, or G1 if both are below 0."""
    both = s.select("cell_id", F.col("score").alias("s_score")).join(g2m.select("cell_id", F.col("score").alias("g2m_score")), "cell_id")
    phase = F.when((F.col("s_score") < 0) & (F.col("g2m_score") < 0), "G1").when(F.col("g2m_score") > F.col("s_score"), "G2M").otherwise("S")
    return both.withColumn("phase", phase)
