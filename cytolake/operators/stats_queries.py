"""Queries of markers, differential expression, enrichment and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.model import SQL, from_tables
from cytolake.operators import celltypes, qc
from cytolake.operators import stats as S
from cytolake.registry import query
from cytolake.sources.tables import stored

LOG = SQL + ", xl as (select cell_id, gene_id, ln(1 + value) as value, value as raw from x)"


def _rank_sql(groups: str) -> str:
    """Tables w (tests) and m (with padj) of one-against-rest tests of the groups of table grp(cell_id, g)."""
    return f"""{LOG}, grp as ({groups}), n as (select count(*) as n from grp), ng as (select g, count(*) as ng from grp group by 1),
v as (select gene_id, g, xl.cell_id, value, raw from xl join grp using (cell_id)),
pl as (select gene_id, g, value, count(*) over (partition by gene_id) as nnz, rank() over (partition by gene_id order by raw) + (count(*) over (partition by gene_id, raw) - 1) / 2.0 as r from v),
pt as (select gene_id, g, sum(r + n.n - nnz) as rs, count(*) as nz, sum(value) as s from pl, n group by 1, 2),
tt as (select gene_id, any_value(nnz) as nnz, sum(value) as ts from pl group by 1),
f as (select var.gene_id, ng.g, ng, n.n, coalesce(nnz, 0) as nnz, coalesce(ts, 0) as ts, coalesce(rs, 0) as rs, coalesce(nz, 0) as nz, coalesce(s, 0) as s from var cross join ng cross join n left join tt on tt.gene_id = var.gene_id left join pt on pt.gene_id = var.gene_id and pt.g = ng.g),
w as (select g as "group", gene_id, (rs + (ng - nz) * ((n - nnz + 1) / 2.0) - ng * (n + 1) / 2.0) / sqrt(ng * (n - ng) * (n + 1) / 12.0) as z, log2((exp(s / ng) - 1 + 1e-9) / (exp((ts - s) / (n - ng)) - 1 + 1e-9)) as lfc, nz / ng as pct_in, (nnz - nz) / (n - ng) as pct_out from f),
p as (select *, {S.two_sided_sql("z")} as pval from w),
q as (select *, pval * count(*) over (partition by "group") / row_number() over (partition by "group" order by pval, gene_id) as q from p),
m as (select *, least(1, min(q) over (partition by "group" order by pval desc, gene_id desc rows unbounded preceding)) as padj from q)"""


_CLUSTERS = _rank_sql("select cell_id, cluster as g from obs")
_COLUMNS = "round(z, 5) as z, round(lfc, 5) as lfc, round(pct_in, 6) as pct_in, round(pct_out, 6) as pct_out, round(-log10(greatest(padj, 1e-300)), 4) + 0.0 as nlp"


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = qc.log1p(from_tables(spark, sf_dir))
    return S.rank_sums(d, d.obs.select("cell_id", F.col("cluster").alias("group")))


def _shown(m: DataFrame, *first: str) -> DataFrame:
    return m.select(*first, F.round("z", 5).alias("z"), F.round("lfc", 5).alias("lfc"), F.round("pct_in", 6).alias("pct_in"), F.round("pct_out", 6).alias("pct_out"), (F.round(-F.log10(F.greatest("padj", F.lit(1e-300))), 4) + 0.0).alias("nlp"))


@query(f'{_CLUSTERS} select "group", gene_id, {_COLUMNS} from m')
def markers_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_markers(spark, sf_dir), "group", "gene_id")


_DE = _rank_sql("select cell_id, case when cell_id % 7 = 3 and cell_id < 1000 then 'selection' else 'rest' end as g from obs")


def _de(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.selection_against_rest(qc.log1p(from_tables(spark, sf_dir)), [*range(3, 1000, 7), 3, -1])


@query(f"{_DE} select gene_id, {_COLUMNS} from m where \"group\" = 'selection'")
def de_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_de(spark, sf_dir), "gene_id")


@query(f"{_DE} select gene_id, round(-log10(greatest(padj, 1e-300)), 4) + 0.0 as y, case when padj <= 0.9 and abs(lfc) >= 0.5 and lfc > 0 then 'up' when padj <= 0.9 and abs(lfc) >= 0.5 then 'down' else 'ns' end as class from m where \"group\" = 'selection'")
def volcano_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.volcano(_de(spark, sf_dir), fold=0.5, alpha=0.9).select("gene_id", (F.round("y", 4) + 0.0).alias("y"), "class")


@query(f'{_CLUSTERS} select "group", gene_id, round(pct_in, 6) as pct_in, round(pct_out, 6) as pct_out from m where pct_in > pct_out')
def pct_expressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markers(spark, sf_dir).filter("pct_in > pct_out").select("group", "gene_id", F.round("pct_in", 6).alias("pct_in"), F.round("pct_out", 6).alias("pct_out"))


_ENRICHED = f"""{_CLUSTERS}, top as (select "group", gene_id from (select *, row_number() over (partition by "group" order by z desc, gene_id) as i from m) where i <= 100),
st as (select set_name as term, gene_id from var), nn as (select count(distinct gene_id) as big from st), kk as (select term, count(*) as k from st group by 1), dn as (select "group", count(*) as n from top group by 1),
ov as (select "group", term, count(*) as x from top join st using (gene_id) group by 1, 2), o as (select ov.*, k, n, big from ov join kk using (term) join dn using ("group"), nn),
e as (select "group", term, x, k, n, big, unnest(range(greatest(x, n - (big - k)), least(k, n) + 1)) as i from o),
c as (select "group", term, any_value(x) as x, any_value(k) as k, least(1, sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(big - k + 1) - lgamma(n - i + 1) - lgamma(big - k - n + i + 1) - lgamma(big + 1) + lgamma(n + 1) + lgamma(big - n + 1)))) as pval from e group by 1, 2),
b as (select *, pval * count(*) over (partition by "group") / row_number() over (partition by "group" order by pval, term) as q from c),
e9 as (select "group", term, x as overlap, k as set_size, pval, least(1, min(q) over (partition by "group" order by pval desc, term desc rows unbounded preceding)) as padj from b)"""


@query(_ENRICHED + ' select "group", term, overlap, set_size, round(pval, 6) as pval, round(padj, 5) as padj from e9')
def ora_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_markers(_markers(spark, sf_dir), 100).select("group", "gene_id")
    sets = from_tables(spark, sf_dir).var.select(F.col("set_name").alias("term"), "gene_id")
    out = S.over_representation(top, sets)
    return out.select("group", "term", "overlap", "set_size", F.round("pval", 6).alias("pval"), F.round("padj", 5).alias("padj"))


@query(SQL + " select collection, set_name, count(*) as n_genes from var where contains(upper(set_name), upper('brand#1')) group by 1, 2 order by 1, 2 limit 40")
def geneset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_sets(from_tables(spark, sf_dir).var, "brand#1")


_SCORE = (
    LOG
    + """, sums as (select var.gene_id, coalesce(sum(value), 0) as s from var left join x using (gene_id) group by 1), pl as (select gene_id, floor((row_number() over (order by s, gene_id) - 1) * 25 / (select count(*) from var)) as bin from sums),
st as (select set_name as term, gene_id from var), own as (select st.*, bin from st join pl using (gene_id)),
cand as (select b.term, pl.gene_id, pl.bin from (select distinct term, bin from own) b join pl using (bin) where not exists (select 1 from own o where o.term = b.term and o.gene_id = pl.gene_id)),
ch as (select term, gene_id from (select *, row_number() over (partition by term, bin order by (gene_id * 2654435761) % 4294967296, gene_id) as i from cand) where i <= 50),
gs as (select term, gene_id, 1.0 as side from own union all select term, gene_id, -1.0 from ch), wt as (select term, gene_id, side / count(*) over (partition by term, side) as w from gs),
sc as (select term, cell_id, sum(x.value * w) as score from x join wt using (gene_id) group by 1, 2),
scores as (select t.term, obs.cell_id, coalesce(score, 0) as score from obs cross join (select distinct term from st) t left join sc on sc.term = t.term and sc.cell_id = obs.cell_id)"""
)


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = from_tables(spark, sf_dir)
    d = d.with_x(stored(d.x, "matrix"))  # it is read twice
    sets = d.var.select(F.col("set_name").alias("term"), "gene_id")
    return S.set_scores(d, sets), d.obs


@query(_SCORE + " select term, cell_id, round(score, 6) + 0.0 as score from scores")
def geneset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)[0].select("term", "cell_id", (F.round("score", 6) + 0.0).alias("score"))


@query(_SCORE + ", mm as (select cluster, term, round(avg(score), 9) as m from scores join obs using (cell_id) group by 1, 2) select cluster, term as label from (select *, row_number() over (partition by cluster order by m desc, term) as i from mm) where i = 1")
def marker_score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, obs = _scores(spark, sf_dir)
    return S.labels_by_score(scores, obs.select("cell_id", "cluster"))


@query(f"{_DE} select gene_id, round(padj, 6) as padj, round(lfc, 5) as lfc from m where \"group\" = 'selection' and padj <= 0.9 and abs(lfc) >= 0.4 order by padj, abs(lfc) desc, gene_id limit 200")
def de_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.significant(_de(spark, sf_dir), 0.4, 0.9).select("gene_id", F.round("padj", 6).alias("padj"), F.round("lfc", 5).alias("lfc"))


@query(f"""{_CLUSTERS} select "group", gene, round(lfc, 5) as lfc, round(z, 5) as z from m join var using (gene_id) where contains(lower(gene), 'g1') and abs(lfc) >= 0.1""")
def marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.marker_table(_markers(spark, sf_dir), "G1", 0.1, sort="lfc", names=from_tables(spark, sf_dir).var)
    return out.select("group", "gene", F.round("lfc", 5).alias("lfc"), F.round("z", 5).alias("z"))


def _enriched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    markers = stored(_markers(spark, sf_dir), "markers")
    sets = from_tables(spark, sf_dir).var.select(F.col("set_name").alias("term"), "gene_id")
    return markers, S.over_representation(S.top_markers(markers, 100).select("group", "gene_id"), sets)


@query(_ENRICHED + """ select "group", term, cast(i as integer) as rank, round(padj, 5) as padj from (select *, row_number() over (partition by "group" order by round(padj, 9), round(pval, 9), term) as i from e9) where i <= 5""")
def enrichment_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = _enriched(spark, sf_dir)
    rounded = out.withColumns({"padj": F.round("padj", 9), "pval": F.round("pval", 9)})  # ties don't go by the last digits of a sum
    return S.enrichment_top(rounded, 5).select("group", "term", "rank", F.round("padj", 5).alias("padj"))


@query(_ENRICHED + """ select "group", count(*) as n_markers, bool_or("group" in (select "group" from e9)) as computed from m group by 1""")
def enrichment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.enrichment_groups(*_enriched(spark, sf_dir))


def _of(set_names: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in set_names)


_PHASES = _SCORE + """, p as (select cell_id, max(case when term = 'Brand#11' then score end) as s_score, max(case when term = 'Brand#12' then score end) as g2m_score from scores where term in ('Brand#11', 'Brand#12') group by 1)
select cell_id, round(s_score, 6) + 0.0 as s_score, round(g2m_score, 6) + 0.0 as g2m_score, case when round(s_score, 9) < 0 and round(g2m_score, 9) < 0 then 'G1' when round(g2m_score, 9) > round(s_score, 9) then 'G2M' else 'S' end as phase from p"""


def _genes(d, brand: str) -> list[str]:
    """A small set by name, as a user gives one: the genes of a brand."""
    return [r["gene"] for r in d.var.filter(F.col("set_name") == brand).orderBy("gene_id").select("gene").collect()]


@query(_PHASES)
def cell_cycle_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_tables(spark, sf_dir)
    d = d.with_x(stored(d.x, "matrix"))
    out = celltypes.cell_cycle(d, _genes(d, "Brand#11"), _genes(d, "Brand#12"))
    return out.select("cell_id", (F.round("s_score", 6) + 0.0).alias("s_score"), (F.round("g2m_score", 6) + 0.0).alias("g2m_score"), "phase")


_TYPES = ("Brand#11", "Brand#12", "Brand#13", "Brand#21")


@query(_SCORE + f", mm as (select cluster, term, round(avg(score), 9) as m from scores join obs using (cell_id) where term in ({_of(_TYPES)}) group by 1, 2) select cluster as \"group\", term as label from (select *, row_number() over (partition by cluster order by m desc, term) as i from mm) where i = 1")
def cell_type_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = from_tables(spark, sf_dir)
    d = d.with_x(stored(d.x, "matrix"))
    return celltypes.by_markers(d, "cluster", {t: " ".join(_genes(d, t)) for t in _TYPES} | {"alone": "G1", "absent": "x y z"})


@query(f"{_DE} select gene_id, round(padj, 6) as padj, round(lfc, 5) as lfc, cast(row_number() over (order by padj, abs(lfc) desc, gene_id) as integer) as place from m where \"group\" = 'selection' and padj <= 1 and abs(lfc) >= 0.1 order by place limit 200")
def de_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a selection's genes with a place for each, so that order and limit show."""
    found = S.significant(_de(spark, sf_dir), 0.1, 1.0)
    place = F.row_number().over(Window.partitionBy().orderBy("padj", F.desc(F.abs("lfc")), "gene_id"))  # 200 rows at most
    return found.select("gene_id", F.round("padj", 6).alias("padj"), F.round("lfc", 5).alias("lfc"), place.alias("place"))
