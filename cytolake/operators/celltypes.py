"""Cell-cycle phases and cell types by marker sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.model import Dataset
from cytolake.operators import stats

# Published gene lists of the S and the G2/M phase.
S_GENES = """MCM5 PCNA TYMS FEN1 MCM2 MCM4 RRM1 UNG GINS2 MCM6 CDCA7 DTL PRIM1 UHRF1 MLF1IP HELLS RFC2 RPA2 NASP RAD51AP1 GMNN WDR76
SLBP CCNE2 UBR7 POLD3 MSH2 ATAD2 RAD51 RRM2 CDC45 CDC6 EXO1 TIPIN DSCC1 BLM CASP8AP2 USP1 CLSPN POLA1 CHAF1B BRIP1 E2F8""".split()
G2M_GENES = """HMGB2 CDK1 NUSAP1 UBE2C BIRC5 TPX2 TOP2A NDC80 CKS2 NUF2 CKS1B MKI67 TMPO CENPF TACC3 FAM64A SMC4 CCNB2 CKAP2L CKAP2 AURKB BUB1
KIF11 ANP32E TUBB4B GTSE1 KIF20B HJURP CDCA3 HN1 CDC20 TTK CDC25C KIF2C RANGAP1 NCAPD2 DLGAP5 CDCA2 CDCA8 ECT2 KIF23 HMMR AURKA PSRC1
ANLN LBR CKAP5 CENPE CTCF NEK2 G2E3 GAS2L3 CBX5 CENPA""".split()
# Marker genes of cell types.
MARKERS = {
    "T cell": "CD3D CD3E CD3G TRAC",
    "CD4+ T cell": "CD4 IL7R",
    "CD8+ T cell": "CD8A CD8B GZMK",
    "B cell": "CD79A CD79B MS4A1 CD19",
    "Plasma cell": "MZB1 IGHG1 JCHAIN XBP1",
    "NK cell": "NKG7 GNLY KLRD1 NCAM1",
    "Monocyte": "CD14 LYZ S100A8 S100A9 FCN1",
    "Macrophage": "CD68 C1QA C1QB MARCO",
    "Dendritic cell": "FCER1A CD1C CLEC9A LILRA4",
    "Megakaryocyte": "PPBP PF4 ITGA2B",
    "Erythrocyte": "HBB HBA1 HBA2 GYPA",
    "Epithelial cell": "EPCAM KRT8 KRT18",
    "Fibroblast": "COL1A1 DCN LUM PDGFRB",
    "Endothelial cell": "PECAM1 VWF CLDN5",
}


def named_sets(var: DataFrame, sets: dict[str, list[str]], least: int) -> DataFrame:
    """term, gene_id of the sets of which at least `least` genes are there, by name in any case; of repeated names the first gene counts."""
    rows = [(term, i, gene.upper()) for i, (term, genes) in enumerate(sets.items()) for gene in dict.fromkeys(genes)]
    asked = var.sparkSession.createDataFrame(rows, "term string, ordinal int, _g string")
    there = var.groupBy(F.upper("gene").alias("_g")).agg(F.min("gene_id").alias("gene_id"))
    own = there.join(F.broadcast(asked), "_g")
    enough = own.groupBy("term").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("term")
    return own.join(enough, "term").select("term", "gene_id")


def cell_cycle(d: Dataset, s_genes: list[str] = S_GENES, g2m_genes: list[str] = G2M_GENES, least: int = 5) -> DataFrame:
    """cell_id, s_score, g2m_score, phase; an error with fewer than `least` genes of either phase."""
    sets = named_sets(d.var, {"S": s_genes, "G2M": g2m_genes}, least)
    if sets.select("term").distinct().count() < 2:
        raise ValueError(f"cell cycle: {least} genes of each phase are needed")
    scores = stats.set_scores(d, sets)
    return stats.cell_cycle(scores.filter("term = 'S'"), scores.filter("term = 'G2M'"))


def by_markers(d: Dataset, cluster: str, sets: dict[str, str] | None = None, least: int = 2) -> DataFrame:
    """group, label: for each value of a column the marker set with the highest mean score; sets with fewer than `least` genes don't count.

    Ties go to the first by name; an error if no set is left.
    """
    own = named_sets(d.var, {k: v.split() for k, v in (MARKERS if sets is None else sets).items()}, least)
    if own.head(1) == []:
        raise ValueError("no marker genes in this dataset")
    groups = d.obs.filter(F.col(cluster).isNotNull()).select("cell_id", F.col(cluster).cast("string").alias("cluster"))
    return stats.labels_by_score(stats.set_scores(d, own), groups).select(F.col("cluster").alias("group"), "label")
