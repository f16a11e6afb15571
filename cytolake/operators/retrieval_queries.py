"""Queries of the text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.model import read
from cytolake.operators import retrieval as R
from cytolake.registry import query

_STRIP = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


@query(f"select page_id, trim(regexp_replace(regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) as text from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", R.plain_text(F.col("html")).alias("text"))


@query("""with s as (select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') as p from documents)
select doc_id, len(p) as n_sentences, list_max(list_transform(p, lambda x: length(x))) as longest from s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("doc_id", R.sentences(F.col("text")).alias("p"))
    return s.select("doc_id", F.size("p").alias("n_sentences"), F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"))


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.packed(R.sentences(F.col("text")))).alias("chunk_idx", "content"))
    return docs.select("doc_id", "chunk_idx", "content", F.substring(F.sha1("content"), 1, 12).alias("chunk_id"))


_TERMS = ["the", "and", "with", "from"]
_VECTOR = [((7 * i) % 13 - 6) / 10 for i in range(64)]
_HYBRID = f"""with c as (select doc_id, text, embedding, lang from documents join embeddings on doc_id = vec_id where lang in ('en', 'de')),
q as (select {_VECTOR}::double[] as v), w as (select doc_id, embedding, string_split_regex(lower(text), '[^a-z0-9]+') as ws from c),
s as (select doc_id, list_sum(list_transform(list_zip(embedding, v), lambda z: cast(z[1] as double) * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))) as vsim,
 {" + ".join(f"(len(list_filter(ws, lambda x: x = '{t}')) / (len(list_filter(ws, lambda x: x = '{t}')) + 1.0))" for t in _TERMS)} as trank from w, q),
h as (select doc_id, 0.7 * vsim + 0.3 * coalesce(trank / nullif(max(trank) over (), 0), 0) as score from s)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(vectors, "doc_id")


@query(_HYBRID + " select doc_id, round(score, 6) as score from h order by round(score, 9) desc, doc_id limit 24")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.hybrid_search(_chunks(spark, sf_dir), _TERMS, _VECTOR, 24, keep=F.col("lang").isin("en", "de"))
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(_HYBRID + ", t as (select * from h order by round(score, 9) desc, doc_id limit 24) select doc_id, n_chars from t join documents using (doc_id) order by n_chars desc, doc_id limit 6")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.hybrid_search(_chunks(spark, sf_dir), _TERMS, _VECTOR, 24, keep=F.col("lang").isin("en", "de"))
    sized = found.join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.reranked(sized, F.col("n_chars").cast("double"), 6).select("doc_id", "n_chars")


@query(
    "select conv_id, turn, coalesce(nullif(array_to_string(list_filter(["
    + ", ".join("case when " + " or ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in words) + f" then '{name}' end" for name, words in sorted(R.ROUTES.items()))
    + "], lambda x: x is not null), ','), ''), 'data') as sources from conversations where role = 'user'"
)
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", F.array_join(R.routed(F.col("text")), ",").alias("sources"))


@query("""with o as (select doc_id, n_chars, source, 0 as v from documents), n as (select doc_id, n_chars * 2 as n_chars, source, 1 as v from documents where doc_id % 3 = 0),
f as (select doc_id + 1 as doc_id, n_chars + 5 as n_chars, source, 2 as v from documents where doc_id % 5 = 0), u as (select * from n union all select * from f),
l as (select doc_id, n_chars, source from (select *, row_number() over (partition by doc_id order by v desc) as i from u) where i = 1)
select doc_id, n_chars, source from o where doc_id not in (select doc_id from l) union all select * from l""")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.lit(0).alias("v"))
    new = old.filter("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") * 2).alias("n_chars"), "source", F.lit(1).alias("v"))
    newer = old.filter("doc_id % 5 = 0").select((F.col("doc_id") + 1).alias("doc_id"), (F.col("n_chars") + 5).alias("n_chars"), "source", F.lit(2).alias("v"))
    return R.upsert(old, new.unionByName(newer), ["doc_id"], "v").drop("v")


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.sections(F.col("text"))).alias("chunk_idx", "content"))


@query("""with r as (select doc_id, 'T' || doc_id as title, left(replace(replace(replace(text, '&', ''), '<', ''), '>', ''), 80) as a from documents where doc_id % 4 <> 0)
select cast(doc_id // 2 as varchar) as pmid, 'T' || doc_id as title, trim(a) as abstract, 'Smith et al.' as authors, 2000 + cast(doc_id % 20 as integer) as year, lang as journal from documents join r using (doc_id)
 where trim(a) <> '' and doc_id = (select min(d.doc_id) from r d where d.doc_id // 2 = r.doc_id // 2 and trim(d.a) <> '')""")
def pubmed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are made of documents: two ids have one pmid, every fourth has no abstract."""
    d = read(spark, sf_dir, "documents")
    plain = F.left(F.regexp_replace("text", "[&<>]", ""), F.lit(80))
    body = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("<Abstract><AbstractText>"), plain, F.lit("</AbstractText></Abstract>"))).otherwise("")
    xml = F.concat(F.lit("<PubmedArticle><PMID Version='1'>"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("</PMID><Journal><Title>"), "lang", F.lit("</Title><PubDate><Year>"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("</Year></PubDate></Journal><ArticleTitle>T"), F.col("doc_id").cast("string"), F.lit("</ArticleTitle>"), body, F.lit("<LastName>Smith</LastName><LastName>Lee</LastName></PubmedArticle>"))
    return R.articles(d.select(F.col("doc_id").alias("ordinal"), xml.alias("xml")))


@query(
    _HYBRID
    + """, t as (select doc_id, round(score, 9) as s, text from h join documents using (doc_id) order by round(score, 9) desc, text limit 6)
select cast(row_number() over (order by s desc, text) as integer) as rank, case when doc_id % 2 = 0 then 'lit:PMID:' || doc_id else 'doc:d' || doc_id || '#s' end as ref, length(case when doc_id % 2 = 0 then 'lit:PMID:' || doc_id else 'doc:d' || doc_id || '#s' end) + 3 + least(501, length(trim(replace(text, chr(10), ' ')))) as n from t"""
)
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.hybrid_search(_chunks(spark, sf_dir), _TERMS, _VECTOR, 24, keep=F.col("lang").isin("en", "de")).select("doc_id", F.round("score", 9).alias("score"))
    own = found.join(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    even = F.col("doc_id") % 2 == 0
    hits = own.select(F.when(even, "literature").otherwise("tutorial").alias("kind"), F.col("doc_id").cast("string").alias("pmid"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document"), F.lit("s").alias("section"), "content", "score")
    return R.context(hits).select("rank", "ref", F.length("line").alias("n"))
