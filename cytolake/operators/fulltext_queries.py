"""Queries of full-text ranks and of incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions import stem as P
from cytolake.model import read
from cytolake.operators import fulltext as T
from cytolake.registry import query


def _sql_stems() -> str:
    """CTEs from v0 (word) to stems (word, term), by the published steps."""
    has = lambda s, pattern: f"regexp_matches({s}, '{pattern}')"
    less = lambda n, w="w": f"left({w}, length({w}) - {n})"

    def longest(rules: list[tuple[str, str]], condition: str) -> str:
        parts = []
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            fits = has(less(len(suffix)), condition) + (f" and {has(less(3), '[st]$')}" if suffix == "ion" else "")
            parts.append(f"when ends_with(w, '{suffix}') then case when {fits} then {less(len(suffix))} || '{new}' else w end")
        return f"case {' '.join(parts)} else w end"

    double = "length(c) > 1 and right(c, 1) = left(right(c, 2), 1) and right(c, 1) not in ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')"
    mended = f"case when {has('c', '(at|bl|iz)$')} then c || 'e' when {double} then {less(1, 'c')} when {has('c', P.ONE)} and {has('c', P.SHORT)} then c || 'e' else c end"
    steps = [
        "regexp_replace(regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), '([^aeiouyY])yy', '\\1yY', 'g')",
        f"case when ends_with(w, 'sses') or ends_with(w, 'ies') then {less(2)} when ends_with(w, 'ss') then w when ends_with(w, 's') then {less(1)} else w end",
        None,
        f"case when {has('w', '[yY]$')} and {has(less(1), P.V)} then {less(1)} || 'i' else w end",
        longest(P.STEP2, P.SOME),
        longest(P.STEP3, P.SOME),
        longest([(s, "") for s in P.STEP4], P.MORE),
        f"case when ends_with(w, 'e') and ({has(less(1), P.MORE)} or ({has(less(1), P.ONE)} and not {has(less(1), P.SHORT)})) then {less(1)} else w end",
        f"case when ends_with(w, 'll') and {has(less(1), P.MORE)} then {less(1)} else w end",
    ]
    ctes, last = ["p0 as (select word, word as w from v0 where length(word) > 2 and regexp_matches(word, '^[a-z]+$'))"], "p0"
    for i, step in enumerate(steps, 1):
        if step is None:
            cut = f"case when ends_with(w, 'eed') then null when ends_with(w, 'ed') and {has(less(2), P.V)} then {less(2)} when ends_with(w, 'ing') and {has(less(3), P.V)} then {less(3)} end"
            ctes.append(f"q{i} as (select word, w, {cut} as c from {last})")
            step, last = f"case when c is not null then {mended} when ends_with(w, 'eed') and {has(less(3), P.SOME)} then {less(1)} else w end", f"q{i}"
        ctes.append(f"p{i} as (select word, {step} as w from {last})")
        last = f"p{i}"
    ctes.append(f"stems as (select v0.word, coalesce(lower({last}.w), v0.word) as term from v0 left join {last} using (word))")
    return ", ".join(ctes)


_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_POSTINGS = f"""with e as (select doc_id as chunk, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from documents),
c as (select chunk, word, count(*) as n from e where word <> '' and word not in ({_STOP}) group by all), v0 as (select distinct word from c), {_sql_stems()},
postings as (select term, chunk, sum(n) as tf from c join stems using (word) group by all)"""


@query(_POSTINGS + " select term, count(*) as chunks, cast(sum(tf) as bigint) as times, cast(max(tf) as bigint) as most from postings group by 1")
def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all documents, by stem."""
    found = T.postings(read(spark, sf_dir, "documents"), "doc_id")
    return found.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("times"), F.max("tf").alias("most"))


#: A question in words of the tables' texts; two have one stem, one is a stop word, one is in no text.
QUESTION = "The heating of reations, reation and ering zzzznone"


@query(
    _POSTINGS.replace("v0 as (select distinct word from c)", "v0 as (select distinct word from c union select unnest(['heating', 'reations', 'reation', 'ering', 'zzzznone']))")
    + """, h as (select chunk, sum(list_sum(list_transform(range(1, cast(tf as bigint) + 1), lambda j: 1.0::double / (j * j)))) as s from postings where term in (select term from stems where word in ('heating', 'reations', 'reation', 'ering', 'zzzznone')) group by 1)
select chunk as doc_id, round(s * 0.1 / 1.64493406685 / (select count(distinct term) from stems where word in ('heating', 'reations', 'reation', 'ering', 'zzzznone')), 9) as rank from h"""
)
def fulltext_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all documents for a question, from an index that is written and read by the terms' buckets."""
    path = T.new_folder(spark, "index")
    T.write_index(read(spark, sf_dir, "documents"), path, "doc_id")
    found = T.text_rank(spark.read.parquet(path), T.query_terms(spark, QUESTION))
    return found.select(F.col("chunk").alias("doc_id"), F.round("rank", 9).alias("rank"))


@query("""select doc_id as page_id, case when doc_id % 7 = 0 then 2 else 1 end as version, greatest(cast(ceil(n / 900) as bigint), 0) as n_chunks, n as chars
 from (select doc_id, length(text) + case when doc_id % 7 = 0 then 6 else 0 end as n from documents where doc_id % 11 <> 0 and text is not null) where n > 0""")
def corpus_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive in a stream: all of them, then all again with every seventh changed and every eleventh gone.  Only those are taken in again."""
    folder, path = T.new_folder(spark, "pages"), T.new_folder(spark, "corpus")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    d.write.parquet(folder)
    schema = d.schema
    T.follow(spark, folder, schema, path, chunked=T.windows(900))
    changed = F.when(F.col("page_id") % 11 == 0, F.lit(None).cast("string")).when(F.col("page_id") % 7 == 0, F.concat("text", F.lit(" More."))).otherwise(F.col("text"))
    d.withColumn("text", changed).write.mode("append").parquet(folder)
    T.follow(spark, folder, schema, path, chunked=T.windows(900))
    return T.corpus(spark, path).groupBy("page_id", "version").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chars"))
