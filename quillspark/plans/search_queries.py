"""Full-text queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search, snippets
from . import phrases as plan
from .registry import query, table

WORDS = "the with that"
PHRASE = "of-the"


def plain(t: str) -> list[str]:
    """plain_tokens() of a query, on the driver."""
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]


def _one_column(docs: DataFrame, of: str, column: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col(of).alias("row_id"), F.coalesce(column, F.lit("")).alias(column), *extra)


def _ranked(docs: DataFrame, columns: tuple[str, ...], words: str, mode: str, weights: tuple[float, ...], tokens: Callable = text.plain_tokens, of_query: Callable = plain) -> DataFrame:
    # Postings and lengths share the tokens, which are made once.
    kept = search.tokenised(docs, columns, tokens, ()).persist(StorageLevel.MEMORY_AND_DISK)
    return search.bm25(search.postings(kept, ()), search.document_lengths(kept), plan.phrases(words, of_query), mode, weights)


def _documents(spark, sf_dir: str, words: str, mode: str, **more) -> DataFrame:
    docs = _one_column(table(spark, sf_dir, "documents"), "doc_id", "text")
    return _ranked(docs, ("text",), words, mode, (1.0,), **more)


def _told(ranked: DataFrame, name: str = "doc_id") -> DataFrame:
    return ranked.select(F.col("row_id").alias(name), F.round("rank", 6).alias("rank"))


_TOKENS = r"regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"


def _bm25_sql(words: tuple[str, ...], least: int, tail: str, extra: str = "") -> str:
    some = ", ".join(f"'{w}'" for w in words)
    return rf"""
with tok as (select doc_id, unnest(list_filter({_TOKENS}, lambda x: x <> '')) as term from documents),
len as (select d.doc_id, coalesce(n, 0) as dl from documents d left join (select doc_id, count(*) as n from tok group by 1) using (doc_id)),
st as (select avg(dl) as avgdl, count(*) as n_docs from len),
tf as (select doc_id, term, count(*) as f from tok where term in ({some}) group by 1, 2),
df as (select term, count(*) as n from tf group by 1),
sc as (select doc_id, count(*) as met, sum(-(case when ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((n_docs - n + 0.5) / (n + 0.5)) end)
         * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) as rank
       from tf join df using (term) join len using (doc_id) cross join st group by 1){extra}
{tail.replace("LEAST", str(least))}
"""


_TOP = "select doc_id, round(rank, 6) as rank from (select * from sc where met >= LEAST order by rank, doc_id limit 20)"


@query(_bm25_sql(("the", "with", "that"), 1, _TOP))
def fts_bm25_any(spark, sf_dir):
    return _told(search.top(_documents(spark, sf_dir, WORDS, "any")))


@query(_bm25_sql(("the", "with", "that"), 3, _TOP))
def fts_bm25_all(spark, sf_dir):
    return _told(search.top(_documents(spark, sf_dir, WORDS, "all")))


@query(_bm25_sql(("the", "with", "that"), 1, "select doc_id, round(rank, 6) as rank from sc"))
def fts_scores_all_rows(spark, sf_dir):
    return _told(_documents(spark, sf_dir, WORDS, "any"))


@query(_bm25_sql(("the", "with", "that"), 1, "select doc_id, round(rank, 6) as rank from (select sc.* from sc join documents using (doc_id) where source = 'src0' order by rank, doc_id limit 20)"))
def fts_library_filter(spark, sf_dir):
    ranked = _documents(spark, sf_dir, WORDS, "any")
    mine = table(spark, sf_dir, "documents").where("source = 'src0'").select(F.col("doc_id").alias("row_id"))
    return _told(search.top(ranked.join(mine, "row_id", "left_semi")))


@query(rf"""
with tok as (select doc_id, unnest(list_filter({_TOKENS}, lambda x: x <> '')) as term, generate_subscripts(list_filter({_TOKENS}, lambda x: x <> ''), 1) as pos from documents),
len as (select d.doc_id, coalesce(n, 0) as dl from documents d left join (select doc_id, count(*) as n from tok group by 1) using (doc_id)),
st as (select avg(dl) as avgdl, count(*) as n_docs from len),
tf as (select a.doc_id, count(*) as f from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by 1),
df as (select count(*) as n from tf)
select doc_id, round(-(case when ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((n_docs - n + 0.5) / (n + 0.5)) end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as rank
from tf join len using (doc_id) cross join st cross join df
""")
def fts_phrase(spark, sf_dir):
    return _told(_documents(spark, sf_dir, PHRASE, "all"))


@query(r"""
with cells as (select p_partkey, unnest([{'w': 5, 't': p_brand}, {'w': 10, 't': p_type}, {'w': 15, 't': p_name}]) as c from part),
tok as (select p_partkey, c.w as w, unnest(list_filter(regexp_split_to_array(lower(c.t), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from cells),
len as (select p.p_partkey, coalesce(n, 0) as dl from part p left join (select p_partkey, count(*) as n from tok group by 1) using (p_partkey)),
st as (select avg(dl) as avgdl, count(*) as n_docs from len),
tf as (select p_partkey, term, sum(w) as f from tok where term in ('red', 'economy') group by 1, 2),
df as (select term, count(*) as n from tf group by 1)
select p_partkey, round(sum(-(case when ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((n_docs - n + 0.5) / (n + 0.5)) end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as rank
from tf join df using (term) join len using (p_partkey) cross join st group by 1
""")
def fts_bm25_weighted_cols(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), "p_brand", "p_type", "p_name")
    return _told(_ranked(docs, ("p_brand", "p_type", "p_name"), "red economy", "any", (5.0, 10.0, 15.0)), "p_partkey")


@query()
def fts_porter_bm25(spark, sf_dir):
    return _told(search.top(_documents(spark, sf_dir, "things with", "any", tokens=text.fts_tokens_udf, of_query=text.fts_tokens)))


@query(rf"""
select doc_id, (pos - 1)::int as pos, term from (select doc_id, unnest(list_filter({_TOKENS}, lambda x: x <> '')) as term, generate_subscripts(list_filter({_TOKENS}, lambda x: x <> ''), 1) as pos from conversations_text)
""".replace("conversations_text", "(select conv_id * 1000 + turn as doc_id, text from conversations)"))
def index_rebuild_postings(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return search.postings(search.tokenised(docs, ("text",), text.plain_tokens, ()), ()).select(F.col("row_id").alias("doc_id"), "pos", "term")


@query(rf"""
select term, count(distinct doc_id) as df_n from (select doc_id, unnest(list_filter({_TOKENS}, lambda x: x <> '')) as term from documents) group by 1
""")
def term_doc_freq(spark, sf_dir):
    docs = _one_column(table(spark, sf_dir, "documents"), "doc_id", "text")
    return search.term_frequencies(search.postings(search.tokenised(docs, ("text",), text.plain_tokens, ()), ()))


@query(rf"""
select source, count(*) as n_docs, round(avg(len(list_filter({_TOKENS}, lambda x: x <> ''))), 6) as avgdl from documents group by 1
""")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.size(text.plain_tokens(F.coalesce("text", F.lit(""))))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(n), 6).alias("avgdl"))


@query(r"select doc_id, (len(regexp_extract_all(coalesce(text, ''), '\S+')) * 3 // 2)::int as tokens from documents")
def approx_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.approx_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


_CUT = r""", top as (select sc.doc_id, rank, (len(regexp_extract_all(text, '\S+')) * 3 // 2)::int as tokens from sc join documents using (doc_id) where met >= LEAST order by rank, sc.doc_id limit 20),
run as (select *, row_number() over (order by rank, doc_id) as rn, sum(tokens) over (order by rank, doc_id rows unbounded preceding) as total from top)"""


@query(_bm25_sql(("the", "with", "that"), 1, "select doc_id, tokens, rn::int as rn from run where rn = 1 or total <= 8000", _CUT.replace("LEAST", "1")))
def budget_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("block"))
    best = search.top(_documents(spark, sf_dir, WORDS, "any"))
    return snippets.within_budget(best.join(docs, "row_id")).select(F.col("row_id").alias("doc_id"), "tokens", "rn")


@query(r"""
select conv_id, turn, '# conv-' || conv_id || case when role = 'system' then chr(10) || chr(10) else '::' || role || '()' || chr(10) || chr(10) end
  || '**Signature:** `' || role || '`' || chr(10) || chr(10) || case when text <> '' then '## Description' || chr(10) || chr(10) || text || chr(10) || chr(10) else '' end
  || '## Parameters' || chr(10) || chr(10) || '- `turn` (int, ' || case when turn = 0 then 'required' else 'optional' end || '): ' || turn || chr(10) || chr(10)
  || '## Return' || chr(10) || chr(10) || '`' || role || '`' || chr(10) || chr(10) || 'Source: /c/' || conv_id || chr(10) || chr(10) as block from conversations
""")
def format_snippets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    params = F.array(F.struct(F.lit("turn").alias("name"), F.lit("int").alias("type"), (F.col("turn") == 0).alias("required"), F.col("turn").cast("string").alias("description")))
    method = F.when(F.col("role") != "system", F.col("role"))
    block = snippets.markdown(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), method, F.col("role"), F.col("text"), params, F.col("role"), none, none, none, none, F.concat(F.lit("/c/"), F.col("conv_id").cast("string")))
    return c.select("conv_id", "turn", block.alias("block"))
