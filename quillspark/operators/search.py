"""Full-text search: the index as a postings table, phrase matching, BM25 with column weights, top k."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

K1, B = 1.2, 0.75
#: An idf that isn't positive counts as this.
LEAST_IDF = 1e-6
#: Weights of library_id, entity_name, method_name and content.
WEIGHTS = (1.0, 5.0, 10.0, 15.0)
COLUMNS = ("library_id", "entity_name", "method_name", "content")
TOP = 20


def index_documents(entities: DataFrame, methods: DataFrame) -> DataFrame:
    """Rows to index: each entity with its description, each method with signature and description. row_id is unique and stable.

    Entities get even ids, methods odd ones (ids are below 2 ** 63), so no global numbering is needed.
    """
    e = entities.select(F.shiftleft("id", 1).alias("row_id"), "library_id", F.col("name").alias("entity_name"), F.lit("").alias("method_name"), F.coalesce("description", F.lit("")).alias("content"), F.col("id").alias("entity_id"), F.lit(None).cast("long").alias("method_id"), F.lit("class").alias("snippet_type"))
    said = F.coalesce("description", F.lit(""))
    content = F.when(F.coalesce("signature", F.lit("")) != "", F.concat("signature", F.lit(" "), said)).otherwise(said)
    m = methods.select(F.shiftleft("id", 1).bitwiseOR(F.lit(1).cast("long")).alias("row_id"), F.col("name").alias("method_name"), content.alias("content"), "entity_id", F.col("id").alias("method_id"))
    owner = entities.select(F.col("id").alias("entity_id"), "library_id", F.col("name").alias("entity_name"))
    return e.unionByName(m.join(owner, "entity_id").withColumn("snippet_type", F.lit("method")))


def tokenised(docs: DataFrame, columns: Sequence[str] = COLUMNS, tokens: Callable[[Column], Column] = text.fts_tokens_udf, keep: Sequence[str] = ("library_id",)) -> DataFrame:
    """(keep..., row_id, tokens): an array of each column's tokens, in the order of columns. What postings and lengths are made of, once it is kept."""
    return docs.select(*keep, "row_id", F.array(*(tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns)).alias("tokens"))


def postings(tokenised: DataFrame, keep: Sequence[str] = ("library_id",)) -> DataFrame:
    """(keep..., row_id, col, pos, term): one row for each token of each column. A map and two explodes, no shuffle."""
    flat = tokenised.select(*keep, "row_id", F.posexplode("tokens").alias("col", "cell"))
    return flat.select(*keep, "row_id", "col", F.posexplode("cell").alias("pos", "term"))


def document_lengths(tokenised: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., row_id, dl): tokens over all columns, 0 for rows without any. Arrays' sizes, so no shuffle."""
    return tokenised.select(*keep, "row_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, over all libraries."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_frequencies(post: DataFrame) -> DataFrame:
    """(term, df_n): rows that hold a term."""
    return post.groupBy("term").agg(F.count_distinct("row_id").alias("df_n"))


def matches(post: DataFrame, phrases: list[list[str]], weights: Sequence[float]) -> DataFrame:
    """(row_id, phrase, f): weighted occurrences of each phrase. A phrase's tokens stand next to each other in one column.

    The query's tokens are a literal table, broadcast: its size is the query's. Postings are filtered by term first.
    """
    spark = post.sparkSession
    wanted = [(p, k, t, len(ts)) for p, ts in enumerate(phrases) for k, t in enumerate(ts)]
    query = F.broadcast(spark.createDataFrame(wanted, "phrase int, k int, term string, plen int"))
    hits = post.where(F.col("term").isin(sorted({t for ts in phrases for t in ts}))).join(query, "term")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("col") + 1)
    whole = hits.groupBy("row_id", "phrase", "plen", "col", (F.col("pos") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("met")).where("met = plen")
    return whole.groupBy("row_id", "phrase").agg(F.sum(weight).alias("f"))


def bm25(post: DataFrame, lengths: DataFrame, phrases: list[list[str]], mode: str = "all", weights: Sequence[float] = WEIGHTS, stats: DataFrame | None = None) -> DataFrame:
    """(row_id, rank) of matching rows: ranks are negative, the least is best. Every phrase must match, or with mode 'any' one.

    Statistics (one row, of lengths unless given) are of the whole index, whatever is filtered later. No phrases match no rows.
    A row's scores are added from the least on, as a sum of doubles depends on its order: rows with equal scores have equal ranks, and reruns agree.
    """
    if not phrases:
        return lengths.select("row_id", F.lit(0.0).alias("rank")).limit(0)
    f = matches(post, phrases, weights)
    n = f.groupBy("phrase").agg(F.count(F.lit(1)).alias("df_n"))  # as many rows as phrases
    raw = F.log((F.col("n_docs") - F.col("df_n") + 0.5) / (F.col("df_n") + 0.5))
    idf = F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    all_of = f.join(F.broadcast(n), "phrase").join(lengths, "row_id").join(F.broadcast(corpus_stats(lengths) if stats is None else stats), F.lit(True))
    scored = all_of.groupBy("row_id").agg(F.array_sort(F.collect_list(score)).alias("scores"))  # at most one for each phrase
    rank = -F.aggregate("scores", F.lit(0.0), lambda total, x: total + x)
    return scored.where(F.size("scores") >= (1 if mode == "any" else len(phrases))).select("row_id", rank.alias("rank"))


def top(ranked: DataFrame, k: int = TOP) -> DataFrame:
    """The k best rows, ties by row_id; k of 0 or less means TOP."""
    return ranked.orderBy("rank", "row_id").limit(k if k > 0 else TOP)
