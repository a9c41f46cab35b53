"""Relational operators of the store: upserts, replaced children, counts, latest rows, statistics of crawls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], order: str, keep_first: Sequence[str] = ()) -> DataFrame:
    """existing with new's rows: one row for each key, the last by order (new wins ties); keep_first columns from the key's first row.

    Parquet has no MERGE: a union and two aggregations of whole rows by key, combined before the shuffle.
    """
    rest = [c for c in existing.columns if c not in key]
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    at = F.struct(F.col(order), F.col("_new"))
    picks = [(F.min_by(c, at) if c in keep_first else F.max_by(c, at)).alias(c) for c in rest]
    return rows.groupBy(*key).agg(*picks).select(*existing.columns)


def replace_children(existing: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """existing without the children of new's parents, with new's: delete by parent, then insert."""
    return existing.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def with_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(children whose parent exists, those that break the foreign key)."""
    keys = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(keys, child_key, "left_semi"), children.join(keys, child_key, "left_anti")


def latest(df: DataFrame, group: str, order: str) -> DataFrame:
    """Each group's last row by order: one partial aggregate, no window."""
    return df.groupBy(F.col(group).alias("_g")).agg(F.max_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def search_libraries(libraries: DataFrame, part: str) -> DataFrame:
    """Libraries whose name, description or id holds part (ASCII letters in either case), best trust first."""
    hit = text.contains_ignoring_case(F.col("name"), part) | text.contains_ignoring_case(F.col("description"), part) | text.contains_ignoring_case(F.col("id"), part)
    return libraries.where(hit).orderBy(F.col("trust_score").desc(), "id")


def library_score(query: str | Column) -> Column:
    """How well a library's name answers the query, with its size and trust."""
    q = F.lower(F.lit(query) if isinstance(query, str) else query)
    name = F.lower("name")
    base = F.when(name == q, 100.0).when(F.startswith(name, q), 80.0).when(F.contains(name, q), 60.0).when(F.contains(F.lower("id"), q), 40.0).otherwise(0.0)
    return base + F.col("snippet_count") * 0.01 + F.col("trust_score") * 10.0


def rank_libraries(libraries: DataFrame, query: str) -> DataFrame:
    """libraries with score, best first; ties by trust, then id."""
    return libraries.withColumn("score", library_score(query)).orderBy(F.col("score").desc(), F.col("trust_score").desc(), "id")


def snippet_counts(entities: DataFrame, methods: DataFrame) -> DataFrame:
    """(library_id, snippets): entities and methods of each library, counted before they meet."""
    per = methods.groupBy("entity_id").agg(F.count(F.lit(1)).alias("m"))
    joined = entities.select("id", "library_id").join(per, F.col("id") == F.col("entity_id"), "left")
    return joined.groupBy("library_id").agg((F.count(F.lit(1)) + F.coalesce(F.sum("m"), F.lit(0))).alias("snippets"))


def fill_snippet_count(libraries: DataFrame, counts: DataFrame) -> DataFrame:
    """libraries whose stored count is 0 get the computed one, if there are entities."""
    c = counts.withColumnRenamed("library_id", "_lib")
    filled = F.when(F.col("snippet_count") > 0, F.col("snippet_count")).otherwise(F.coalesce("snippets", "snippet_count")).cast("int")
    return libraries.join(c, F.col("id") == F.col("_lib"), "left").withColumn("snippet_count", filled).select(*libraries.columns)


def method_counts(entities: DataFrame, methods: DataFrame) -> DataFrame:
    """entities with method_count, 0 for those without methods."""
    per = methods.groupBy(F.col("entity_id").alias("_e")).agg(F.count(F.lit(1)).alias("n"))
    return entities.join(per, F.col("id") == F.col("_e"), "left").withColumn("method_count", F.coalesce("n", F.lit(0))).drop("_e", "n")


def crawl_stats(progress: DataFrame) -> DataFrame:
    """(session_id, total, success, failed, skipped): zeros, never nulls."""
    of = lambda s: F.count_if(F.col("status") == s)
    return progress.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), of("success").alias("success"), of("failed").alias("failed"), of("skipped").alias("skipped"))


def failures_by_type(progress: DataFrame) -> DataFrame:
    """(session_id, error_type, n) of failed items; no type counts as 'unknown'."""
    return progress.where("status = 'failed'").groupBy("session_id", F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def failures(progress: DataFrame) -> DataFrame:
    """Failed items, nulls as ''."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return progress.where("status = 'failed'").select("session_id", "url", "item_type", blank("error_type"), blank("error_message"), blank("parent_entity"))


def remaining(found: DataFrame, progress: DataFrame) -> DataFrame:
    """found's urls that no session item has done: what a resumed crawl has left."""
    return found.join(progress.where("status = 'success'").select("url").distinct(), "url", "left_anti")


#: Failures that another try doesn't mend.
PERMANENT = ("http_404", "parse_error", "fk_error")


def retryable(progress: DataFrame) -> DataFrame:
    """Failed items worth another try, with their item types."""
    return failures(progress).where(~F.col("error_type").isin(*PERMANENT))


def error_type(message: Column) -> Column:
    """A failure's class by what its message holds, in this order."""
    has = lambda s: F.contains(message, F.lit(s))
    return F.when(has("404"), "http_404").when(has("429"), "http_429").when(has("server error"), "http_5xx").when(has("timeout") | has("deadline"), "timeout").when(has("FOREIGN KEY"), "fk_error").when(has("canceled"), "interrupted").otherwise("other")


def close_session(sessions: DataFrame, session: int, status: str, at: Column | None = None) -> DataFrame:
    """sessions with one's status set; completed_at only for ended ones, else null."""
    ended = F.lit(status).isin("completed", "interrupted")
    mine = F.col("id") == session
    done = F.when(mine, F.when(ended, F.current_timestamp() if at is None else at)).otherwise(F.col("completed_at"))
    return sessions.withColumn("completed_at", done).withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status")))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    """parents with their children as a sorted array of structs, empty if none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def chains(start: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """start (root) with path, the nodes reached over at most hops edges (src, dst; one for each src), and depth."""
    out = start.select("root", F.col("root").alias("at"), F.array(F.col("root").cast("string")).alias("path"))
    for _ in range(hops):
        e = edges.select(F.col("src").alias("at"), F.col("dst"))
        out = out.join(e, "at", "left").select("root", F.coalesce("dst", F.lit(None)).alias("at"), F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.col("dst").cast("string")))).alias("path"))
    return out.select("root", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("depth"))
