"""Exact dedup by skew-safe combining: local, salted and global merges that compare full content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Salts that one digest's rows are dealt to before they meet.
SALTS = 256
#: A row's rank is its length times SHIFT plus ABOVE minus its id.
SHIFT, ABOVE = "100000000000000000000", "9223372036854775808"


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (space and code points 9 to 13); null counts as empty.
    The row with the longest original text stays, then the smallest id (null last). Repeated ids: rows with
    the staying row's id are all kept. An empty table gives an empty result. Other columns are ignored.

    Each task first merges its own equal rows, then rows of one (digest, salt, content) meet, the salt being the task's,
    then the salts' winners of one (digest, content). Content is part of every grouping key, so rows are equal only by
    full comparison, and a group of any size sends one row a task to a salt and one row a salt to the last merge.
    Winners go back by (digest, length) in a join of narrow rows, whose hot digests adaptive execution splits.
    """
    common.prepare(df.sparkSession)
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), common.SPACE, "")
    flat = df.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_len"), norm.alias("_norm"))
    flat = flat.select("_id", "_len", "_norm", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"))
    # One number orders rows: length first, then the smaller id; a null id is 0. Numbers keep the aggregations in hash tables.
    rank = F.col("_len").cast("decimal(10,0)") * F.lit(SHIFT).cast("decimal(21,0)") + F.coalesce(F.lit(ABOVE).cast("decimal(20,0)") - F.col("_id"), F.lit(0).cast("decimal(20,0)"))
    mine = flat.select("_sha", "_norm", rank.alias("_rank"), (F.spark_partition_id() % salts).alias("_salt"))
    salted = mine.groupBy("_sha", "_salt", "_norm").agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"))
    won = salted.groupBy("_sha", "_norm").agg(F.max("_rank").alias("_rank"), F.sum("_n").alias("_n"))
    least = F.col("_rank") % F.lit(SHIFT).cast("decimal(21,0)")
    won = won.select("_sha", F.length("_norm").alias("_size"), F.when(least > 0, (F.lit(ABOVE).cast("decimal(20,0)") - least).cast("long")).alias("keep_id"), F.col("_n").alias("group_size"))
    out = flat.select("_id", "_sha", F.length("_norm").alias("_size")).join(won, ["_sha", "_size"])
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows that stay, all columns; of repeated rows with the staying id, those are all kept."""
    kept = duplicate_groups(df, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col("_kept_id")), "left_semi")


SQL = r"""
with t as (select doc_id, coalesce(text, '') as txt, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
w as (select doc_id, norm, first_value(doc_id) over (partition by norm order by length(txt) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from w
"""
