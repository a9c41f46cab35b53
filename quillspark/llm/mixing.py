"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target stops at so many times its size.
MAX_EPOCHS = 3


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with each source's target: weights shared out, no target above epochs times its size.

    A capped share is min(cap, level * weight) with one level for all. Sources are taken by cap/weight; once those
    before are full, the level is what is left over the weights that are left. Sources are numbered by code point, null last.
    The rows here are the sources: a table of totals, numbered by two windows without a key.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.select("*", w.cast("long").alias("_w"), (F.col("source_size") * epochs).alias("_cap"))
    full = Window.partitionBy(F.lit(0)).orderBy((F.col("_cap") / F.col("_w")).asc(), F.col(source).asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest)
    t = t.select("*", level.alias("_level"))
    # Below the first source that isn't full, the level stays as it is.
    t = t.select("*", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))).over(every)["level"].alias("_final"))
    share = F.col("_final") * F.col("_w")
    return t.select(source, "source_size", F.when(F.col("_final").isNull() | (share > F.col("_cap")), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each row of df: id, source, size (words; null text 0), source_size, target, taken.

    Rows of a source are put in the order of md5(id) (then id, then size), a random order that reruns repeat. With b words
    as the source's budget (target, rounded down) and s its size, each document is taken b // s times whole, and those
    whose words end before b % s once more; the one at the cut gives the words that are missing. So a source's taken
    words add up to its budget exactly, and no document gives more than epochs times its size.
    Empty tables give empty results; empty texts and null sources are rows like any other; equal ids share a key.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(common.WORD)).cast("long")
    flat = df.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), size.alias("size"))
    flat = flat.withColumn("_key", F.md5(F.encode(F.coalesce(F.col("_id").cast("string"), F.lit("")), "UTF-8")))
    placed = common.prefix_sums(flat, [F.col("_key"), F.col("_id"), F.col("size")], {"before": F.col("size")}, "_source")
    placed = common.persisted(placed, "placed")
    goal = targets(placed.groupBy("_source").agg(F.sum("size").alias("source_size")), "_source", weights, epochs)
    goal = goal.withColumnRenamed("_source", "_of")
    out = placed.join(goal, F.col("_source").eqNullSafe(F.col("_of")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """mixed with copies: how often a whole document goes into the mix, its taken words over its size rounded up; empty ones once."""
    return mixed.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int"))


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w, source_size * 3 as cap from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following))::double as level from w),
f as (select *, (select level from l where level * w <= cap order by cap / w, level limit 1) as fin from l),
t as (select source, source_size, case when fin is null or fin * w > cap then cap::double else fin * w end as target from f),
p as (select doc_id, source, size, (coalesce(sum(size) over (partition by source order by md5(doc_id::varchar), doc_id, size rows between unbounded preceding and 1 preceding), 0))::bigint as before from d),
b as (select p.*, source_size, target, floor(target)::bigint as budget from p join t on p.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as whole from b)
select doc_id, source, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::bigint as taken from e
"""
