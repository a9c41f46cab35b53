"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS, ROUNDS = 24, 8
#: Gains and hashes that moves are counted by, for quotas: a fixed number of counters for each pair of shards.
GAINS, BUCKETS = 6, 32


def _quotas(moves: list, load: list[int], cap: float) -> list[tuple[int, int, int]]:
    """(from, to, cut): moves whose rank is below cut may go. Opposite moves are paired; what is left over fills free room."""
    by: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for r in moves:
        by[r["label"], r["to"]][r["rank"]] = r["n"]
    room = {k: cap - x for k, x in enumerate(load)}
    out = []
    for pair in sorted(by, key=lambda p: (min(by[p]), p)):
        a, b = pair
        back = sum(by.get((b, a), {}).values())
        allowed = min(sum(by[pair].values()), back)
        extra = max(0.0, min(sum(by[pair].values()) - allowed, room[b]))
        taken, cut = 0, 0
        for rank in sorted(by[pair]):
            if taken + by[pair][rank] > allowed + extra:
                break
            taken, cut = taken + by[pair][rank], rank + 1
        room[b] -= max(0, taken - allowed)
        if cut:
            out.append((a, b, cut))
    return out


def propagate(nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, anchor) for nodes with edges (a, b): labels after rounds of moves; anchor is the smallest id of the node and its neighbours.

    nodes has a row for each document: linked ones must not exceed the mean of all in a shard, as others fill the shards up. Labels begin as a hash of the id. In a round half of the nodes, by
    a hash, ask to move to the label that most of their neighbours have; the gain is how many more neighbours they
    would meet. Moves are counted by (from, to, gain, hash), a fixed number of counters, from which the driver sets for
    each pair of shards which may go: opposite moves in pairs, others where there is room.
    Neighbours' labels are counted with partial aggregation, so nodes with millions of neighbours do no harm.
    """
    start = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.persisted(both, "neighbours")
    spark = both.sparkSession
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("first")).select("id", start.alias("label"), F.least("id", "first").alias("anchor"))
    label = common.persisted(label, "labels")
    total = {r["label"]: r["count"] for r in label.groupBy("label").count().collect()}
    load = [total.get(k, 0) for k in range(shards)]
    cap = nodes.count() / shards
    for k in range(rounds):
        votes = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("there")), "b").groupBy(F.col("a").alias("id"), "there").agg(F.count(F.lit(1)).alias("votes"))
        asked = votes.join(label, "id")
        best = F.max(F.struct("votes", (F.col("there") == F.col("label")).alias("same"), (-F.col("there")).alias("neg")))
        asked = asked.groupBy("id", "label", "anchor").agg(best.alias("best"), F.sum(F.when(F.col("there") == F.col("label"), F.col("votes")).otherwise(0)).alias("now"))
        gain = F.col("best.votes") - F.col("now")
        on = F.pmod(F.xxhash64("id", F.lit(100 + k)), F.lit(2)) == 0
        rank = (F.lit(GAINS) - F.least(gain, F.lit(GAINS))) * BUCKETS + F.pmod(F.xxhash64("id", F.lit(200 + k)), F.lit(BUCKETS))
        asked = asked.select("id", "label", "anchor", F.when(on & (gain > 0), (-F.col("best.neg")).cast("int")).alias("to"), rank.cast("int").alias("rank"))
        asked = common.persisted(asked, "moves")
        old = label
        counted = asked.where("to is not null").groupBy("label", "to", "rank").agg(F.count(F.lit(1)).alias("n")).collect()
        quotas = _quotas(counted, load, cap)
        if not quotas:
            common.discard(asked)
            break
        cuts = {(a, b): cut for a, b, cut in quotas}
        for r in counted:
            if r["rank"] < cuts.get((r["label"], r["to"]), 0):
                load[r["label"]] -= r["n"]
                load[r["to"]] += r["n"]
        # At most one row for each pair of shards.
        allowed = F.broadcast(spark.createDataFrame(quotas, "label int, to int, cut int"))
        label = asked.join(allowed, ["label", "to"], "left").select("id", F.when(F.col("rank") < F.col("cut"), F.col("to")).otherwise(F.col("label")).alias("label"), "anchor")
        label = common.persisted(label, "labels")
        common.discard(asked, old)
    common.discard(both)
    return label


def equal_text_edges(docs: DataFrame) -> DataFrame:
    """(a, b): of rows (id, sha) each to the smallest id of its digest, for digests of several ids: as many edges as rows, not pairs."""
    hub = docs.groupBy("sha").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "b")
    # Written, so that the join exchanges both sides and adaptive execution can split a hot digest.
    hub = common.persisted(hub, "hubs")
    return docs.join(hub, "sha").select(F.col("id").alias("a"), "b").where("a is not null and b is not null and a <> b")


def _deal(over: Column, free: list[float], shards: int) -> Column:
    """The shard whose free room holds place over, when free rooms are laid end to end; the last one with room takes what is beyond them."""
    ends, at = [], 0.0
    for k in range(shards):
        if free[k] > 0:
            at += free[k]
            ends.append((k, at))
    out = F.lit(ends[-1][0] if ends else 0)
    for k, end in reversed(ends[:-1]):
        out = F.when(over < end, k).otherwise(out)
    return out


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edges: DataFrame | None = None, law: str = "rows", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of df: id_col, size, text_crc32, law, shard, slot, grown_shard (null), label.

    size: UTF-8 bytes of the text (null: none) plus 8. edges (a, b) link ids; by default equal texts are linked, a star for each
    digest. Law "rows": a row goes to the shard of its label while that has room for it, which is an equal share of the rows (counts at
    most one apart); in a label linked rows come first, in order of anchor and id, then unlinked ones; those beyond the room fill what others
    have left. Law "bytes": rows in order of label, then the same, are cut into equal bytes, a row belonging where it begins. Unlinked rows get
    labels by hash, in proportion to the room that linked ones leave. slot numbers a shard's rows from 0. Null ids are linked with none; repeated rows are
    rows of their own; an empty table gives none.

    Rows are ranked within labels by two-level prefix sums; the driver holds numbers for each shard only.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), common.crc(text).alias("text_crc32"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"))
    docs = common.persisted(docs, "documents")
    labels = propagate(docs, equal_text_edges(docs) if edges is None else edges, shards, rounds)
    placed = docs.drop("sha").join(labels.withColumnRenamed("id", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    linked = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    free = F.pmod(F.xxhash64("id", "text_crc32"), F.lit(1 << 30)) / (1 << 30)
    room = [max(0.0, n / shards - linked.get(k, 0)) for k in range(shards)]
    placed = placed.select("id", "size", "text_crc32", F.coalesce("label", _deal(free * sum(room), room, shards)).alias("label"), F.when(F.col("label").isNull(), 1).otherwise(0).alias("loose"), F.coalesce("anchor", "id").alias("anchor"))
    order = [F.col(c) for c in ("loose", "anchor", "id", "text_crc32", "size")]
    if law == "bytes":
        ranked = common.prefix_sums(placed, [F.col("label"), *order], {"at": F.col("size")}).withColumn("shard", F.floor(F.col("at") * shards / max(total, 1)).cast("int"))
    else:
        ranked = common.persisted(common.prefix_sums(placed, order, {"at": F.lit(1).cast("long")}, "label"), "ranked")
        count = {r["label"]: r["count"] for r in ranked.groupBy("label").count().collect()}
        share = [n // shards + (k < n % shards) for k in range(shards)]
        beyond = [max(0, count.get(k, 0) - share[k]) for k in range(shards)]
        # Rows beyond a label's share, of all labels in a row, fill the free room of all shards in a row.
        before, share_of = F.lit(0), F.lit(0)
        for k in range(shards):
            before = F.when(F.col("label") == k, sum(beyond[:k]) - share[k]).otherwise(before)
            share_of = F.when(F.col("label") == k, share[k]).otherwise(share_of)
        dealt = _deal(F.col("at") + before, [max(0, share[k] - count.get(k, 0)) for k in range(shards)], shards)
        ranked = ranked.withColumn("shard", F.when(F.col("at") < share_of, F.col("label")).otherwise(dealt).cast("int"))
    out = common.prefix_sums(ranked, [F.col(c) for c in ("loose", "anchor", "id", "text_crc32", "size", "label")], {"slot": F.lit(1).cast("long")}, "shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "label")


def cut_edges(sharded: DataFrame, edges: DataFrame, id_col: str = "doc_id") -> tuple[int, int]:
    """(edges whose ends are in different shards, all edges)."""
    of = sharded.select(F.col(id_col).alias("id"), "shard")
    met = edges.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b")
    return tuple(met.agg(F.count_if(F.col("sa") != F.col("sb")), F.count(F.lit(1))).first())
