"""Helpers that several operators share: the shared work folder, ordered prefix sums, file access, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regex of one word and of white space, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows in one Arrow batch: whole texts travel in them, so far fewer than Spark's default.
BATCH_ROWS = 512


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset and Spark runs in one machine's process, it gets a local folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Sessions' settings that bound memory: small Arrow batches, as rows hold whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def persisted(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete persisted() tables that nothing reads any more: all that came from them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], group: str | None = None) -> DataFrame:
    """df with, for each name of sums, the sum of that column over all rows before (in order; within the group, if given).

    Rows are written with a number of their own, range-sorted (the group comes first), written, and numbered in two levels: totals for each
    partition (and group), then running sums inside a partition. No task sees more than one range partition;
    the totals are as many as partitions and groups together. Equal rows are parted by their numbers, so a hot key can be split.
    """
    spark = df.sparkSession
    lead = [F.col(group).asc_nulls_last()] if group else []
    flat = df.select("*", *(c.alias(f"_size_{k}") for k, c in sums.items()), *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    flat = persisted(flat.withColumn("_tie", F.monotonically_increasing_id()), "flat")
    inner = [F.col(c).asc_nulls_last() for c in (*(f"_o{i}" for i in range(len(order))), "_tie")]
    keys = lead + inner
    n = partitions(spark)
    ranged = flat.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    ranged = persisted(ranged, "ranged")
    discard(flat)
    by = ["_part", *([group] if group else [])]
    totals = ranged.groupBy(*by).agg(*(F.sum(f"_size_{k}").alias(f"_total_{k}") for k in sums))
    before = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_at_{c}") for c in by), *(F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums))
    inside = Window.partitionBy(*by).orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(f"_size_{k}").over(inside), F.lit(0)).alias(f"_in_{k}") for k in sums))
    met = local.join(offsets, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by])
    return met.select(*(F.col(c) for c in df.columns), *((F.col(f"_base_{k}") + F.col(f"_in_{k}")).cast("long").alias(k) for k in sums))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, root), root the smallest id reachable; only nodes with an edge.

    Repeated contraction: in an order mixed by a hash, each node hooks onto its first neighbour, edges move to the
    hooks, loops and repeats go. Mixing makes even a sorted chain shrink by a constant factor in each round.
    Every round's tables are written to the shared folder; nodes and edges never reach the driver.
    """
    spark = edges.sparkSession
    left = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    left = persisted(left, "edges")
    label = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u")).toDF("u", "v")
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(F.col("m"), rank("u"))["id"].alias("to"))
        hook = persisted(hook, "hooks")
        if label is None:
            label = persisted(hook.select(F.col("u").alias("node"), F.col("to").alias("root")), "labels")
        else:
            old, label = label, persisted(label.join(hook.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            discard(old)
        moved = left.join(hook.toDF("u", "hu"), "u").join(hook.toDF("v", "hv"), "v")
        old, left = left, persisted(moved.where("hu <> hv").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")).distinct(), "edges")
        discard(old, hook)
    discard(left)
    if label is None:
        return spark.createDataFrame([], "node long, root long")
    # Written, so that the join exchanges both sides and adaptive execution can split a hot component.
    first = persisted(label.groupBy("root").agg(F.min("node").alias("least")), "least")
    return label.join(first, "root").select("node", F.col("least").alias("root"))


def opened(uri: str):
    """(file system, path) of a URI, so that Python tasks reach whatever store the shared folder is in."""
    from pyarrow import fs

    if uri.startswith("/"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    where, path = opened(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    where, path = opened(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def crc(column: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))


def texts(batch, column: str = "text") -> list[str]:
    """A record batch's texts as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def rows(batches: Iterator, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
