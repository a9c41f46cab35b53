"""Incremental ingest: a stream of progress or rows is upserted batch by batch, and the index refreshed along the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Rows after which the index is refreshed.
CHECKPOINT_ROWS = 50


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset it is a local one, if Spark runs in this process only; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Versions:
    """A table as one folder for each micro-batch, named by its number: the state is what is in storage, so a restarted stream goes on with it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n) for n in found if n.isdecimal() and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def before(self, number: int) -> DataFrame | None:
        """The table as the batches before this one left it."""
        past = [n for n in self.numbers() if n < number]
        return self.spark.read.parquet(f"{self.root}/{past[-1]}") if past else None

    def write(self, number: int, df: DataFrame) -> None:
        """A batch that is done again writes the same folder."""
        df.write.mode("overwrite").parquet(f"{self.root}/{number}")

    def last(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.numbers()[-1]}")


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes through apply(batch, its number), which must be idempotent for a batch; a restart goes on from checkpoint."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Refresher:
    """Calls refresh() once at least CHECKPOINT_ROWS rows have come since the last time."""

    def __init__(self, refresh: Callable[[], None], every: int = CHECKPOINT_ROWS):
        self.refresh, self.every, self.rows, self.times = refresh, every, 0, 0

    def add(self, rows: int) -> None:
        self.rows += rows
        if self.rows >= self.every:
            self.refresh()
            self.rows, self.times = 0, self.times + 1
