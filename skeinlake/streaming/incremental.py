"""Incremental judging and counting: keyed state with last-wins, resume by done keys, windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import last_per_key


class FingerprintMismatch(ValueError):
    """State belongs to other inputs."""


class StateTable:
    """A keyed table kept as versions in a folder: every batch writes the merged state beside the old and then names it.

    A batch that is replayed after a failure writes the same version again. The state is bound to a fingerprint of its
    inputs; opening it with another one raises.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: list[str], fingerprint: str = ""):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        mark = self._path(f"{self.root}/_fingerprint")
        if self._fs.exists(mark):
            with_ = self.spark.read.text(f"{self.root}/_fingerprint").first()
            if (with_[0] if with_ else "") != fingerprint:
                raise FingerprintMismatch(f"{self.root} was built from other inputs")
        else:
            spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.text(f"{self.root}/_fingerprint")

    def _versions(self) -> list[int]:
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        done = [int(n[1:]) for n in names if n[:1] == "v" and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self) -> DataFrame | None:
        v = self._versions()
        return self.spark.read.parquet(f"{self.root}/v{v[-1]}") if v else None

    def merge(self, batch: DataFrame, version: int) -> None:
        """The last row of each key among the state before this version and the batch."""
        before = [v for v in self._versions() if v < version]
        rows = batch if not before else self.spark.read.parquet(f"{self.root}/v{before[-1]}").unionByName(batch)
        last_per_key(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.root}/v{version}")
        for old in before[:-1]:  # one older version stays for readers
            self._fs.delete(self._path(f"{self.root}/v{old}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
        """Merge a stream batch by batch, exactly once per version, until what is there is read."""
        step = lambda df, epoch: self.merge(prepare(df), epoch + 1)
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to do."""
    return work.join(done.select(key), key, "left_anti")


def resume_prefix(expected: DataFrame, given: DataFrame, key: str, order: str) -> DataFrame:
    """Rows behind a finished prefix. ``given`` must hold the first keys in order; a hole or a stranger raises."""
    n = given.count()
    held = expected.join(given.select(key), key, "left_semi").agg(F.count("*"), F.max(order)).first()
    upto = expected.where(F.col(order) <= F.lit(held[1])).count() if held[0] else 0
    if not n == held[0] == upto:
        raise ValueError("what is given is no prefix of what is expected")
    return expected.join(given.select(key), key, "left_anti")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per time window and keys; rows later than ``late`` behind the newest are dropped by the watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs a timestamp with zone
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: a new one after ``gap`` without an event."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
