"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skeinlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; extra settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may do without that setting; it then gets a folder of its own that ends with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skeinlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_SCRATCH: list[list[Workspace]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes every workspace made inside at the end; results must have been written or collected by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for work in _SCRATCH.pop():
            work.close()


class Workspace:
    """Tables written to the shared folder: durable cuts of the lineage that survive a lost executor.

    A table stays until ``drop``, ``close`` or the end of a ``scratch`` block; frames that read it must have been consumed by then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if _SCRATCH:
            _SCRATCH[-1].append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write once, read back: later stages start from files, not from lineage."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop(self, table: str) -> None:
        self._delete(self.path(table))

    def close(self) -> None:
        self._delete(self.root)
