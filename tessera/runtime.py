"""Session helpers: shared scratch tables, size-checked broadcasts and Arrow batch limits."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many bytes of row data.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where driver and executors are one process may it be unset; then it is a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Hadoop's usual class for local paths starts a chmod for a file and one more for its checksum file, each at first as a
#: copy of the executor's process. This one writes no checksum files. Other file systems ignore both.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def session_conf(spark: SparkSession, key: str, value: str):
    """A session setting that holds while the body runs its jobs."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(name)
        with session_conf(self.spark, _CLEANUP, "true"):  # nothing reads this job's shuffle files once the table stands
            df.write.mode("overwrite").options(**_PLAIN_FILES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def arrow_rows(spark: SparkSession, rows: int):
    """Rows in an Arrow batch while the body runs its jobs; wide rows need small batches."""
    return session_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if the rows of ``df`` (already written, so the count is cheap) fit the broadcast limit."""
    return df.count() * row_bytes <= limit


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Equi-join that broadcasts ``right`` only if its measured size allows; otherwise it shuffles both sides."""
    return left.join(F.broadcast(right) if small_enough(right, row_bytes) else right, on, how)
