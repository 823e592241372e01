"""Cutting lineage: intermediate tables written to the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where it is unset (tests, a laptop) a local one is made; a written
table survives the loss of any executor, unlike cached or locally checkpointed blocks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a local master without it, a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="tideline-")
    return _SCRATCH[app]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discarded_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` when the process ends, if the session still lives then."""

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner cleans up then
            pass

    atexit.register(clean)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table; it is deleted when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    discarded_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """A number of partitions from the optimizer's estimate of the size of ``df``: one for each ``bytes_each``, at least one a core.

    Given to a shuffle outright, so that a stage of few bytes but much work keeps all cores busy and one of many bytes stays within memory. ``df`` reads tables; for joins the estimate would be a product."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # the optimizer doesn't know
        return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(spark.sparkContext.defaultParallelism, -(-size // bytes_each))
