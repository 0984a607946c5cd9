"""Tables written to the folder that the driver and all executors share, and read again: what cuts a lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; on a single machine that has none, the warehouse. Qualified
    by the file system that Spark itself would take for it."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at and context._jsc.sc().getCheckpointDir().isDefined():
        at = context._jsc.sc().getCheckpointDir().get()
    if not at:
        if not context.master.startswith(("local[", "local-cluster")) and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir")
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again; the files go when the driver ends."""
    spark = df.sparkSession
    if not _made:
        atexit.register(_clean)
    path = f"{folder(spark)}/versewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have gone; what is left is in a folder of its own
            pass
    _made.clear()
