"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs in this process (tests), a new local folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts in a few MB each, in the JVM as in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def mounted(path: str) -> str | None:
    """The path as every worker can open it, or None if only Spark's readers reach it."""
    parsed = urlparse(path)
    return parsed.path if parsed.scheme in ("", "file") else None


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def kept_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that `drop` leaves alone."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, tag: str, key: str, gather: bool = False) -> DataFrame:
    """Like `written`, bucketed by `key`: joins and groups on the key read it without a shuffle.

    With `gather` the rows of a bucket are brought together first, so that it is one file. The catalog names
    the files only until they are read here.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = "scratch_" + path.rsplit("-", 1)[1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, key) if gather else df
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished queries that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def made() -> int:
    """How many folders have been made so far."""
    return len(_made)


def drop(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders made after the first `since` ones; only when no DataFrame that reads them is used any more."""
    jvm = spark.sparkContext._jvm
    for path in _made[since:]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since:]
