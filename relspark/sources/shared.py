"""Tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: set[str] = set()


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="relspark-db-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def _session_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application ends."""
    uri = f"{root(spark)}/relspark/{spark.sparkContext.applicationId}"
    if uri not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _made.add(uri)
    return uri


def fresh(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared folder (not made yet)."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here."""
    spark = df.sparkSession
    uri = fresh(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
