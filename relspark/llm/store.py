"""The shared folder of a cluster, and plain files in it.

``spark.checkpoint.dir`` names a folder that the driver and all executors see.
Where it is unset (tests on one machine) a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="relspark-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def _session_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application ends."""
    uri = f"{shared_root(spark)}/relspark/{spark.sparkContext.applicationId}"
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
    """``df`` written as a shared Parquet table and read again: lineage ends here."""
    spark = df.sparkSession
    uri = fresh(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def _fs(uri: str):
    """``(filesystem, path)``; None for a path that the operating system opens."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data) -> None:
    """Writes a file whole or not at all; a second attempt replaces the first."""
    system, path = _fs(uri)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as f:
            for part in data:
                f.write(part)
        os.replace(temp, path)
        return
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(temp) as f:
        for part in data:
            f.write(part)
    system.move(temp, path)


def array(uri: str, dtype, start: int = 0, count: int | None = None):
    """A range of a flat binary file as an array; memory-mapped where it can be."""
    import numpy as np

    system, path = _fs(uri)
    item = np.dtype(dtype).itemsize
    if system is None:
        size = os.path.getsize(path) // item
        count = size - start if count is None else min(count, size - start)
        return np.memmap(path, dtype, "r", offset=start * item, shape=(count,)) if count > 0 else np.zeros(0, dtype)
    with system.open_input_file(path) as f:
        size = f.size() // item
        count = size - start if count is None else min(count, size - start)
        f.seek(start * item)
        return np.frombuffer(f.read(count * item), dtype)


def length(uri: str) -> int:
    system, path = _fs(uri)
    return os.path.getsize(path) if system is None else system.get_file_info(path).size
