"""Cut lineage through a Parquet table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset and everything runs on one machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _OWN["dir"]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session or its gateway may be gone at exit
        pass


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` and read it back; the files go when the driver's Python ends."""
    path = f"{shared_dir(df.sparkSession)}/quillspark-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
