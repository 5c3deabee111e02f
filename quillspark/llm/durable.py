"""Cut lineage through tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables that were made and not yet removed, in order.
_MADE: list[str] = []


#: Bytes of a Parquet row group, and of a batch that goes to Python, and rows that a Parquet reader holds at once: 10,000 texts can be long ones.
ROW_GROUP = 16 << 20
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests on one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _OWN["dir"]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session or its gateway may be gone at exit
        pass


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's batches by bytes too, where a setting is still Spark's own or larger.

    The settings stay: results are lazy, and Spark reads them when the result is computed.
    """
    for key, value in _BATCHES.items():
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= value:
            spark.conf.set(key, str(value))


def durable(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later reads survive the loss of any executor, prune columns, and never compute ``df`` again.
    The files are removed by :func:`sweep`, or when the driver's Python ends. Memory for row groups and for batches
    between the JVM and Python is bounded by bytes, not by rows alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{what}-{uuid.uuid4().hex}"
    bound_batches(spark)
    # hashes and numbers fill most tables: a dictionary of them costs time and saves nothing
    df.write.option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(path)
    if not _MADE:
        atexit.register(lambda: sweep(spark, 0))
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables there are now: a mark for :func:`sweep`."""
    return len(_MADE)


def sweep(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Remove the tables made since a mark, but the last ``keep``: for callers whose result no longer needs them."""
    gone = _MADE[mark : len(_MADE) - keep]
    del _MADE[mark : len(_MADE) - keep]
    for path in gone:
        _forget(spark, path)


#: Rows (or list entries) that a broadcast side may have: about 20 MB.
BROADCAST_ROWS = 600_000


def light(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A durable table of counted size as the broadcast side of a join, or as it is (a shuffled join) above the bound."""
    return F.broadcast(df) if rows <= most else df
