"""Tables that cut lineage, written under the shared folder of the cluster.

The folder is the one in ``spark.checkpoint.dir``. Only where that is unset and the master is local
(tests, a single machine) a local folder is used; on a cluster that is an error. Written tables outlive
executors, so a lost executor never sends a query back beyond the last table. Tables that a result
still reads stay until the driver ends or ``release`` is called.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers each that a file of a written table holds, at most, where their number has a bound.
ROWS_A_FILE = 200_000

_local: str | None = None
_known: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or one local folder of this process if none is named."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="rowatlas-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return _local


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rowatlas/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    own = _own(spark)
    if own not in _known:
        _known.add(own)
        atexit.register(_leave, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete all tables of this application; results that read them are then gone."""
    remove(spark, _own(spark))


def _leave(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM has gone before
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table; missing ones are no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Written tables of one query; ``drop`` gives disk back as soon as a table has served."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` as a table. With ``rows``, a bound of the rows that reach its last stage, it gets a file for each
        ROWS_A_FILE of them (and one a core) instead of one a partition: small files cost more than what they hold."""
        path = new_path(self.spark, name)
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def give_back() -> None:
    """Return memory that a worker has freed to the system: workers live on and serve other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
