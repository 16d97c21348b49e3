"""The shared folder of the cluster, and tables settled in it.

Intermediate results that are read more than once are written there and read
back: the lineage ends at a file every executor can reach, so a lost executor
costs a re-read and not a re-computation.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only while its measured size stays below this.
BROADCAST_BYTES = 128 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-"))
    return context.getCheckpointDir().rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def settled_scope(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are removed at the end: for jobs whose result is written elsewhere by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``settle``, and aggregate ``measures`` over the rows in the same write job."""
    observed = Observation(f"{name}-{uuid.uuid4().hex}")
    table = settle(df.observe(observed, *[c.alias(k) for k, c in measures.items()]), name)
    return table, observed.get


def bounded(df: DataFrame, name: str, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Settle and measure ``df``; the result is marked for broadcast only if it is within ``limit``."""
    table, measured = settle_measured(df, name, bytes=F.sum(row_bytes))
    return F.broadcast(table) if (measured["bytes"] or 0) <= limit else table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table that comes in fewer pieces than there are cores gets one piece per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="glyphmill-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for module in sorted(package.rglob("*.py")):
            packed.write(module, module.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
