"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; a
    cluster must name one that every executor can reach.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="sievework-")
    context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


# Per open `scratch` block the paths that were given out in it, with their names.
_owned: list[list[tuple[str, str]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append((name, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this program has written, through the Hadoop file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, keep: Sequence[str] = ()) -> Iterator[None]:
    """Delete the intermediate tables of the block at its end, but for those with a
    name in `keep`, which an outer block owns then. What the block has computed
    must be written by its end: DataFrames that still read its tables fail."""
    _owned.append([])
    try:
        yield
    finally:
        for name, path in _owned.pop():
            if name not in keep:
                remove(spark, path)
            elif _owned:
                _owned[-1].append((name, path))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, keeps column pruning,
    and gives the planner the true size, so it broadcasts a table only if that
    is under `spark.sql.autoBroadcastJoinThreshold`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_complete(spark: SparkSession, path: str) -> bool:
    """Whether an earlier write to `path` ended well (its marker file exists)."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return bool(marker.getFileSystem(conf).exists(marker))
