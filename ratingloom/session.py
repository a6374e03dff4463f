"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextvars
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def session(app_name: str = "ratingloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    The master is left to ``spark-submit`` unless ``spark.master`` is given.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key even where that costs one more shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Adaptive execution merges small partitions but does not split grouped ones,
        # so the shuffle starts with many.
        .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8192")
        # Both are decided on sizes measured at run time; beyond them the join is
        # a sort-merge join.
        .config("spark.sql.autoBroadcastJoinThreshold", "64m")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ratingloom-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle starts with."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(first or spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for ``label`` under this application's scratch folder."""
    app = spark.sparkContext.applicationId
    path = f"{_shared_root(spark)}/ratingloom-{app}/{label}-{uuid.uuid4().hex}"
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint`` at the shared folder where none is set yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{_shared_root(spark)}/ratingloom-{sc.applicationId}/checkpoints")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    Used where a table is read several times or where an iteration must not
    drag its history along.  Unlike a cached table it survives the loss of
    executors, and unlike a checkpoint it keeps column pruning, pushed filters
    and a size that the optimizer knows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the block once it ends.

    For jobs that write their result; a DataFrame made inside must not be read
    afterwards.
    """
    folders: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), folders))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for folder in folders:
            _delete(spark, folder)


@contextmanager
def collected_scratch() -> Iterator[list[str]]:
    """Name what is staged inside the block, for :func:`delete_scratch` once nothing reads it any more."""
    folders: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), folders))
    try:
        yield folders
    finally:
        _SCOPES.reset(token)
        if _SCOPES.get():
            _SCOPES.get()[-1].extend(folders)


def delete_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Delete staged folders."""
    for folder in folders:
        _delete(spark, folder)


def release_scratch(spark: SparkSession) -> None:
    """Delete everything this application has staged."""
    _delete(spark, f"{_shared_root(spark)}/ratingloom-{spark.sparkContext.applicationId}")


def local_conf(cores: int | str, driver_memory: str = "20g") -> dict[str, str]:
    """Settings for a single-machine run."""
    parts = str(os.cpu_count() if cores == "*" else cores)
    return {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": driver_memory,
        "spark.sql.shuffle.partitions": parts,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": parts,
        "spark.ui.enabled": "false",
        # Small tables still spread over all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.files.openCostInBytes": "128k",
    }
