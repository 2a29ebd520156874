"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}


def build_session(
    app_name: str = "vecloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC time.

    On a cluster leave ``master``, ``shuffle_partitions`` and ``driver_memory`` unset:
    they come from the submit configuration, and adaptive execution coalesces the
    shuffle partitions it does not need.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without
    that setting gets a folder of its own; a cluster session without it is an error,
    because a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="vecloom-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives the loss of any executor, starts a new lineage and carries
    exact file sizes, which the optimiser uses to choose join strategies. A loop may
    pass two paths in turn, so that it overwrites only what is no longer read.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def least_shuffle_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """Jobs run inside have at least ``least`` shuffle partitions; Spark joins those that turn out small."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(least, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def few_shuffle_partitions(spark: SparkSession, most: int) -> Iterator[int]:
    """Jobs run inside have at most ``most`` shuffle partitions and are not planned again between their stages.

    For loops of short jobs whose exchanges have few rows, dealt evenly.
    """
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(name) for name in names]
    parts = min(most, int(before[0]))
    for name, value in zip(names, (str(parts), "false"), strict=True):
        spark.conf.set(name, value)
    try:
        yield parts
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
