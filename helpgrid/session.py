"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast up to this many bytes, measured.
BROADCAST_BYTES = 32 << 20

# Rows of a partition of a shuffle, about, where their number is known beforehand.
PARTITION_ROWS = 1 << 21

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("helpgrid")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="helpgrid-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/helpgrid/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: what was computed is not lost with an executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting ``name`` is ``value`` inside, and as before afterwards."""
    given = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, given)


@contextmanager
def partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Writes inside shuffle ``rows`` rows: they get partitions of about ``PARTITION_ROWS``, or as many as are set, if that is more.

    With a fixed number the partitions, and with them the memory and spill of a sort or a sum, grow with the input.
    """
    name = "spark.sql.shuffle.partitions"
    with setting(spark, name, str(max(int(spark.conf.get(name)), -(-rows // PARTITION_ROWS)))):
        yield


def small(df: DataFrame) -> DataFrame:
    """A written frame of numbers, marked for broadcast if its rows are few enough."""
    # eight bytes a column and a row's overhead
    return F.broadcast(df) if df.count() * (8 * len(df.columns) + 32) <= BROADCAST_BYTES else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="helpgrid-zip-"), "helpgrid.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*")):
            if path.suffix in (".py", ".txt"):
                out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
