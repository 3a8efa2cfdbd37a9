"""Session construction for local runs, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "eventcal", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


# The JVM does not compile methods above 8000 bytecodes. Parsing one export row can exceed that
# when fused into one stage, and then runs interpreted, about ten times slower; with this limit
# Spark generates code per operator instead.
JIT_METHOD_LIMIT = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the plans here rely on. Another time zone than UTC is changed with a warning."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_LIMIT)
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT"):
        warnings.warn(f"days are cut in UTC: spark.sql.session.timeZone was {zone}", stacklevel=2)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.sparkContext.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode a temporary one when none is named (tests)."""
    root = _configured_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="eventcal-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, so a retry cannot read half a write."""
    return f"{scratch_root(spark).rstrip('/')}/eventcal-{label}-{uuid.uuid4().hex}"


#: Of a narrow, well-packed table 128 MB are ten million rows, which a task that sorts what it reads cannot hold.
SCAN_BYTES = "16m"


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def finer_scans(spark: SparkSession):
    """Scans that run in here are cut into smaller tasks, as far as row groups and lines allow."""
    return _set(spark, "spark.sql.files.maxPartitionBytes", SCAN_BYTES)


def times_with_statistics(spark: SparkSession):
    """Parquet files written in here have the least and greatest time of each row group in their footers.

    Times as Spark writes them by default (INT96) have none, but where all times of a row group are equal.
    """
    return _set(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def stored(df: DataFrame, label: str = "step", *more: DataFrame) -> DataFrame:
    """Write a reduced frame to the shared folder and read it back; with ``more`` frames of its columns, one after another, as one.

    For day- and cell-grain results that several branches of one plan build on: they are computed
    once, survive lost executors, and come back with a known size.
    """
    path = scratch_path(df.sparkSession, label)
    # What was shuffled for it is of no more use; Spark alone would keep it until the driver happens to collect its garbage.
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        # Their footers tell times, so that what reads a stretch of them skips the others.
        with times_with_statistics(df.sparkSession):
            df.write.parquet(path)
            for other in more:
                other.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
