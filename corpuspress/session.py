"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package.

    Workers inherit the JVM's environment, not the driver's ``sys.path``; on a
    cluster the package is installed or shipped with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    # Rows here are whole texts: batches of Spark's default size would hold tens of megabytes in both the JVM and Python.
    for name, value in ARROW.items():
        if spark.conf.get(name, None) in DEFAULTS.get(name, (None,)):
            spark.conf.set(name, value)
    return spark


#: Bytes of input to a partition of heavy work.
PART = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to partitions of bounded size, four to a core at least, before heavy work.

    A file is split at its row groups at best, so a table with few of them keeps
    few cores busy whatever Python work follows, and its longest task grows with
    the table.  The plan's statistics decide, and only the plan depends on them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(4 * cores, -(-size // PART))) if size < UNKNOWN else df


#: A plan without statistics has a size like the largest long.
UNKNOWN = 1 << 60

ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", None), "spark.sql.execution.arrow.maxBytesPerBatch": ("9223372036854775807", "268435456", "67108864", "-1", "2147483647", None)}
