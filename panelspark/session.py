"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# What the operators rely on.  Cluster sizing (executors, memory, shuffle
# partitions) stays with whoever submits the job.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Capturing the Python call site of every column expression multiplies planning time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only when the session names none (local tests) is a temporary folder made,
    and it then also becomes the session's checkpoint folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared root; never reused between runs."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """Cut lineage through a table in the shared folder.

    A step of a loop then starts from files: it survives lost executors, and the
    planner sees the step's true size instead of an estimate grown over the loop.
    ``metrics`` are aggregates observed while writing, which spares a second pass.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not metrics:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), {}
    wanted = [c.alias(n) for n, c in metrics.items()]
    seen = Observation()
    df.observe(seen, *wanted).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    # A plan that collapses to nothing may report nothing; then the table is asked.
    values = seen.get or table.agg(*wanted).first().asDict()
    return table, values
