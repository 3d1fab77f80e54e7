"""CSV and Parquet."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.reshape import stack


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str, header: bool = True
) -> DataFrame:
    """CSV under a declared schema; ``NA`` and unreadable numbers are NULL."""
    return spark.read.csv(
        path if isinstance(path, str) else list(path),
        schema=schema,
        header=header,
        nullValue="NA",
        enforceSchema=not header,
    )


def read_wide_matrix(
    spark: SparkSession, path: str, width: int, header: bool = False, leading: int = 0
) -> DataFrame:
    """Region matrix without usable names: columns ``v0..``, rows numbered from 1.

    ``leading`` columns are skipped by position; columns past ``width`` are cut.
    """
    # A declared schema shorter than the file drops the surplus columns on the right.
    fields = [f"s{i} string" for i in range(leading)] + [f"v{i} double" for i in range(width)]
    raw = spark.read.csv(path, schema=", ".join(fields), header=header, nullValue="NA")
    numbered = with_row_position(raw.drop(*[f"s{i}" for i in range(leading)]), "row_id")
    return numbered.select("row_id", *[f"v{i}" for i in range(width)])


def with_row_position(df: DataFrame, name: str = "row_id") -> DataFrame:
    """1-based position of each row in the input, files taken in name order.

    Works on a fresh file scan.  Rows of one file block are contiguous in a task, so
    the position is the rank inside the block plus the sizes of the blocks before
    it.  Only the list of blocks, one row each, is ordered as a whole.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )
    before = (
        W.partitionBy(F.lit(0)).orderBy("__file", "__block").rowsBetween(W.unboundedPreceding, -1)
    )
    blocks = (
        tagged.groupBy("__file", "__block")
        .agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .drop("__rows")
    )
    position = F.col("__before") + F.col("__seq") - F.col("__first") + 1
    return (
        tagged.join(blocks, ["__file", "__block"])
        .withColumn(name, position)
        .drop("__file", "__block", "__seq", "__first", "__before")
    )


def read_ragged(
    spark: SparkSession,
    paths: Sequence[str],
    types: Mapping[str, str] | None = None,
    fallbacks: Mapping[str, str] | None = None,
    source: str = "source_file",
    default_type: str = "double",
) -> DataFrame:
    """Files with differing columns under one schema, missing columns NULL.

    One scan of the lines finds each file's header; files with the same header are one scan
    of their own, so the plan grows with the kinds of files and not with their number.  Empty
    files are left out.  ``fallbacks`` renames ``old -> new`` in files that lack ``new``.
    """
    types = dict(types or {})
    lines = spark.read.text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__n"),
    )
    first = lines.where("__start = 0").groupBy("__file").agg(F.min_by("value", "__n").alias("header"))
    kinds: dict[str, list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: r["__file"]):
        kinds.setdefault(row["header"], []).append(unquote(row["__file"]))

    def typed(header: str, files: list[str]) -> DataFrame:
        columns = next(csv.reader([header]))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = spark.read.csv(files, schema=schema, header=True, nullValue="NA", enforceSchema=True)
        names = {c: c for c in columns}
        for old, new in (fallbacks or {}).items():
            if new not in names and old in names:
                names[old] = new

        def value(old: str, new: str) -> Column:
            kind = types.get(new, default_type)
            col = F.col("`" + old.replace("`", "``") + "`")
            return (col if kind == "string" else col.try_cast(kind)).alias(new)

        return df.select(*[value(o, n) for o, n in names.items()], F.col("_metadata.file_path").alias(source))

    return stack([typed(h, f) for h, f in kinds.items()])


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a product table as Parquet, one directory per partition value."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def save_product(
    df: DataFrame, name: str, path: str, keys: Sequence[str], wave: str, buckets: int = 64
) -> DataFrame:
    """Write or rewrite waves of a product table that keeps its layout; returns the table.

    Rows are bucketed and sorted by ``keys`` within each wave, so windows and joins on the keys
    need no shuffle.  The first call makes the table at ``path``; later ones replace the
    waves that ``df`` holds and leave the others as they are.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, *keys)
    if not spark.catalog.tableExists(name):
        writer = dealt.write.format("parquet").partitionBy(wave).bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", path).saveAsTable(name)
        return spark.table(name)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        dealt.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    return spark.table(name)


def open_product(
    spark: SparkSession, name: str, path: str, schema: str, keys: Sequence[str], wave: str, buckets: int = 64
) -> DataFrame:
    """A product table written in another session, under the layout it was written with."""
    if not spark.catalog.tableExists(name):
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (`{wave}`) "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
