"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.standins import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Dates as ISO text and doubles at six decimals, so both engines print alike."""

    def out(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(c, 6) + F.lit(0.0)).alias(f.name)
        return c

    return df.select(*[out(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = "", dates: str = ""):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` is the oracle over the stand-ins.

    ``doubles`` and ``dates`` name the oracle columns to print as ``portable`` does.
    """

    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: portable(fn(Inputs(spark, folder)))
        if sql is not None:
            swaps = [f'round("{c}", 6) + 0e0 AS "{c}"' for c in doubles.split()]
            swaps += [f'cast("{c}" AS varchar) AS "{c}"' for c in dates.split()]
            text = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql}) q" if swaps else sql
            ORACLES[name] = oracle(text)
        return fn

    return add
