"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get gapless numbers in the order of a stated key.  A keyed Feistel network permutes
the smallest even-bit domain that holds them; values beyond the row count walk the cycle until they
fall inside.  Shard and slot follow from the permuted number by division, so both can be
computed for any row number, and the row number for any shard and slot, without the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import column, fresh
from panelspark.session import written

SHARDS = 16
SEED = 20_240_917
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0 .. n-1 and its inverse, on arrays."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [self._mix(np.uint64([seed + k]), np.uint64(k + 1))[0] for k in range(rounds)]

    @staticmethod
    def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        h = np.uint64(self.half)
        left, right = x >> h, x & self.mask
        for key in keys:
            left, right = right, left ^ (self._mix(right, key) & self.mask)
        return (right << h) | left

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        """A network run and swapped at the end is undone by the same run with its keys reversed."""
        x = self._once(np.asarray(x, dtype=np.uint64), keys)
        while True:
            out = np.flatnonzero(x >= np.uint64(self.n))
            if not len(out):
                return x.astype(np.int64)
            x[out] = self._once(x[out], keys)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


def place(rows: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    p = Feistel(n, seed).forward(rows)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number that sits at a shard and slot."""
    return Feistel(n, seed).back(np.asarray(slot) * shards + np.asarray(shard))


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with gapless row numbers by ``order``, and the number of rows.

    Rows are dealt by ranges of the order and sorted in each range; the ranges' counts give the
    offsets (one row per partition on its way through one task).  A random last key
    splits a run of equal rows over ranges; equal rows may swap numbers, which changes nothing.
    """
    part, at, tie = fresh(df, "part"), fresh(df, "at"), fresh(df, "tie")
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col(tie).asc()]
    dealt = df.withColumn(tie, F.rand(7)).repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).drop(tie)
    seq = F.monotonically_increasing_id()
    held, _ = written(dealt.withColumns({part: F.shiftright(seq, 33), at: seq.bitwiseAND((1 << 33) - 1)}), "row-numbers")
    counts = held.groupBy(part).agg(F.count(F.lit(1)).alias("rows")).collect()  # one row per partition
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r[0]):
        offsets.append((r[0], total))
        total += r[1]
    schema = T.StructType([T.StructField(part, T.LongType()), T.StructField("offset_", T.LongType())])
    table = df.sparkSession.createDataFrame(offsets, schema)
    number = (F.col("offset_") + F.col(at)).alias(name)
    return held.join(F.broadcast(table), part).select(*[column(c) for c in df.columns], number), total


def _placed(n: int, shards: int, seed: int):
    @F.pandas_udf("shard int, slot long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            shard, slot = place(rows.to_numpy(dtype=np.int64), n, shards, seed)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return run


def shard_rows(df: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0).

    Shard sizes differ by one row at most whatever the keys, so no key can be hot.  The
    placement depends on the rows, ``order`` and ``seed`` alone, not on partitioning.  Nulls in the
    order come first; equal rows are interchangeable; an empty table gives an empty result.
    Input columns named like the two new ones are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    row = fresh(df, "row_number")
    rows, n = numbered(df, order, row)
    where = fresh(rows, "where")
    out = rows.withColumn(where, _placed(n, shards, seed)(F.col(row)))
    return out.select(*[column(c) for c in df.columns], F.col(where)["shard"].alias("shard"), F.col(where)["slot"].alias("slot"))


def text_order(id: str, crc: str, size: str) -> list[Column]:
    return [column(id).asc_nulls_first(), column(crc).asc_nulls_first(), column(size).asc_nulls_first()]


def shard_documents(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The placement of documents by id, without their texts.

    A null text has no bytes (size 1, crc 0).  ``grown_shard`` is null: under this law one
    more shard moves rows between all shards.
    """
    raw = F.encode(F.coalesce(column(text), F.lit("")), "UTF-8")
    narrow = df.select(
        column(id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    placed = shard_rows(narrow, text_order("doc_id", "text_crc32", "size"), shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
