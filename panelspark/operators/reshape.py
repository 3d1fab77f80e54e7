"""Projection, renaming and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep those of the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def matching_columns(
    df: DataFrame, prefixes: Sequence[str] = ("",), suffix: str = ""
) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes)) and c.endswith(suffix)]


def select_matching(
    df: DataFrame, prefixes: Sequence[str], suffix: str = "", keep: Sequence[str] = ()
) -> DataFrame:
    """Keep the ``keep`` columns and those matched by name prefix and suffix."""
    hits = [c for c in matching_columns(df, prefixes, suffix) if c not in keep]
    return df.select(*keep, *hits)


def month_names(start: str, end: str) -> list[str]:
    """ISO month starts from ``start`` to ``end``, both included."""
    (y, m), (last_y, last_m) = ([int(p) for p in d.split("-")[:2]] for d in (start, end))
    count = (last_y - y) * 12 + last_m - m + 1
    return [f"{y + (m - 1 + k) // 12:04d}-{(m - 1 + k) % 12 + 1:02d}-01" for k in range(count)]


def name_months(df: DataFrame, start: str, end: str, ids: Sequence[str] = ()) -> DataFrame:
    """Name the value columns of a wide matrix by month; the widths must agree."""
    values = [c for c in df.columns if c not in ids]
    names = month_names(start, end)
    if len(names) != len(values):
        raise ValueError(f"{len(values)} month columns, but {start}..{end} has {len(names)} months")
    return df.select(*ids, *[F.col(f"`{c}`").alias(n) for c, n in zip(values, names)])


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    name_col: str,
    value_col: str,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Wide to long; rows with a NULL value stay."""
    cols = list(values) if values is not None else [c for c in df.columns if c not in ids]
    quoted = [F.col(f"`{c}`") for c in cols]
    return df.unpivot([F.col(c) for c in ids], quoted, name_col, value_col)


def to_wide(
    df: DataFrame, keys: Sequence[str], name_col: str, value_col: str, names: Sequence[object]
) -> DataFrame:
    """Long to wide over a stated list of names (no extra job to discover them)."""
    return df.groupBy(*keys).pivot(name_col, list(names)).agg(F.first(value_col, ignorenulls=True))


def explode_offsets(df: DataFrame, offsets: Sequence[int], name: str = "n_lag") -> DataFrame:
    """One copy of each row per offset."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(k) for k in offsets])))


def stack(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a part lacks are NULL, numeric types widen to fit."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _aligned(dfs))


def _aligned(dfs: Sequence[DataFrame]) -> list[DataFrame]:
    seen: dict[str, T.DataType] = {}
    clash: set[str] = set()
    for df in dfs:
        for f in df.schema.fields:
            if seen.setdefault(f.name, f.dataType) != f.dataType:
                clash.add(f.name)
    if not clash:
        return list(dfs)
    kinds = {c: [df.schema[c].dataType for df in dfs if c in df.columns] for c in clash}

    def common(c: str) -> str:
        return "double" if all(isinstance(k, T.NumericType) for k in kinds[c]) else "string"

    return [
        df.withColumns({c: F.col(c).cast(common(c)) for c in clash if c in df.columns})
        for df in dfs
    ]


def with_fallback(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename ``old -> new`` only where ``new`` is missing and ``old`` is there."""
    due = {o: n for o, n in renames.items() if n not in df.columns and o in df.columns}
    return df.withColumnsRenamed(due)


def map_columns(df: DataFrame, fn, types: type = T.NumericType) -> DataFrame:
    """Apply a column expression to every column of a type."""
    hit = [f.name for f in df.schema.fields if isinstance(f.dataType, types)]
    return df.withColumns({c: fn(F.col(c)) for c in hit})


def decode_labels(df: DataFrame, labels: Mapping[str, Mapping[object, str]]) -> DataFrame:
    """Replace codes by labels, one literal table per variable; unlabelled codes become NULL."""

    def lookup(c: str, table: Mapping[object, str]) -> Column:
        pairs = [F.lit(p) for kv in table.items() for p in kv]
        return F.try_element_at(F.create_map(*pairs), F.col(c))

    return df.withColumns({c: lookup(c, t) for c, t in labels.items() if c in df.columns})
