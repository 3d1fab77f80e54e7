"""Joins: checked broadcast, hot-key splitting, NULL-matching keys, name reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import written

# A side up to this many rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
# Rows of one key and source that are gathered into one row.
DUPLICATES = 1000
KEEPS_BIG = ("inner", "left", "left_semi", "left_anti")


def sized(df: DataFrame, name: str = "lookup") -> tuple[DataFrame, int]:
    """A side written to the shared folder and counted in the same pass.

    The join then reads the written rows, so measuring a derived side costs no
    second computation of it.
    """
    table, seen = written(df, name, rows=F.count(F.lit(1)))
    return table, seen["rows"]


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input: the join moves both sides and sorts them, whatever size Spark guesses.

    Spark takes a table's compressed files for its size and does not count the copies that an
    ``explode`` makes, so left to itself it gathers in the driver, for a broadcast, what is many
    times larger than its bound.
    """
    return df.hint("merge")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a table against a dimension without shuffling the table.

    The dimension is broadcast only when its counted size is below the bound.
    Larger ones take a shuffle join with hot keys of the big side split.  At either size
    unmatched rows of ``small`` cannot be kept.
    """
    if how not in KEEPS_BIG:
        raise ValueError(f"lookup_join cannot keep unmatched rows of the lookup for how={how!r}")
    table, rows = sized(small)
    if rows <= max_rows:
        return big.join(F.broadcast(table), list(on), how)
    return split_join(big, table, on, how)


def split_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Equi join that spreads each hot key of ``big`` over several tasks.

    A key with n rows gets ceil(n / rows_per_task) salts.  Rows of ``big`` draw a
    salt from their place in a written table, which a repeated task finds unchanged
    and which tells equal rows apart; rows of ``other`` are copied once per salt, so
    every pair still meets exactly once.  The list of hot keys holds the
    ``BROADCAST_ROWS`` largest at most; a key beyond it has a smaller share of the
    rows than one in ``BROADCAST_ROWS``.  ``how`` may keep unmatched rows of ``big``
    (left, semi, anti), not of ``other``.
    """
    if how not in KEEPS_BIG:
        raise ValueError(f"split_join cannot keep unmatched rows for how={how!r}")
    keys = list(on)
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows_per_task)
        .orderBy(F.desc("__n"), *keys)
        .limit(BROADCAST_ROWS)
        .select(*keys, F.ceil(F.col("__n") / rows_per_task).cast("int").alias("__salts"))
    )
    hot, found = sized(hot, "hot_keys")
    if not found:
        return big.join(shuffled(other), keys, how)
    # A NULL key meets nothing, so its rows may scatter freely.
    lost = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salts = F.coalesce("__salts", F.when(lost, F.lit(1009)), F.lit(1))
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__place")
    left = (
        written(big, "split")[0]
        .select("*", place)
        .join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.pmod(F.col("__place"), salts).cast("int"))
        .drop("__salts", "__place")
    )
    right = (
        other.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
        .drop("__salts")
    )
    return left.join(shuffled(right), [*keys, "__salt"], how).drop("__salt")


def full_join(dfs: Sequence[DataFrame], keys: Sequence[str], many: int = DUPLICATES) -> DataFrame:
    """Full outer join of several panels on shared keys, in one shuffle.

    All sources are stacked, each under a column of its own, and gathered by key once; a key that
    occurs several times gives every combination, as a chain of joins would.  Keys are never
    matched when one of them is NULL.  Keys with more than ``many`` rows in a source
    do not fit one row: they are joined source by source, the hot ones split.
    """
    keys = list(keys)
    rest = [[c for c in df.columns if c not in keys] for df in dfs]
    taken = [c for cols in rest for c in cols]
    if len(set(taken)) < len(taken):
        raise ValueError("panels share columns besides the keys")
    # The first panel's types hold for the keys, as far as they can take the others.
    parts = [
        df.select(*keys, F.lit(n).alias("__n"), F.struct(F.lit(True).alias("__is"), *cols).alias(f"__p{n}"))
        for n, (df, cols) in enumerate(zip(dfs, rest))
    ]
    stacked, _ = written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "panels")
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fields = [F.col(f"__p{n}.{_quoted(c)}").alias(c) for n, cols in enumerate(rest) for c in cols]
    hot, found = written(
        stacked.where(full).groupBy(*keys, "__n").count().where(F.col("count") > many).select(*keys).distinct(),
        "many",
        rows=F.count(F.lit(1)),
    )
    usual = stacked.where(full)
    if found["rows"]:
        usual = split_join(usual, hot, keys, "left_anti")
    gathered = usual.groupBy(*keys).agg(*[F.collect_list(f"__p{n}").alias(f"__p{n}") for n in range(len(dfs))])
    for n in range(len(dfs)):
        gathered = gathered.withColumn(f"__p{n}", F.explode_outer(f"__p{n}"))
    out = [gathered.select(*keys, *fields), stacked.where(~full).select(*keys, *fields)]
    if found["rows"]:
        crowded, _ = written(split_join(stacked.where(full), hot, keys, "left_semi"), "crowded")
        sides = []
        for n in range(len(dfs)):
            mine = crowded.where(F.col("__n") == n).select(*keys, f"__p{n}")
            # Sources without the key stand in with an empty row, so that every join finds one.
            sides.append(mine.unionByName(hot.join(mine.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True))
        out.append(reduce(lambda a, b: split_join(a, b, keys), sides).select(*keys, *fields))
    return reduce(DataFrame.unionByName, out)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def natural_full_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on every column the two sides share."""
    return a.join(b, sorted(set(a.columns) & set(b.columns)), "full")


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which a NULL key matches a NULL key; without keys ``b`` is a single row of totals."""
    if not keys:
        return a.join(F.broadcast(b), how="cross")
    renamed = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = a.join(renamed, cond, how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(a[k], F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def rename_units(df: DataFrame, column: str, names: Mapping[str, str] | DataFrame) -> DataFrame:
    """Many-to-one recode of unit names; names without an entry stay.

    A literal mapping becomes a map lookup inside the projection; a table
    ``(old_name, new_name)`` is joined.
    """
    if isinstance(names, DataFrame):
        table = names.select(F.col("old_name").alias(column), F.col("new_name").alias("__new"))
        return (
            lookup_join(df, table, [column])
            .withColumn(column, F.coalesce("__new", F.col(column)))
            .drop("__new")
        )
    pairs = F.create_map(*[F.lit(p) for kv in names.items() for p in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def name_mismatch(
    a: DataFrame, b: DataFrame, keys: Sequence[str], sides: tuple[str, str] = ("left", "right")
) -> DataFrame:
    """Keys found on one side only, tagged with the side.

    Both sides shrink to distinct keys first (map-side), so a name that occurs in
    most rows costs no more than a rare one, and each side is read once.
    """
    da = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    db = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), sides[0]).when(F.col("__a").isNull(), sides[1])
    return (
        da.join(db, list(keys), "full")
        .withColumn("side", side)
        .where(F.col("side").isNotNull())
        .drop("__a", "__b")
    )
