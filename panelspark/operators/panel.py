"""Unit-by-time panels.

A panel holds one row per unit and time step.  ``one_row_per_step`` and
``month_skeleton`` make that true before any lag is taken, so the windows below
see at most one row per calendar step of a unit, whatever the raw data looked
like, and a row lag equals a time lag.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.dates import month_steps

# Lags in months that the panels carry.
BASE_OFFSETS = (*range(0, 15), 24, 36, 48, 60)
SEASON_OFFSETS = (*range(0, 13), 24, 36, 48, 60)
YEARLY_OFFSETS = (12, 24, 36, 48, 60)


def ordered(keys: Sequence[str], time: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(time)


def one_row_per_step(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    skeleton: DataFrame | None = None,
) -> DataFrame:
    """Mean per unit and step, for sources that map several regions to one unit.

    With a skeleton its unit-steps are there too, NULL where nothing is known: the
    skeleton's rows go into the same aggregation instead of a join after it.
    """
    if skeleton is not None:
        df = df.unionByName(skeleton.select(*keys, time), allowMissingColumns=True)
    return df.groupBy(*keys, time).agg(*[F.avg(v).alias(v) for v in values])


def month_skeleton(
    units: DataFrame, keys: Sequence[str], start: str, end: str, time: str = "ymd"
) -> DataFrame:
    """Every unit with every month of a span."""
    return units.select(*keys).distinct().withColumn(time, F.explode(month_steps(start, end)))


def year_skeleton(
    units: DataFrame, keys: Sequence[str], first: int, last: int, time: str = "year"
) -> DataFrame:
    return (
        units.select(*keys)
        .distinct()
        .withColumn(time, F.explode(F.sequence(F.lit(first), F.lit(last))))
    )


def on_skeleton(
    panel: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    time: str = "ymd",
    units: DataFrame | None = None,
) -> DataFrame:
    """Fill month gaps with NULL rows; months outside the span stay as well.

    A unit list spares a second look at the panel for its distinct units.
    """
    blank = month_skeleton(panel if units is None else units, keys, start, end, time)
    return blank.join(panel, [*keys, time], "full")


def zero_filled(
    counts: DataFrame, skeleton: DataFrame, keys: Sequence[str], name: str
) -> DataFrame:
    """Sum per key with zero where a skeleton key has nothing, in one aggregation."""
    nothing = skeleton.select(*keys, F.lit(0).cast("long").alias(name))
    both = counts.select(*keys, F.col(name).cast("long")).unionByName(nothing)
    return both.groupBy(*keys).agg(F.sum(name).alias(name))


def lag_name(var: str, k: int) -> str:
    return var if k == 0 else f"lag_{var}_{k}"


def _listed(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def _every(cols: Sequence[str]) -> str:
    return " AND ".join(f"`{c}` IS NOT NULL" for c in cols)


# Generated families are SQL text: one parsed expression per column is far cheaper to
# build than the same tree put together call by call.


def lags(var: str, offsets: Sequence[int], keys: Sequence[str], time: str) -> dict[str, Column]:
    """One column per offset; all of them run in a single window pass."""
    window = f"(PARTITION BY {_listed(keys)} ORDER BY `{time}`)"
    return {lag_name(var, k): F.expr(f"lag(`{var}`, {k}) OVER {window}") for k in offsets if k > 0}


def lag_panel(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    variables: Sequence[str],
    offsets: Sequence[int] = BASE_OFFSETS,
) -> DataFrame:
    cols: dict[str, Column] = {}
    for v in variables:
        cols |= lags(v, offsets, keys, time)
    return df.withColumns(cols)


def anomalies(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Same-month mean of the five years before, and the deviation from it."""
    cols: dict[str, Column] = {}
    for v in variables:
        total = " + ".join(f"`{lag_name(v, k)}`" for k in YEARLY_OFFSETS)
        cols[f"{v}_5avg"] = F.expr(f"({total}) / {len(YEARLY_OFFSETS)}")
        cols[f"{v}_dev5"] = F.expr(f"`{v}` - ({total}) / {len(YEARLY_OFFSETS)}")
    return df.withColumns(cols)


def three_month_means(
    df: DataFrame, variables: Sequence[str], starts: Sequence[int] = tuple(range(1, 13))
) -> DataFrame:
    """Mean of the lags k, k+1, k+2; NULL when one of the three is."""

    def mean3(v: str, k: int) -> Column:
        return F.expr("(" + " + ".join(f"`{lag_name(v, k + j)}`" for j in range(3)) + ") / 3")

    return df.withColumns({f"{v}_mean3_{k}": mean3(v, k) for v in variables for k in starts})


def season_peaks(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Best three-month mean of the last year: 12-month and 14-month reach."""
    spans = {"12": range(1, 11), "14": range(1, 13)}

    def best(cols: list[str]) -> Column:
        return F.expr(f"CASE WHEN {_every(cols)} THEN greatest({_listed(cols)}) END")

    return df.withColumns(
        {
            f"{v}_peak3_{reach}": best([f"{v}_mean3_{k}" for k in ks])
            for v in variables
            for reach, ks in spans.items()
        }
    )


def time_from_peak(df: DataFrame, variables: Sequence[str], reach: int = 14) -> DataFrame:
    """Highest of the trailing months, and how many months ago; the latest month wins ties."""
    recent = {v: [lag_name(v, k) for k in range(1, reach + 1)] for v in variables}
    peaks = df.withColumns(
        {
            f"peak_{v}": F.expr(f"CASE WHEN {_every(c)} THEN greatest({_listed(c)}) END")
            for v, c in recent.items()
        }
    )
    return peaks.withColumns(
        {
            f"tfp_{v}": F.expr(
                f"CASE WHEN `peak_{v}` IS NOT NULL "
                f"THEN cast(array_position(array({_listed(c)}), `peak_{v}`) AS int) END"
            )
            for v, c in recent.items()
        }
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]
) -> DataFrame:
    """Last known value downwards in time."""
    so_far = ordered(keys, time).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def extend_last_year(
    df: DataFrame, last: int, years: Sequence[int], time: str = "year"
) -> DataFrame:
    """Repeat the last year's rows for later years."""
    kind = df.schema[time].dataType
    more = df.where(F.col(time) == last).withColumn(
        time, F.explode(F.array(*[F.lit(y).cast(kind) for y in years]))
    )
    return df.unionByName(more)


def shift_years(df: DataFrame, by: int = 1, time: str = "year") -> DataFrame:
    """Lag a whole panel by moving its key."""
    return df.withColumn(time, (F.col(time) + by).cast(df.schema[time].dataType))


def yearly_lags(
    df: DataFrame, keys: Sequence[str], variables: Mapping[str, str], offsets=(1, 2), time="year"
) -> DataFrame:
    """Lags named ``<stem>_lag<k>`` for ``variables`` given as column -> stem."""
    window = ordered(keys, time)
    return df.withColumns(
        {
            f"{stem}_lag{k}": F.lag(v, k).over(window)
            for v, stem in variables.items()
            for k in offsets
        }
    )
