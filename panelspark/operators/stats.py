"""Statistics behind exploratory plots and simple models, as grouped Spark jobs.

Records are first reduced to distinct values with counts (or to moments), which
combines map-side; evaluation grids are exploded against that reduced table only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.graph import components
from panelspark.operators.joins import null_safe_join
from panelspark.session import written


def _value_counts(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Distinct values with counts, written once because every statistic reads them twice."""
    counts = (
        df.where(F.col(x).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    return written(counts, "value_counts")[0]


def nth_values(
    values: DataFrame,
    by: Sequence[str],
    targets: DataFrame,
    bins: int = 1024,
    sort_rows: int = 100_000,
) -> DataFrame:
    """Order statistics of weighted values: ``by, which, x``.

    ``values`` is ``(by, x, w)``, ``targets`` is ``(by, which, target)``; the answer is
    the smallest x whose running weight reaches the target.  A histogram names the
    bin that holds it and only that bin's values are ordered.  A chosen bin with more
    than ``sort_rows`` rows is cut into bins between its own extremes again, so neither
    very many values nor a few far outliers make one task sort a whole group.
    """
    at = [*by, "which"]
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    span = values.groupBy(*by).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))
    found = _chosen_bins(
        null_safe_join(values, span, by, "inner"),
        by,
        lambda cells: null_safe_join(cells, targets.withColumn("__base", F.lit(0)), by, "inner"),
        bins,
    )
    # Rows of the fullest chosen bin; one value alone needs no cutting.
    fullest = F.max(F.when(F.col("__lo") < F.col("__hi"), F.col("__rows")))
    found, seen = written(found, "bins", rows=fullest)
    inside = F.col("x").between(F.col("__lo"), F.col("__hi"))
    while (seen["rows"] or 0) > sort_rows:
        wide = (F.col("__lo") < F.col("__hi")) & (F.col("__rows") > sort_rows)
        again = found.where(wide).select(*at, "target", F.col("__before").alias("__base"), "__lo", "__hi")
        finer = _chosen_bins(
            null_safe_join(values, again, by, "inner").where(inside), at, lambda cells: cells, bins, ["target", "__base"]
        )
        found, seen = written(found.where(~wide).unionByName(finer), "bins", rows=fullest)
    in_bin = W.partitionBy(*at).orderBy("x").rangeBetween(W.unboundedPreceding, 0)
    return (
        null_safe_join(values, found.drop("__rows"), by, "inner")
        .where(inside)
        .withColumn("__sofar", F.col("__before") + F.sum("w").over(in_bin))
        .where(F.col("__sofar") >= F.col("target"))
        .groupBy(*at)
        .agg(F.min("x").alias("x"))
    )


def _chosen_bins(
    values: DataFrame,
    by: Sequence[str],
    with_targets: Callable[[DataFrame], DataFrame],
    bins: int,
    carried: Sequence[str] = (),
) -> DataFrame:
    """The bin that holds each target: its extremes, rows, and the weight before it."""
    share = F.try_divide(F.col("x") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    place = F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * (bins - 1)).cast("int")
    # Infinite values are bins of their own, so the span between the others is finite.
    place = F.when(F.col("x") == float("-inf"), -1).when(F.col("x") == float("inf"), bins).otherwise(place)
    cells = (
        values.groupBy(*by, *carried, place.alias("__bin"))
        .agg(
            F.sum("w").alias("__in"),
            F.count(F.lit(1)).alias("__rows"),
            F.min("x").alias("__lo"),
            F.max("x").alias("__hi"),
        )
        .withColumn("__upto", F.sum("__in").over(W.partitionBy(*by).orderBy("__bin")))
    )
    upto = F.col("__base") + F.col("__upto")
    before = upto - F.col("__in")
    return (
        with_targets(cells)
        .where((upto >= F.col("target")) & (before < F.col("target")))
        .select(
            *[c for c in by if c != "which"],
            "which",
            "target",
            "__lo",
            "__hi",
            "__rows",
            before.alias("__before"),
        )
    )


def quartile_spread(values: DataFrame, by: Sequence[str], totals: DataFrame) -> DataFrame:
    """Interquartile range with linear interpolation between neighbouring values."""
    rank = {"q1": 0.25, "q3": 0.75}
    parts = []
    for q, share in rank.items():
        place = (F.col("n") - 1) * F.lit(share)
        parts += [
            F.struct(F.lit(f"{q}_low").alias("which"), (F.floor(place) + 1).alias("target")),
            F.struct(F.lit(f"{q}_high").alias("which"), (F.ceil(place) + 1).alias("target")),
        ]
    targets = totals.select(*by, F.explode(F.array(*parts)).alias("__t")).select(*by, "__t.*")
    found = nth_values(values, by, targets).groupBy(*by).pivot(
        "which", [f"{q}_{end}" for q in rank for end in ("low", "high")]
    ).agg(F.first("x"))
    joined = null_safe_join(found, totals.select(*by, "n"), by, "inner")

    def at(q: str) -> Column:
        place = (F.col("n") - 1) * F.lit(rank[q])
        low, high = F.col(f"{q}_low"), F.col(f"{q}_high")
        return low + (place - F.floor(place)) * (high - low)

    return joined.select(*by, (at("q3") - at("q1")).alias("iqr"))


def kernel_density(
    df: DataFrame, by: Sequence[str], x: str, lo: float, hi: float, points: int = 80
) -> DataFrame:
    """Gaussian kernel density per group on a fixed grid.

    The bandwidth is the usual rule of thumb, 0.9 * min(sd, IQR / 1.34) * n^(-1/5),
    falling back to sd when the quartiles coincide.
    """
    values = _value_counts(df, by, x)
    n, s1, s2 = F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("x") ** 2)
    totals = values.groupBy(*by).agg(
        n.cast("double").alias("n"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(s2 - s1 * s1 / n, n - 1))).alias("sd"),
    )
    spread = null_safe_join(totals, quartile_spread(values, by, totals), by, "inner")
    robust = F.least(F.col("sd"), F.col("iqr") / 1.34)
    width = F.when(robust > 0, robust).otherwise(F.col("sd"))
    spread = spread.select(*by, "n", (0.9 * width * F.pow("n", F.lit(-0.2))).alias("bw"))
    step = (hi - lo) / (points - 1)

    def kernel_sum(at: int) -> Column:
        z = (F.lit(lo) + F.lit(at) * F.lit(step) - F.col("x")) / F.col("bw")
        return F.sum(F.col("w") * F.exp(-0.5 * z * z))

    # One aggregate per grid point: values are never multiplied by the grid.
    sums = null_safe_join(values, spread, by, "inner").groupBy(*by, "n", "bw").agg(
        F.array(*[kernel_sum(k) for k in range(points)]).alias("sums")
    )
    return sums.select(*by, "n", "bw", F.posexplode("sums").alias("grid", "k")).select(
        *by,
        "grid",
        (F.lit(lo) + F.col("grid") * F.lit(step)).alias("grid_x"),
        F.try_divide("k", F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)).alias("density"),
    )


def histogram(df: DataFrame, by: Sequence[str], x: str, bins: int = 30) -> DataFrame:
    """Counts per group in equal bins over the range of the whole column.

    The first and last bin are centred on the extremes and bins are closed on the
    right, the convention of common plotting tools.  Groups share the bins.
    """
    values = _value_counts(df, by, x)
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if span["lo"] is None:
        lo, width = 0.0, 1.0
    else:
        lo = span["lo"]
        width = (span["hi"] - lo) / (bins - 1) or 1.0
    origin = width / 2 + math.floor((lo - width / 2) / width) * width
    index = F.ceil((F.col("x") - F.lit(origin)) / F.lit(width)).cast("int")
    return (
        values.withColumn("bin", index)
        .groupBy(*by, "bin")
        .agg(F.sum("w").alias("n"))
        .withColumn("centre", F.lit(origin) + (F.col("bin") - 0.5) * F.lit(width))
    )


def linear_trend(
    df: DataFrame, by: Sequence[str], x: str, y: str, more: Sequence[Column] = ()
) -> DataFrame:
    """Least-squares line per group; ``more`` are aggregates of the same pass."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
        *more,
    )


def _by_share(xs: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Values with their bin and the bin's middle and half width; bins hold about equally many distinct values."""
    shares = [k / bins for k in range(1, bins)]
    edges = xs.groupBy(*by).agg(
        F.min("x").alias("__lo"),
        F.max("x").alias("__hi"),
        F.percentile_approx("x", shares, 50 * bins).alias("__cuts"),
    )
    ends = F.array_distinct(F.concat(F.array("__lo"), F.col("__cuts"), F.array("__hi")))
    edges = edges.select(*by, ends.alias("__ends"))
    # The last end closes the last bin.
    place = F.greatest(F.lit(1), F.least(F.size("__ends") - 1, F.size(F.filter("__ends", lambda e: e <= F.col("x")))))
    low = F.element_at("__ends", F.col("bin"))
    high = F.coalesce(F.try_element_at("__ends", F.col("bin") + 1), low)
    return (
        null_safe_join(xs, edges, by, "inner")
        .withColumn("bin", place)
        .select(*by, "bin", "x", "w", "sy", ((low + high) / 2).alias("mid"), ((high - low) / 2).alias("half"))
    )


# Tricube weights times fourth powers have degree 13; with a response only squares are needed.
_POWERS, _RESPONSE_POWERS = 14, 12


def local_regression(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    lo: float,
    hi: float,
    points: int = 80,
    span: float = 0.75,
    bins: int = 128,
) -> DataFrame:
    """Local quadratic regression with tricube weights on a fixed grid.

    At each grid point the window reaches to the nearest ``span`` share of the
    records, a distance found exactly by :func:`nth_values`.

    On either side of a grid point a tricube weight is a polynomial.  Values are summed once
    into power moments of ``bins`` bins per group, each about its own middle, in units of its half
    width, so that nothing cancels.  A bin wholly within one side of a window adds what its
    moments say; only bins that hold a grid point or a window's end are looked into, and only
    bins that can hold the distance take part in finding it.
    """
    xs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(y).cast("double")).alias("sy"))
    )
    xs, _ = written(_by_share(written(xs, "value_sums")[0], by, bins), "binned_values")
    u = F.when(F.col("half") > 0, (F.col("x") - F.col("mid")) / F.col("half")).otherwise(F.lit(0.0))
    moments, _ = written(
        xs.withColumn("u", u)
        .groupBy(*by, "bin", "mid", "half")
        .agg(
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.sum("w").alias("n"),
            F.array(*[F.sum(F.col("w") * F.pow("u", F.lit(p))) for p in range(_POWERS)]).alias("m"),
            F.array(*[F.sum(F.col("sy") * F.pow("u", F.lit(p))) for p in range(_RESPONSE_POWERS)]).alias("my"),
        ),
        "moments",
    )
    at = [*by, "grid"]
    step = (hi - lo) / (points - 1)
    gap_low, gap_high = F.col("low") - F.col("grid_x"), F.col("grid_x") - F.col("high")
    # A row per bin and grid point: as many for any number of records.
    met = (
        moments.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("grid_x", F.lit(lo) + F.col("grid") * F.lit(step))
        .withColumns(
            {
                "nearest": F.greatest(F.lit(0.0), gap_low, gap_high),
                "farthest": F.greatest(F.abs(gap_low), F.abs(gap_high)),
            }
        )
    )
    window = _window_reach(xs, met, by, span)
    t = (F.col("x") - F.col("grid_x")) / F.col("h")
    kernel = F.when(F.abs(t) < 1, F.pow(1 - F.pow(F.abs(t), F.lit(3)), F.lit(3))).otherwise(0.0)
    reached = null_safe_join(met, window, at, "inner").where("h > 0 and nearest < h")
    whole = (F.col("farthest") <= F.col("h")) & ((F.col("low") >= F.col("grid_x")) | (F.col("high") <= F.col("grid_x")))
    cut = null_safe_join(xs, reached.where(~whole).select(*by, "bin", "grid", "grid_x", "h"), [*by, "bin"], "inner")
    sums = [f"s{p}" for p in range(5)] + [f"y{p}" for p in range(3)]
    from_values = cut.withColumns({"k": kernel, "t": t}).select(
        *at,
        *[(F.col("k") * F.col("w") * F.pow("t", F.lit(p))).alias(f"s{p}") for p in range(5)],
        *[(F.col("k") * F.col("sy") * F.pow("t", F.lit(p))).alias(f"y{p}") for p in range(3)],
    )
    from_moments = reached.where(whole).select(*at, *_side_sums())
    total = from_values.unionByName(from_moments).groupBy(*at).agg(*[F.sum(c).alias(c) for c in sums])
    grid = window.select(*at, (F.lit(lo) + F.col("grid") * F.lit(step)).alias("grid_x"))
    s0, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in sums)
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    num = y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)
    fit = F.when(det > 1e-9 * s0 * s0 * s0, num / det)
    return null_safe_join(grid, total, at, "left").select(*by, "grid", "grid_x", fit.alias("fit"))


def _window_reach(xs: DataFrame, met: DataFrame, by: Sequence[str], span: float) -> DataFrame:
    """``by, grid, h``: distance of each grid point to its nearest ``span`` share of the records.

    Bins that lie wholly nearer than any possible reach are counted, bins wholly beyond it left out.
    """
    at = [*by, "grid"]
    group = W.partitionBy(*at)

    def reached(distance: str) -> Column:
        return F.sum("n").over(group.orderBy(distance).rangeBetween(W.unboundedPreceding, 0))

    target = F.floor(F.sum("n").over(group) * F.lit(span) + 1e-5)
    known = met.select(*at, "grid_x", "bin", "n", "nearest", "farthest").withColumns(
        {"target": target, "at_least": reached("nearest"), "at_most": reached("farthest")}
    )
    known = known.withColumns(
        {
            "least": F.min(F.when(F.col("at_least") >= F.col("target"), F.col("nearest"))).over(group),
            "most": F.min(F.when(F.col("at_most") >= F.col("target"), F.col("farthest"))).over(group),
        }
    )
    base = F.coalesce(F.sum(F.when(F.col("farthest") < F.col("least"), F.col("n"))).over(group), F.lit(0))
    known = known.withColumn("target", F.col("target") - base)
    able = known.where((F.col("nearest") <= F.col("most")) & (F.col("farthest") >= F.col("least")))
    able, _ = written(able.select(*at, "bin", "grid_x", "target"), "window_bins")
    distances = null_safe_join(xs, able, [*by, "bin"], "inner").select(
        *at, F.abs(F.col("x") - F.col("grid_x")).alias("x"), "w"
    )
    targets = able.select(*at, F.lit("h").alias("which"), "target").distinct()
    return nth_values(distances, at, targets).select(*at, F.col("x").alias("h"))


def _side_sums() -> list[Column]:
    """Weighted sums of a bin on one side of a grid point, from its moments.

    With t = a + b u the powers of t are binomial sums of the moments; the weight is
    1 - 3 s t^3 + 3 t^6 - s t^9 with s the side.
    """
    a = (F.col("mid") - F.col("grid_x")) / F.col("h")
    b = F.col("half") / F.col("h")
    side = F.when(F.col("low") >= F.col("grid_x"), 1.0).otherwise(-1.0)

    def power(moments: str, q: int) -> Column:
        terms = [
            F.lit(float(math.comb(q, k))) * F.pow(a, F.lit(q - k)) * F.pow(b, F.lit(k)) * F.element_at(moments, k + 1)
            for k in range(q + 1)
        ]
        return reduce(lambda u, v: u + v, terms)

    def weighted(moments: str, p: int) -> Column:
        return power(moments, p) - 3 * side * power(moments, p + 3) + 3 * power(moments, p + 6) - side * power(moments, p + 9)

    return [weighted("m", p).alias(f"s{p}") for p in range(5)] + [weighted("my", p).alias(f"y{p}") for p in range(3)]


def one_factor_ols(df: DataFrame, y: str, factor: str, by: Sequence[str] = ()) -> DataFrame:
    """``y ~ factor`` per group, from level means and the pooled variance.

    The first level is the base: its row is the intercept, the others are
    differences from it.
    """
    levels = (
        df.where(F.col(y).isNotNull() & F.col(factor).isNotNull())
        .groupBy(*by, factor)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(y).alias("s"),
            F.sum(F.col(y) * F.col(y)).alias("ss"),
        )
    )
    # One row per level: the windows are as small as the number of factor levels.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    first = group.orderBy(factor).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mean = F.col("s") / F.col("n")
    fitted = levels.withColumns(
        {
            "mean": mean,
            "base_n": F.first("n").over(first),
            "base_mean": F.first(mean).over(first),
            "is_base": F.col(factor) == F.first(factor).over(first),
            "rss": F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).over(group),
            "df": F.sum("n").over(group) - F.count(F.lit(1)).over(group),
        }
    )
    sigma = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), "rss"), "df"))
    inverse = F.when(F.col("is_base"), 1 / F.col("n")).otherwise(
        1 / F.col("n") + 1 / F.col("base_n")
    )
    return fitted.withColumns(
        {
            "estimate": F.when(F.col("is_base"), F.col("mean")).otherwise(
                F.col("mean") - F.col("base_mean")
            ),
            "std_error": sigma * F.sqrt(inverse),
        }
    ).select(
        *by,
        F.col(factor).cast("string").alias("level"),
        "is_base",
        "n",
        "estimate",
        "std_error",
        F.try_divide("estimate", "std_error").alias("t_value"),
        "df",
    )


def student_two_sided(t: float, dof: int) -> float:
    """P(|T| > |t|) for a whole number of degrees of freedom, from the finite series in cos^2."""
    if math.isnan(t) or dof < 1:
        return float("nan")
    theta = math.atan(abs(t) / math.sqrt(dof))
    sine, cos2 = math.sin(theta), math.cos(theta) ** 2
    odd = dof % 2
    term = math.cos(theta) if odd else 1.0
    total = term if dof > 1 else 0.0
    for k in range(3 if odd else 2, dof - 1, 2):
        term *= cos2 * (k - 1) / k
        total += term
        if term < total * 1e-18:
            break
    inside = 2 / math.pi * (theta + sine * total) if odd else sine * total
    return max(0.0, 1.0 - inside)


TERMS = "term string, estimate double, std_error double, t_value double, p_value double"
# Up to so many levels of the shorter factor its equations are solved at once (8 MB of doubles).
DENSE_LEVELS = 1024
CG_ROUNDS = 500
CG_TOLERANCE = 1e-12


def two_factor_ols(
    df: DataFrame,
    y: str,
    factors: Sequence[str],
    dense_levels: int = DENSE_LEVELS,
    terms: Sequence[str] | None = None,
) -> DataFrame:
    """``y ~ factor + factor``: ``term, estimate, std_error, t_value, p_value``, any number of levels.

    Records collapse to one row per factor combination; within-cell variation enters the residual
    variance.  The longer factor is eliminated from the normal equations, its levels being
    independent of one another; what is left has the shorter factor's levels only.  Up to
    ``dense_levels`` of them are solved at once; beyond that conjugate gradients run over level
    tables, for the estimates and each wanted term's error side by side.  ``terms`` names the
    terms that are wanted (all by default).

    The alphabetically first level of each factor is the base.  Without rows the result is
    empty.  A factor of one level has no terms of its own.  A saturated model has null errors.
    Where no cell connects two sets of levels, a term that compares them is null.
    """
    first, second = factors
    cells = (
        df.where(F.col(y).isNotNull())
        .dropna(subset=[first, second])
        .groupBy(F.col(first).cast("string").alias("f0"), F.col(second).cast("string").alias("f1"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg(y).alias("y"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    )
    cells, _ = written(cells, "factor_cells")
    shape = cells.agg(
        F.countDistinct("f0").alias("n0"), F.countDistinct("f1").alias("n1"), F.min("f0").alias("b0"), F.min("f1").alias("b1"),
        F.sum("w").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("w") * F.col("y")).alias("sy"),
    ).first()
    if not shape["cells"]:
        return df.sparkSession.createDataFrame([], TERMS)
    short = 1 if shape["n1"] <= shape["n0"] else 0
    longer, shorter = factors[1 - short], factors[short]
    base_i, base_j = shape[f"b{1 - short}"], shape[f"b{short}"]
    # Centring the response costs the intercept nothing and keeps squares small.
    centre = shape["sy"] / shape["n"]
    cells, _ = written(
        cells.select(
            F.col(f"f{1 - short}").alias("i"), F.col(f"f{short}").alias("j"), "w", (F.col("y") - centre).alias("y"),
            (F.col("ss") - F.col("w") * F.col("y") * F.col("y")).alias("within"),
        ),
        "model_cells",
    )
    sums = cells.groupBy("i").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    cells, _ = written(cells.join(sums, "i").withColumn("v", F.col("w") / F.col("d")), "shared_cells")
    parts = components(cells.select(F.xxhash64(F.lit("i"), "i").alias("a"), F.xxhash64(F.lit("j"), "j").alias("b")), shape["cells"])
    parts, _ = written(parts, "model_parts")
    sides = parts.groupBy().agg(
        F.countDistinct("root").alias("parts"),
        F.max(F.when(F.col("node") == F.xxhash64(F.lit("i"), F.lit(base_i)), F.col("root"))).alias("i"),
        F.max(F.when(F.col("node") == F.xxhash64(F.lit("j"), F.lit(base_j)), F.col("root"))).alias("j"),
    ).first()

    # Terms as right-hand sides: contrasts of the shorter factor's levels, plus what the longer one adds.
    levels_i = cells.groupBy("i").agg(F.first("d").alias("d"))
    base_d = levels_i.where(F.col("i") == base_i).first()["d"]
    base_row = cells.where(F.col("i") == base_i).select("j", "v")

    def within(side: str, root) -> Column:
        return F.xxhash64(F.lit(side), side).alias("node"), F.lit(root).alias("wanted")

    term_i = levels_i.where(F.col("i") != base_i).select(
        F.concat(F.lit(f"{longer}_"), "i").alias("term"), "i", (1 / F.col("d") + 1 / F.lit(base_d)).alias("own"), *within("i", sides["i"])
    )
    term_j = cells.select("j").distinct().where(F.col("j") != base_j).select(
        F.concat(F.lit(f"{shorter}_"), "j").alias("term"), "j", F.lit(0.0).alias("own"), *within("j", sides["j"])
    )
    wanted = F.lit(True) if terms is None else F.col("term").isin(list(terms))
    term_i, term_j = term_i.where(wanted), term_j.where(wanted)
    intercept = cells.limit(1).select(
        F.lit("(Intercept)").alias("term"), F.lit(1 / base_d).alias("own"), F.lit(sides["i"]).alias("node"), F.lit(sides["j"]).alias("wanted")
    ).where(wanted)
    contrasts = (
        term_i.join(cells.select("i", "j", "v"), "i").select("term", "j", F.col("v").alias("b"))
        .union(term_i.select("term").crossJoin(F.broadcast(base_row)).select("term", "j", -F.col("v")))
        .union(term_j.select("term", "j", F.lit(1.0)))
        .union(term_j.select("term", F.lit(base_j), F.lit(-1.0)))
        .union(intercept.select("term").crossJoin(F.broadcast(base_row)))
        .union(intercept.select("term", F.lit(base_j), F.lit(-1.0)))
        .groupBy("term", "j").agg(F.sum("b").alias("b"))
    )
    response = cells.groupBy("j").agg(F.sum(F.col("w") * (F.col("y") - F.col("wy") / F.col("d"))).alias("b"))
    solve = _dense if min(shape["n0"], shape["n1"]) <= dense_levels else _conjugate
    effects, spread = solve(cells, response, contrasts)
    effects, _ = written(effects, "short_effects")

    long_effects = cells.join(effects, "j").groupBy("i").agg(F.sum(F.col("v") * (F.col("y") - F.col("x"))).alias("a"))
    long_effects, _ = written(long_effects, "long_effects")
    residual = F.col("y") - F.col("a") - F.col("x")
    rss = cells.join(effects, "j").join(long_effects, "i").agg(F.sum(F.col("within") + F.col("w") * residual * residual)).first()[0]
    p = shape["n0"] + shape["n1"] - sides["parts"]
    dof = int(shape["n"]) - p
    at_i = long_effects.where(F.col("i") == base_i).first()["a"]
    at_j = effects.where(F.col("j") == base_j).first()["x"]
    estimates = (
        term_i.join(long_effects, "i").select("term", "own", "node", "wanted", (F.col("a") - at_i).alias("estimate"))
        .union(term_j.join(effects, "j").select("term", "own", "node", "wanted", F.col("x") - at_j))
        .union(intercept.select("term", "own", "node", "wanted", F.lit(at_i + at_j + centre)))
    )
    roots = parts.select("node", "root").union(parts.select("root", "root").distinct()).distinct()
    known = F.col("root") == F.col("wanted")
    sigma = math.sqrt(max(rss, 0.0) / dof) if dof > 0 else None
    error = F.lit(sigma) * F.sqrt(F.greatest(F.lit(0.0), F.col("own") + F.coalesce("spread", F.lit(0.0))))
    tail = F.pandas_udf(lambda t: t.map(lambda v: student_two_sided(v, dof)).where(t.notna()), "double")
    out = estimates.join(roots, "node", "left").join(spread, "term", "left").select(
        "term", F.when(known, F.col("estimate")).alias("estimate"), F.when(known, error).alias("std_error")
    ).withColumn("t_value", F.try_divide("estimate", "std_error"))
    return out.withColumn("p_value", tail("t_value"))


def _dense(cells: DataFrame, response: DataFrame, contrasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects of the shorter factor, and for each contrast its quadratic form, by one pseudo-inverse.

    The matrix has a row per level of the shorter factor, at most DENSE_LEVELS.  Contrasts are
    worked on where they are.
    """
    import numpy as np
    import pandas as pd

    spark = cells.sparkSession
    names = [r["j"] for r in cells.select("j").distinct().orderBy("j").collect()]
    place = {j: k for k, j in enumerate(names)}
    other = cells.select("i", F.col("j").alias("k"), F.col("w").alias("wk"))
    pairs = cells.join(other, "i").groupBy("j", "k").agg(F.sum(F.col("v") * F.col("wk")).alias("s")).toPandas()
    totals = cells.groupBy("j").agg(F.sum("w").alias("w")).toPandas()
    matrix = np.zeros((len(names), len(names)))
    matrix[pairs["j"].map(place), pairs["k"].map(place)] = -pairs["s"]
    matrix[totals["j"].map(place), totals["j"].map(place)] += totals["w"]
    right = np.zeros(len(names))
    given = response.toPandas()
    right[given["j"].map(place)] = given["b"]
    inverse = np.linalg.pinv((matrix + matrix.T) / 2, rcond=1e-11, hermitian=True)
    effects = spark.createDataFrame([(j, float(x)) for j, x in zip(names, inverse @ right)], "j string, x double")
    shared = spark.sparkContext.broadcast((place, inverse))

    def quadratic(frames):
        at, inv = shared.value
        for frame in frames:
            out = []
            for term, js, bs in zip(frame["term"], frame["js"], frame["bs"]):
                k = [at[j] for j in js]
                b = np.asarray(bs, dtype=float)
                out.append((term, float(b @ inv[np.ix_(k, k)] @ b)))
            yield pd.DataFrame(out, columns=["term", "spread"])

    rows = contrasts.groupBy("term").agg(F.collect_list(F.struct("j", "b")).alias("c"))
    rows = rows.select("term", F.col("c.j").alias("js"), F.col("c.b").alias("bs"))
    return effects, rows.mapInPandas(quadratic, "term string, spread double")


def _conjugate(cells: DataFrame, response: DataFrame, contrasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by conjugate gradients over level tables, all right-hand sides in step.

    A round passes the direction to the longer factor's levels and back: two joins with the
    cells.  Right-hand sides that have settled drop out; each round is a written table.
    """
    diagonal = cells.groupBy("j").agg(F.sum("w").alias("wj"), F.sum(F.col("w") * (1 - F.col("v"))).alias("dj"))
    diagonal, _ = written(diagonal.withColumn("dj", F.when(F.col("dj") > 1e-12 * F.col("wj"), F.col("dj")).otherwise(F.col("wj"))), "diagonal")
    sides = response.select(F.lit("").alias("term"), "j", "b").union(contrasts.select("term", "j", "b"))
    sides, _ = written(sides, "right_sides")
    zeta = F.col("r") / F.col("dj")
    state = sides.select("term", "j", F.lit(0.0).alias("x"), F.col("b").alias("r")).join(diagonal, "j")
    state = state.select("term", "j", "x", "r", zeta.alias("p"), "wj", "dj")
    rz = state.groupBy("term").agg(F.sum(F.col("r") * zeta).alias("rz"))
    state, _ = written(state.join(rz, "term").withColumn("rz0", F.col("rz")), "gradient")
    settled = []
    for _ in range(CG_ROUNDS):
        along = cells.join(state.select("term", "j", "p"), "j").groupBy("term", "i").agg(F.sum(F.col("v") * F.col("p")).alias("u"))
        back = cells.join(along, "i").groupBy("term", "j").agg(F.sum(F.col("w") * F.col("u")).alias("q"))
        # A direction spreads to levels it has not met yet.
        both = state.join(back, ["term", "j"], "full").join(diagonal.select("j", F.col("wj").alias("w1"), F.col("dj").alias("d1")), "j")
        zero = F.lit(0.0)
        both = both.select(
            "term", "j", *[F.coalesce(c, zero).alias(c) for c in ("x", "r", "p")], F.col("w1").alias("wj"), F.col("d1").alias("dj"),
            (F.col("w1") * F.coalesce("p", zero) - F.coalesce("q", zero)).alias("sp"), "rz", "rz0",
        )
        both, _ = written(both, "direction")
        scale = both.groupBy("term").agg(F.sum(F.col("p") * F.col("sp")).alias("psp"), F.max("rz").alias("rz"), F.max("rz0").alias("rz0"))
        scale = scale.withColumn("alpha", F.coalesce(F.try_divide("rz", "psp"), zero))
        moved = both.drop("rz", "rz0").join(scale, "term").withColumns(
            {"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("sp")}
        )
        fresh = moved.groupBy("term").agg(F.sum(F.col("r") * zeta).alias("rz1"))
        moved = moved.join(fresh, "term").withColumn("open", F.col("rz1") > CG_TOLERANCE**2 * F.col("rz0"))
        moved = moved.select(
            "term", "j", "x", "r", (zeta + F.coalesce(F.try_divide("rz1", "rz"), zero) * F.col("p")).alias("p"), "wj", "dj",
            F.col("rz1").alias("rz"), "rz0", "open",
        )
        moved, seen = written(moved, "gradient", open=F.count_if("open"))
        settled.append(moved.where("not open").select("term", "j", "x"))
        state = moved.where("open").drop("open")
        if not seen["open"]:
            break
    else:
        raise ValueError(f"the two factors are too weakly linked: not settled after {CG_ROUNDS} rounds")
    solved, _ = written(reduce(DataFrame.unionByName, settled), "solved")
    effects = response.select("j").join(solved.where("term = ''").select("j", "x"), "j", "left").fillna(0.0)
    spread = contrasts.join(solved, ["term", "j"]).groupBy("term").agg(F.sum(F.col("b") * F.col("x")).alias("spread"))
    return effects, spread


def mixed_moments(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Cross products per group: what a mixed-model fitter needs from the records."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(cx).alias("sum_x"),
            F.sum(cy).alias("sum_y"),
            F.sum(cx * cx).alias("sum_xx"),
            F.sum(cy * cy).alias("sum_yy"),
            F.sum(cx * cy).alias("sum_xy"),
        )
    )
