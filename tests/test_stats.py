"""Statistics against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import stats as T


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 900
    return {
        "g": rng.choice(["a", "b"], n),
        "year": rng.choice([2003, 2008, 2013], n, p=[0.6, 0.3, 0.1]),
        "unit": rng.choice(["u1", "u2", "u3", "u4"], n),
        "x": np.round(rng.gamma(3, 8, n), 1),
        "y": rng.normal(-1, 1.3, n),
    }


@pytest.fixture(scope="module")
def frame(spark, sample):
    rows = list(zip(*[v.tolist() for v in sample.values()]))
    return spark.createDataFrame(rows, "g string, year int, unit string, x double, y double")


def test_nth_values(spark, sample, frame):
    values = frame.groupBy("g", "x").agg(F.count(F.lit(1)).alias("w"))
    ks = [1, 2, 77, 250]
    targets = values.select("g").distinct().select("g", F.explode(F.array(*[F.lit(k) for k in ks])).alias("target")).withColumn("which", F.col("target").cast("string"))
    got = {(r["g"], int(r["which"])): r["x"] for r in T.nth_values(values, ["g"], targets, bins=16).collect()}
    for g in "ab":
        xs = np.sort(sample["x"][sample["g"] == g])
        assert [got[g, k] for k in ks] == [xs[k - 1] for k in ks]


def test_kernel_density(sample, frame):
    got = {(r["g"], r["grid"]): r["density"] for r in T.kernel_density(frame, ["g"], "x", 0.0, 80.0, 21).collect()}
    for g in "ab":
        xs = sample["x"][sample["g"] == g]
        q1, q3 = np.percentile(xs, [25, 75])
        bw = 0.9 * min(xs.std(ddof=1), (q3 - q1) / 1.34) * len(xs) ** -0.2
        for k in range(21):
            z = (k * 4.0 - xs) / bw
            assert got[g, k] == pytest.approx(np.exp(-0.5 * z * z).sum() / (len(xs) * bw * math.sqrt(2 * math.pi)), rel=1e-9)


def test_local_regression(sample, frame):
    got = {(r["g"], r["grid"]): r["fit"] for r in T.local_regression(frame, ["g"], "x", "y", 5.0, 45.0, 9).collect()}
    for g in "ab":
        keep = sample["g"] == g
        xs, ys = sample["x"][keep], sample["y"][keep]
        for k in range(9):
            at = 5.0 + k * 5.0
            h = np.sort(np.abs(xs - at))[int(len(xs) * 0.75 + 1e-5) - 1]
            w = np.clip(1 - np.abs((xs - at) / h) ** 3, 0, None) ** 3
            t = (xs - at) / h
            design = np.stack([np.ones_like(t), t, t * t], 1) * np.sqrt(w)[:, None]
            fit = np.linalg.lstsq(design, ys * np.sqrt(w), rcond=None)[0][0]
            assert got[g, k] == pytest.approx(fit, rel=1e-7)


@pytest.mark.parametrize("bins", [1, 4, 64])
def test_local_regression_by_moments(spark, bins):
    """Few and many bins, ties, a far value, one group of a single value: the same as weighting every record."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.gamma(2.0, 8.0, 240), 1), [400.0]])
    y = np.sin(x / 7) + rng.normal(0, 0.2, len(x))
    rows = [("g", float(a), float(b)) for a, b in zip(x, y)] + [("one", 3.0, 1.0)] * 4
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r["g"], r["grid"]): r["fit"] for r in T.local_regression(df, ["g"], "x", "y", 2.0, 60.0, 12, bins=bins).collect()}
    assert len(got) == 24 and all(got["one", k] is None for k in range(12))
    for k in range(12):
        at = 2.0 + k * 58.0 / 11
        d = np.abs(x - at)
        h = np.sort(d)[int(len(x) * 0.75 + 1e-5) - 1]
        t = (x - at) / h
        w = np.where(np.abs(t) < 1, (1 - np.abs(t) ** 3) ** 3, 0.0)
        design = np.stack([np.ones(len(x)), t, t * t], 1)
        beta = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y))
        assert got["g", k] == pytest.approx(beta[0], rel=1e-8, abs=1e-9)


def test_infinite_values_are_ordered_like_others(spark, monkeypatch):
    xs = [float("-inf"), *(k / 3 for k in range(500)), float("inf"), float("inf")]
    values = spark.createDataFrame([("g", x, 1) for x in xs], "g string, x double, w long")
    targets = spark.createDataFrame([("g", str(t), t) for t in (1, 2, 251, 501, 502)], "g string, which string, target long")
    got = {int(r["which"]): r["x"] for r in T.nth_values(values, ["g"], targets, bins=8, sort_rows=10).collect()}
    assert got == {t: xs[t - 1] for t in (1, 2, 251, 501)} | {502: float("inf")}


def test_histogram_covers_all(sample, frame):
    rows = T.histogram(frame, ["g"], "x").collect()
    assert sum(r["n"] for r in rows) == len(sample["x"])
    width = (sample["x"].max() - sample["x"].min()) / 29
    for r in rows:
        inside = (sample["x"] > r["centre"] - width / 2) & (sample["x"] <= r["centre"] + width / 2) & (sample["g"] == r["g"])
        assert inside.sum() == r["n"]


def test_one_factor(sample, frame):
    rows = {r["level"]: r for r in T.one_factor_ols(frame, "y", "year").collect()}
    design = np.stack([np.ones(len(sample["y"])), sample["year"] == 2008, sample["year"] == 2013], 1).astype(float)
    beta, rss, *_ = np.linalg.lstsq(design, sample["y"], rcond=None)
    se = np.sqrt(rss[0] / (len(design) - 3) * np.diag(np.linalg.inv(design.T @ design)))
    for k, level in enumerate(["2003", "2008", "2013"]):
        assert rows[level]["estimate"] == pytest.approx(beta[k])
        assert rows[level]["std_error"] == pytest.approx(se[k])
        assert rows[level]["is_base"] == (k == 0)


def test_two_factor(sample, frame):
    rows = {r["term"]: r for r in T.two_factor_ols(frame, "y", ["year", "unit"]).collect()}
    cols = {"(Intercept)": np.ones(len(sample["y"]))}
    cols |= {f"year_{y}": (sample["year"] == y).astype(float) for y in (2008, 2013)}
    cols |= {f"unit_{u}": (sample["unit"] == u).astype(float) for u in ("u2", "u3", "u4")}
    design = np.stack(list(cols.values()), 1)
    beta, rss, *_ = np.linalg.lstsq(design, sample["y"], rcond=None)
    se = np.sqrt(rss[0] / (len(design) - len(cols)) * np.diag(np.linalg.inv(design.T @ design)))
    assert set(rows) == set(cols)
    for k, term in enumerate(cols):
        assert rows[term]["estimate"] == pytest.approx(beta[k], abs=1e-9)
        assert rows[term]["std_error"] == pytest.approx(se[k], rel=1e-9)
        assert 0 <= rows[term]["p_value"] <= 1


@pytest.mark.parametrize("dense", [1024, 0])
def test_two_factor_unbalanced(spark, dense):
    """Direct and iterated solutions against the full design matrix."""
    rng = np.random.default_rng(8)
    i, j = rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    y = 0.3 * i - 0.7 * j + rng.normal(0, 1, 300) + 50
    df = spark.createDataFrame([(f"a{a:02}", f"b{b}", float(v)) for a, b, v in zip(i, j, y)], "a string, b string, y double")
    got = {r["term"]: r for r in T.two_factor_ols(df, "y", ["b", "a"], dense_levels=dense).collect()}
    la, lb = sorted(set(i)), sorted(set(j))
    names = ["(Intercept)"] + [f"a_a{a:02}" for a in la[1:]] + [f"b_b{b}" for b in lb[1:]]
    design = np.stack([np.ones(300)] + [(i == a).astype(float) for a in la[1:]] + [(j == b).astype(float) for b in lb[1:]], 1)
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rss[0] / (300 - len(names)) * np.diag(np.linalg.inv(design.T @ design)))
    assert set(got) == set(names)
    for k, name in enumerate(names):
        assert got[name]["estimate"] == pytest.approx(beta[k], abs=1e-7)
        assert got[name]["std_error"] == pytest.approx(se[k], rel=1e-7)


def test_two_factor_with_more_than_4096_levels(spark):
    n = 5000
    df = spark.range(3 * n).selectExpr(f"concat('u', lpad(id % {n}, 5, '0')) as a", f"concat('y', id div {n}) as b", f"0.5 * (id % {n}) + 3 * (id div {n}) + (id * 7 % 11 - 5) / 10 as y")
    got = {r["term"]: r for r in T.two_factor_ols(df, "y", ["a", "b"]).collect()}
    assert len(got) == n + 2 and all(r["std_error"] > 0 for r in got.values())
    y = np.array([[0.5 * k + 3 * t + ((k + t * n) * 7 % 11 - 5) / 10 for t in range(3)] for k in range(n)])
    assert got["b_y2"]["estimate"] == pytest.approx(y[:, 2].mean() - y[:, 0].mean())
    assert got["a_u04999"]["estimate"] == pytest.approx(y[-1].mean() - y[0].mean())
    some = {r["term"] for r in T.two_factor_ols(df, "y", ["a", "b"], terms=["b_y1", "a_u00007"]).collect()}
    assert some == {"b_y1", "a_u00007"}


def test_two_factor_edge_cases(spark):
    kind = "a string, b string, y double"

    def fit(rows):
        return {r["term"]: r for r in T.two_factor_ols(spark.createDataFrame(rows, kind), "y", ["a", "b"]).collect()}

    assert fit([]) == {} and fit([("x", None, 1.0), ("x", "y", None)]) == {}
    one = fit([("x", "p", 1.0), ("x", "q", 3.0), ("x", "q", 5.0)])
    assert set(one) == {"(Intercept)", "b_q"} and one["b_q"]["estimate"] == pytest.approx(3.0)
    single = fit([("x", "p", 2.0)])
    assert set(single) == {"(Intercept)"} and single["(Intercept)"]["estimate"] == pytest.approx(2.0) and single["(Intercept)"]["std_error"] is None
    saturated = fit([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 4.0)])
    assert saturated["a_y"]["estimate"] == pytest.approx(3.0) and saturated["a_y"]["std_error"] is None and saturated["a_y"]["p_value"] is None
    apart = fit([("x", "p", 1.0), ("x", "p", 2.0), ("y", "q", 4.0), ("y", "q", 5.0)])
    assert apart["(Intercept)"]["estimate"] == pytest.approx(1.5) and apart["a_y"]["estimate"] is None and apart["b_q"]["estimate"] is None


def test_trend_and_moments(sample, frame):
    line = {r["g"]: r for r in T.linear_trend(frame, ["g"], "x", "y").collect()}
    sums = {r["g"]: r for r in T.mixed_moments(frame, ["g"], "x", "y").collect()}
    for g in "ab":
        keep = sample["g"] == g
        slope, intercept = np.polyfit(sample["x"][keep], sample["y"][keep], 1)
        assert line[g]["slope"] == pytest.approx(slope) and line[g]["intercept"] == pytest.approx(intercept)
        assert sums[g]["sum_xy"] == pytest.approx((sample["x"][keep] * sample["y"][keep]).sum())


def test_density_without_groups_is_the_single_group(spark):
    from panelspark.operators.stats import kernel_density

    df = spark.createDataFrame([("g", float(k * k % 37)) for k in range(50)], "g string, x double")
    whole = {r["grid"]: r["density"] for r in kernel_density(df, [], "x", 0, 40, 9).collect()}
    single = {r["grid"]: r["density"] for r in kernel_density(df, ["g"], "x", 0, 40, 9).collect()}
    assert whole.keys() == single.keys() and all(abs(whole[k] - single[k]) < 1e-12 for k in whole)


def test_nth_values_with_outlier_cuts_bins_again(spark, monkeypatch):
    """One far value puts all others into one bin, which is then cut itself."""
    xs = [k / 7 for k in range(3000)] + [1e12]
    values = spark.createDataFrame([("g", x, 2) for x in xs], "g string, x double, w long")
    targets = spark.createDataFrame([("g", str(t), t) for t in (1, 2, 3000, 4001, 6001)], "g string, which string, target long")
    steps = []
    real = T.written
    monkeypatch.setattr(T, "written", lambda *a, **k: steps.append(1) or real(*a, **k))
    got = {int(r["which"]): r["x"] for r in T.nth_values(values, ["g"], targets, bins=64, sort_rows=100).collect()}
    assert got == {t: xs[(t - 1) // 2] for t in (1, 2, 3000, 4001, 6001)}
    assert 2 <= len(steps) <= 8


def test_student_tail():
    # Two-sided tails for one and two degrees in closed form, and a table value.
    for t in (0.0, 0.3, 2.0, 50.0):
        assert T.student_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert T.student_two_sided(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    assert T.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert T.student_two_sided(1.959963985, 10**6) == pytest.approx(0.05, abs=1e-5)
    assert math.isnan(T.student_two_sided(float("nan"), 5))
