"""Event integration against a direct greedy matching of single entries."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark import session
from panelspark.operators import events as E
from panelspark.operators import graph, joins, spatial
from panelspark.plans import conflict, survey

LEVELS = ["Level_1", "Level_2"]
TAXONOMY = {
    ("A", "x"): ("strike", "armed"),
    ("A", "y"): ("march", "civil"),
    ("B", "x"): ("strike", "armed"),
    ("B", "z"): ("raid", "armed"),
    ("C", "x"): ("strike", "armed"),
    ("C", "y"): ("rally", "civil"),
}
COLUMNS = "event_id long, dataset string, base_category string, date date, enddate date, longitude double, latitude double"
DAY = dt.date(2010, 5, 1)


def km(a, b):
    la, lb = math.radians(a[6]), math.radians(b[6])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
    return 2 * E.EARTH_KM * math.asin(math.sqrt(h))


def direct(rows, window_km=4.0, days=2, order="ABC"):
    """Every entry pair scored, best first, each entry used once per source."""
    rows = [(*r[:4], r[4] if r[4] and r[4] > r[3] else None, *r[5:]) for r in rows]
    site = {}
    for r in rows:
        site[r[1:]] = min(site.get(r[1:], r[0]), r[0])
    rank = {r[0]: (hashlib.md5(str(r[0]).encode()).hexdigest()[: E.COPY_CHUNKS], r[0]) for r in rows}
    kept, out = [r for r in rows if r[1] == order[0]], {}
    for source in order[1:]:
        new = [r for r in rows if r[1] == source]
        scored = []
        for a in kept:
            for b in new:
                if (a[4] is None) != (b[4] is None) or abs((a[3] - b[3]).days) > days:
                    continue
                if a[4] and abs((a[4] - b[4]).days) > days:
                    continue
                apart = sum(p != q for p, q in zip(TAXONOMY[a[1:3]], TAXONOMY[b[1:3]]))
                d = km(a, b)
                if apart < len(LEVELS) and d <= window_km:
                    score = (apart, math.floor(d * 1000 + 0.5), abs((a[3] - b[3]).days), site[a[1:]], site[b[1:]])
                    scored.append((score, rank[a[0]], rank[b[0]], a, b))
        used = set()
        for *_, a, b in sorted(scored, key=lambda s: s[:3]):
            if a[0] not in used and b[0] not in used:
                used |= {a[0], b[0]}
                out[b[0]] = a[0]
        kept += [b for b in new if b[0] not in out]
    return out


def integrated(spark, rows):
    tax = E.taxonomy_frame(spark, TAXONOMY, LEVELS)
    got = E.integrate(spark.createDataFrame(rows, COLUMNS), tax, ["A", "B", "C"], LEVELS)
    return got


def links(df):
    return {r["event_id"]: r["duplicate_of"] for r in df.where("duplicate_of is not null").collect()}


def crowd(n, seed, spread, lat=6.0, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        d, c = rng.choice(list(TAXONOMY))
        date = DAY + dt.timedelta(days=rng.randrange(6))
        end = date + dt.timedelta(days=rng.randrange(3)) if rng.random() < 0.2 else None
        here = rng.random() < hot
        rows.append(
            (k, d, c, date, None if here else end, 3.0 if here else 3.0 + rng.random() * spread, lat if here else lat + rng.random() * spread)
        )
    return rows


def test_same_day_three_km(spark):
    lon = 3 / 111.2
    rows = [(1, "A", "x", DAY, None, 0.0, 0.0), (2, "B", "x", DAY, None, lon, 0.0), (3, "A", "x", DAY, None, -lon, 0.0)]
    assert links(integrated(spark, rows)) == {2: 1}


def test_rules(spark):
    late = DAY + dt.timedelta(days=3)
    rows = [
        (1, "A", "x", DAY, None, 0.0, 0.0),
        (2, "B", "x", late, None, 0.0, 0.0),  # three days apart
        (3, "C", "y", DAY, None, 0.0, 0.0),  # no taxonomy level in common
        (4, "B", "z", DAY, late, 0.0, 0.0),  # an episode
        (5, "C", "x", DAY, None, 0.0, 1.0),  # far away
        (6, "B", "z", DAY, None, None, None),  # no place
    ]
    got = integrated(spark, rows)
    assert links(got) == {} and got.count() == 6
    assert E.unique_events(got).count() == 6


@pytest.mark.parametrize("case", [dict(seed=1, spread=0.15), dict(seed=2, spread=0.05, hot=0.4), dict(seed=3, spread=0.2, lat=71.0)])
def test_equals_direct_matching(spark, case):
    rows = crowd(260, **case)
    want = direct(rows)
    got = integrated(spark, rows)
    assert links(got) == want and len(want) > 30
    assert got.count() == len(rows)


@pytest.mark.parametrize("partners", [0, 3, 64])
def test_tiers_equal_single_step(spark, monkeypatch, partners):
    """All windows crowded, some, and none: what is calm is scored at once, the rest in tiers."""
    rows = crowd(160, seed=4, spread=0.06, hot=0.3)
    monkeypatch.setattr(E, "_pair_budget", lambda sites: -1)
    monkeypatch.setattr(E, "CROWD_PARTNERS", partners)
    assert links(integrated(spark, rows)) == direct(rows)


def test_one_crowded_town_leaves_other_sites_out_of_the_tiers(spark, monkeypatch):
    town = crowd(120, seed=5, spread=0.02, hot=0.3)
    # Around the town's edge chains run into it; far away nothing does.
    edge = [(1000 + k, d, c, t, e, x, y + 0.05) for k, (_, d, c, t, e, x, y) in enumerate(crowd(30, seed=6, spread=0.05))]
    far = [(2000 + k, d, c, t, e, x + 40, y) for k, (_, d, c, t, e, x, y) in enumerate(crowd(200, seed=7, spread=0.8))]
    rows = town + edge + far
    tiered = []
    monkeypatch.setattr(E, "WINDOW_PAIRS", 3)
    monkeypatch.setattr(E, "CROWD_PARTNERS", 10)
    real = E.candidate_pairs

    def watched(kept, incoming, km, days, levels, metres=(-1, None), level=None, hot=True):
        if level is not None:
            tiered.extend(r[0] for df in (kept, incoming) for r in df.select("longitude").collect())
        return real(kept, incoming, km, days, levels, metres, level, hot)

    monkeypatch.setattr(E, "candidate_pairs", watched)
    assert links(integrated(spark, rows)) == direct(rows)
    assert tiered and max(tiered) < 10


def test_ranks_of_copies_are_gapless(spark):
    rows = [(k, "A", "x", DAY, None, 1.0, 1.0) for k in range(500)]
    ranked = E.ranked_copies(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 501))
    assert {tuple(r["site"]) for r in ranked} == {(0, "A")} and {r["n_copies"] for r in ranked} == {500}


def test_one_source_only(spark):
    tax = E.taxonomy_frame(spark, TAXONOMY, LEVELS)
    df = spark.createDataFrame([(1, "A", "x", DAY, None, 0.0, 0.0)], COLUMNS)
    assert E.integrate(df, tax, ["A"], LEVELS).first()["duplicate_of"] is None


def test_harmonise_and_split(spark):
    feed = spark.createDataFrame(
        [(1, "Riots/Protests", 2, "05/01/2010", 1.0, 2.0), (2, "Riots/Protests", 0, "06/01/2010", 1.0, 2.0), (3, "Battle", None, "bad", 1.0, 2.0)],
        "event_id long, t string, f int, d string, lon double, lat double",
    )
    tax = E.split_by_measure("t", "f", "Riots/Protests", "Riots", "Protests")
    rows = E.harmonise(feed, "A", tax, "d", "lon", "lat", date_format="dd/MM/yyyy").orderBy("event_id").collect()
    assert [(r["base_category"], r["date"]) for r in rows] == [
        ("Riots", dt.date(2010, 1, 5)), ("Protests", dt.date(2010, 1, 6)), ("Battle", None),
    ]


def test_location_days(spark):
    df = spark.createDataFrame(
        [("v", DAY, 1.0, 1.0), ("v", DAY, 1.0, 1.0), ("o", DAY, 1.0, 1.0), ("v", DAY, None, None)], "cls string, date date, latitude double, longitude double"
    )
    rows = E.location_days(df, F.col("cls") == "v").collect()
    assert [(r["events"], r["latitude"]) for r in rows] == [(2, 1.0)]


def test_sources_number_their_entries_independently(spark):
    """Overlapping ids: rows in equal rows out, links name the source as well."""
    rows = [
        (1, "A", "x", DAY, None, 10.0, 5.0),
        (2, "A", "y", DAY, None, 30.0, 5.0),
        (1, "B", "x", DAY, None, 10.001, 5.0),
        (2, "B", "z", DAY, None, 50.0, 5.0),
        (2, "C", "x", DAY, None, 10.0, 5.001),
    ]
    tax = E.taxonomy_frame(spark, TAXONOMY, LEVELS)
    got = E.integrate(spark.createDataFrame(rows, COLUMNS), tax, ["A", "B", "C"], LEVELS)
    assert got.count() == len(rows)
    links = {(r["dataset"], r["event_id"]): (r["duplicate_of_dataset"], r["duplicate_of"]) for r in got.where("duplicate_of is not null").collect()}
    assert links == {("B", 1): ("A", 1), ("C", 2): ("A", 1)}
    assert {(r["dataset"], r["event_id"]) for r in E.unique_events(got).collect()} == {("A", 1), ("A", 2), ("B", 2)}


@pytest.mark.parametrize("most", [0, 5, 40])
def test_rounds_and_components_are_one_matching(spark, monkeypatch, most):
    rows = crowd(200, seed=9, spread=0.1, hot=0.3)
    monkeypatch.setattr(E.match_sites, "__defaults__", (most,))
    assert links(integrated(spark, rows)) == direct(rows)


def chain_pairs(spark, n, chains):
    """Chains in which every pair but the last waits for a better one beside it; chains do not touch."""
    return spark.range(n * chains).selectExpr(
        f"named_struct('id', (id % {n} + 1) div 2 + id div {n} * {n}, 'of', 'A') as site_a",
        f"named_struct('id', id % {n} div 2 + id div {n} * {n}, 'of', 'B') as site_b",
        "0 as levels", f"{n} - id % {n} as metres", "0 as days",
        "1L as free_a", "1L as free_b", "0L as used_a", "0L as used_b",
    )


@pytest.mark.parametrize("n, chains", [(2000, 1), (300, 200)])
def test_long_chains_take_few_steps(spark, monkeypatch, n, chains):
    steps = []
    real = E.written
    monkeypatch.setattr(E, "written", lambda *a, **k: steps.append(1) or real(*a, **k))
    got = {(r["site_a"]["id"], r["site_b"]["id"]) for r in E.match_sites(chain_pairs(spark, n, chains)).collect()}
    assert got == {((k + 1) // 2 + c * n, k // 2 + c * n) for k in range(n - 1, -1, -2) for c in range(chains)}
    assert len(steps) <= 4


def test_components_are_settled_side_by_side(spark, monkeypatch):
    """Pairs go to tasks by component, however few are open."""
    plans = []
    real = E.written
    monkeypatch.setattr(E, "written", lambda df, *a, **k: plans.append(df._jdf.queryExecution().toString()) or real(df, *a, **k))
    E.match_sites(chain_pairs(spark, 50, 40))
    settling = [p for p in plans if "_settle" in p]
    assert settling and all("RepartitionByExpression [root" in p for p in settling)


def test_hot_site_with_many_links(spark):
    """A third of all entries at one place, their partners at many places around it."""
    hot = [(k, "A", "x", DAY, None, 1.0, 1.0) for k in range(300)]
    around = [(k, "B", "x", DAY, None, 1.0 + k * 1e-5, 1.0) for k in range(200)]
    assert len(links_of(integrated(spark, hot + around))) == 200


def links_of(df):
    rows = df.where("duplicate_of is not null").select("dataset", "event_id", "duplicate_of").collect()
    assert len({r["duplicate_of"] for r in rows}) == len(rows)
    return rows


def test_what_grows_with_the_entries_is_never_broadcast(spark, monkeypatch):
    """Spark would broadcast these sides by the size of their compressed files; only the taxonomy, counted, may be."""
    plans = []
    real = session.written

    def watched(df, name, **metrics):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, **metrics)

    for module in (E, graph, joins):
        monkeypatch.setattr(module, "written", watched)
    monkeypatch.setattr(graph.components, "__defaults__", (20,))
    rows = crowd(160, seed=4, spread=0.06, hot=0.3)
    for budget in (10**9, -1):
        monkeypatch.setattr(E, "_pair_budget", lambda sites: budget)
        got = integrated(spark, rows)
        plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert {"copies", "pairs", "stars", "settled", "kept", "result"} <= {name for name, _ in plans}
    assert {name for name, plan in plans if "Broadcast" in plan} == {"sites"}


def test_tiers_end_when_what_is_left_is_few(spark, monkeypatch):
    """Crowded at first, then not: the rest is scored in one go, with the same links."""
    rows = crowd(160, seed=4, spread=0.06, hot=0.3)
    asked, tiers = [], []
    real = E.candidate_pairs

    def watched(kept, incoming, km, days, levels, metres=(-1, None), level=None, hot=True):
        if level is not None:
            tiers.append((level, metres))
        return real(kept, incoming, km, days, levels, metres, level, hot)

    # The first look and the one after the first tier find too many, the next one few enough.
    monkeypatch.setattr(E, "_pair_budget", lambda sites: asked.append(sites) or (10**9 if len(asked) % 3 == 0 else -1))
    monkeypatch.setattr(E, "CROWD_PARTNERS", 0)
    monkeypatch.setattr(E, "candidate_pairs", watched)
    assert links(integrated(spark, rows)) == direct(rows)
    assert [level for level, _ in tiers] == [0] * 4 and len(asked) == 6


def test_panel_of_counts_is_planned_without_what_is_behind_it(spark, monkeypatch):
    plans = {}

    def noted(df, name, **metrics):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return session.written(df, name, **metrics)

    monkeypatch.setattr(spatial, "written", noted)
    # A square of two halves that are put together, and one far off.
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    square = [("X", "U", *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    far = [("X", "V", x1 + 9, y1, x2 + 9, y2) for _, _, x1, y1, x2, y2 in square]
    kind = "NAME_0 string, NAME_1 string, x1 double, y1 double, x2 double, y2 double"
    edges = spark.createDataFrame(square[:2] + far, kind).union(spark.createDataFrame(square[2:], kind))
    day = dt.date(2000, 1, 5)
    events = spark.createDataFrame(
        [(day, 0.5, 0.5, "W"), (day, 0.5, 0.5, "W"), (day, 0.25, 0.5, "W"), (None, 0.5, 0.5, "W"), (day, 0.5, 0.5, "Z"), (day, None, None, "W"), (day, 5.0, 5.0, "W")],
        "date date, longitude double, latitude double, Level_4_text string",
    )
    panel = conflict.event_panel(events, edges, "2000-01-01", "2000-02-01", "W", lags=(1,))
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("FileScan") == 1
    got = {(r["NAME_1"], r["ymd"] and r["ymd"].month): (r["violent_events"], r["lag_violent_events_1"]) for r in panel.collect()}
    assert got == {("U", None): (1, None), ("U", 1): (2, 1), ("U", 2): (0, 2), ("V", 1): (0, None), ("V", 2): (0, 0)}
    assert "Union" not in plans.pop("unit_index")

    clusters = spark.createDataFrame([("S", 1, 9.5, 0.5), ("S", 2, 5.0, 5.0)], "SurveyId string, CLUSTER int, LONGNUM double, LATNUM double")
    found = {(r["CLUSTER"], r["NAME_1"]) for r in survey.locate_clusters(clusters, edges).collect()}
    assert found == {(1, "V"), (2, None)}
    assert "Union" not in plans["unit_index"]
