"""Matching by blocks against the direct greedy matching of single entries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import blocks as B
from panelspark.operators import events as E
from tests.test_events import COLUMNS, DAY, LEVELS, TAXONOMY, crowd, direct, integrated, links


@pytest.fixture
def many(monkeypatch):
    """Few sites count as many, so that blocks settle them."""
    monkeypatch.setattr(E, "JOINED_SITES", -1)


def spread(n, seed, lon=3.0, lat=6.0, wide=0.3, days=40, first=DAY):
    """Entries over more days and a wider area, so that there are many blocks."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        d, c = rng.choice(list(TAXONOMY))
        date = first + dt.timedelta(days=rng.randrange(days))
        end = date + dt.timedelta(days=rng.randrange(4)) if rng.random() < 0.2 else None
        x = lon + rng.choice([rng.random() * wide, round(rng.random() * wide, 1)])
        rows.append((k, d, c, date, end, x if x <= 180 else x - 360, lat + rng.choice([rng.random(), round(rng.random(), 1)]) * wide))
    return rows


def noted(monkeypatch):
    """Sizes of the blocks that were settled, and calls that left something to the joins."""
    sizes, joined = [], []
    settled, joins = B._settled, E._match_joined
    monkeypatch.setattr(B, "_settled", lambda *a: sizes.append(a[5]) or settled(*a))
    monkeypatch.setattr(E, "_match_joined", lambda *a: joined.append(1) or joins(*a))
    return sizes, joined


@pytest.mark.parametrize(
    "size, case",
    [
        (4, dict(seed=2, lat=71.0)),
        (4, dict(seed=3, lon=179.85)),
        (8, dict(seed=4, lat=-0.15, first=dt.date(1969, 12, 15))),
        (4, dict(seed=5, lat=89.75, wide=0.24, lon=10.0)),
        (B.EVERYTHING, dict(seed=6, lat=-89.99, wide=0.05, lon=-179.99, days=10)),
    ],
)
def test_blocks_equal_direct_matching(spark, monkeypatch, many, size, case):
    """Each turn books only what the whole matching books; sites that wait after two turns are left to the joins."""
    sizes, joined = noted(monkeypatch)
    monkeypatch.setattr(B, "SIZES", (size,))
    monkeypatch.setattr(B, "TURNS", 2)
    monkeypatch.setattr(B, "CHUNK_ROWS", 40)
    monkeypatch.setattr(B, "CHUNK_PAIRS", 10)
    rows = spread(400, **case)
    want = direct(rows)
    got = integrated(spark, rows)
    assert links(got) == want and len(want) > 40
    assert got.count() == len(rows)
    assert set(sizes) == {size} and (size < B.EVERYTHING or not joined)


def test_size_of_blocks_follows_their_loads(spark, monkeypatch, many):
    sizes, joined = noted(monkeypatch)
    monkeypatch.setattr(B, "BLOCK_SITES", 60)
    rows = spread(500, seed=7, days=60)
    assert links(integrated(spark, rows)) == direct(rows)
    assert min(sizes) < 64 < max(sizes) and not joined


def test_town_too_full_for_a_block_goes_to_the_tiers(spark, monkeypatch, many):
    """What crowds a window waits; all else is settled by blocks, chains that run into the town excepted."""
    _, joined = noted(monkeypatch)
    monkeypatch.setattr(B, "BLOCK_SITES", 25)
    monkeypatch.setattr(E, "WINDOW_PAIRS", 3)
    monkeypatch.setattr(E, "CROWD_PARTNERS", 10)
    town = crowd(150, seed=8, spread=0.03, hot=0.2)
    far = [(1000 + k, *r[1:]) for k, r in enumerate(spread(400, seed=9, lat=7.0))]
    edge = [(2000 + k, *r[1:5], r[5], r[6] + 0.04) for k, r in enumerate(crowd(40, seed=10, spread=0.05))]
    seen = []
    real = E.candidate_pairs
    monkeypatch.setattr(E, "candidate_pairs", lambda *a, **k: seen.append(max(r[0] for r in a[0].select("latitude").collect())) or real(*a, **k))
    assert links(integrated(spark, town + far + edge)) == direct(town + far + edge)
    assert joined and seen and max(seen) < 7.0


def test_repeated_rows_unknown_labels_and_no_number(spark, many):
    nan = float("nan")
    rows = spread(200, seed=11)
    rows += [(900 + k, "B", "unknown", DAY, None, 3.0, 6.0) for k in range(3)] + [(950, "A", None, DAY, None, 3.0, 6.0)]
    rows += [(960, "A", "x", DAY, None, nan, 6.0), (961, "B", "x", DAY, None, nan, 6.0), (962, "B", "x", None, None, 3.0, 6.0), (963, "C", "x", DAY, None, None, None)]
    tax = E.taxonomy_frame(spark, TAXONOMY, LEVELS)
    df = spark.createDataFrame(rows, COLUMNS)
    once, twice = (E.integrate(d, tax, ["A", "B", "C"], LEVELS) for d in (df, df.union(df)))
    want = direct([r for r in rows[:200]])
    assert links(once) == want and once.count() == len(rows)
    assert twice.count() == 2 * len(rows) and twice.where("duplicate_of is not null").count() == 2 * len(want)


def test_ids_of_other_types(spark, many):
    """Text ids break ties by text, as the joins do."""
    rows = [(f"e{r[0]}", *r[1:]) for r in spread(300, seed=12)]
    tax = E.taxonomy_frame(spark, TAXONOMY, LEVELS)
    df = spark.createDataFrame(rows, COLUMNS.replace("event_id long", "event_id string"))
    by_blocks = links(E.integrate(df, tax, ["A", "B", "C"], LEVELS))
    E.JOINED_SITES = 10**9  # put back by the fixture
    assert by_blocks == links(E.integrate(df, tax, ["A", "B", "C"], LEVELS)) and len(by_blocks) > 20


def test_long_chain_in_one_block():
    """Every pair but the last waits for the one before; pairs are looked at once each, not once a round."""
    import numpy as np

    n = 50_000
    a = np.arange(n) // 2 + n
    b = (np.arange(n) + 1) // 2
    free, used = np.ones(2 * n, dtype=np.int64), np.zeros(2 * n, dtype=np.int64)
    won_a, won_b, copies, *_, waits = B._book(a[::-1], b[::-1], free, used, np.ones(2 * n, dtype=bool))
    assert len(won_a) == n // 2 and set(copies) == {1} and not waits.any()
    assert set(zip(won_a.tolist(), won_b.tolist())) == set(zip(a[::-1][::2].tolist(), b[::-1][::2].tolist()))


def test_hot_sites_are_ranked_alike(spark, monkeypatch):
    """Sites ranked at once and in chunks have the same ranks; zero has one place whatever its sign."""
    rows = [(k, "A", "x", DAY, None, 1.0, 1.0) for k in range(300)] + [(k, "A", "x", DAY, None, -0.0 if k % 2 else 0.0, None) for k in range(400, 420)]
    rows += [(k, "B", "z", None, None, 2.0, float(k // 2)) for k in range(500, 540)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = []
    for most in (10**9, 100, 0):
        monkeypatch.setattr(E, "BUCKET_COPIES", most)
        got.append(sorted((r["event_id"], *r["site"], r["n_copies"], r["rank"]) for r in E.ranked_copies(df).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert sorted(r[4] for r in got[0] if 400 <= r[0] < 420) == list(range(1, 21))


def test_matching_many_sites_copies_few(spark, monkeypatch, many):
    """Sites meet in blocks, not by 27 copies of every later one."""
    shares = []
    real = B._settled

    def watched(placed, *a):
        shares.append(placed.count() / placed.where(F.col("__own")).count())
        return real(placed, *a)

    monkeypatch.setattr(B, "_settled", watched)
    monkeypatch.setattr(B, "BLOCK_SITES", 200)
    monkeypatch.setattr(E, "_neighbours", None)
    integrated(spark, spread(900, seed=13, days=60)).count()
    assert shares and max(shares) < 6
