"""Near duplicates against comparing all sets with one another."""

import random
from collections import Counter

import pytest

from panelspark.llm import near_dup, queries
from panelspark.llm.components import components
from tests.llm.helpers import FOLDER, PROSE, awkward, documents


def roots(n, links):
    up = list(range(n))

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in links:
        up[top(a)] = top(b)
    return [top(k) for k in range(n)]


def brute(rows, width, percent=80):
    """Counter of (doc_id, n_shingles, component_id, kept) rows, and the groups of row numbers."""
    sets = [frozenset(near_dup.shingles(t, width)) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    top = roots(len(rows), links)
    least = {}
    for k, t in enumerate(top):
        if rows[k][0] is not None:
            least[t] = min(least.get(t, rows[k][0]), rows[k][0])
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = least.get(top[k]) if sets[k] else i
        out[(i, len(sets[k]), c, i == c)] += 1
    return out, top, sets


def test_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in queries.QUERIES["op4_near_dup"](spark, FOLDER).collect())
    assert got == brute(rows, 2)[0]


def edited(words, rng, share):
    return [rng.choice(["zig", "zag", "zog", f"new{rng.random()}"]) if rng.random() < share else w for w in words]


def crowd():
    """A large group of near copies, a passage shared by many, and pairs right at the threshold."""
    rng = random.Random(5)
    rows, i = [], 0
    base = [f"b{rng.randrange(400)}" for _ in range(150)]
    for _ in range(60):
        rows.append((i, " ".join(edited(base, rng, rng.choice([0.01, 0.03, 0.05, 0.06])))))
        i += 1
    passage = [f"p{k}" for k in range(60)]
    for _ in range(60):
        rows.append((i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 8, 12, 15, 40]))])))
        i += 1
    for k in range(30):
        own = [f"u{k}x{j}" for j in range(41)]
        rows.append((i, " ".join(own)))
        # 40 shingles here, 36 in common of 44: above; 35 of 45: below.
        rows.append((i + 1, " ".join(own[:-4] + [f"t{k}{j}" for j in range(4 if k % 2 else 5)])))
        rows.append((i + 2, " ".join(own).upper()))
        i += 3
    rng.shuffle(rows)
    return rows


def test_crowded_groups(spark):
    rows = crowd()
    got = Counter(tuple(r) for r in near_dup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows]), width=2).collect())
    assert got == brute(rows, 2)[0]


@pytest.mark.parametrize("small", [0, 3])
def test_exact_way_for_large_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dup, "MEMBERS_PER_TASK", 7)
    rows = crowd()
    got = Counter(tuple(r) for r in near_dup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows]), width=2).collect())
    assert got == brute(rows, 2)[0]


def test_exact_way_with_repeated_rows(spark, monkeypatch):
    """A table ingested three times, and one text under many null ids."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 0)
    rows = crowd() * 3
    rows += [(None, rows[0][1])] * 20
    got = Counter(tuple(r) for r in near_dup.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows]), width=2).collect())
    assert got == brute(rows, 2)[0]


def test_awkward_rows(spark):
    rows = awkward() + [(30, "two words", "en", "s"), (31, "Two  WORDS", "en", "s"), (29, "two words more", "en", "s"), (12, PROSE + " more", "en", "s")]
    df = documents(spark, rows)
    for width in (2, 5):
        got = Counter(tuple(r) for r in near_dup.near_duplicates(df, width=width).collect())
        assert got == brute([r[:2] for r in rows], width)[0]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    rows = awkward() + [(40, PROSE, "en", "s"), (41, "", "en", "s")]
    df = documents(spark, rows)
    _, top, sets = brute([r[:2] for r in rows], 5)
    kept = near_dup.keep_one(df, width=5)
    assert kept.columns == df.columns
    got = kept.collect()
    wordless = sum(not s for s in sets)
    assert len(got) == wordless + len({t for t, s in zip(top, sets) if s})
    firsts = {min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if top[k] == t and sets[k]) for t, s in zip(top, sets) if s}
    assert firsts <= {(r.doc_id is None, r.doc_id or 0) for r in got}
    assert near_dup.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    links = [*chain, *star, (5000, 5000), (7, 3), (3, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tensored_tables_meet_at_the_threshold():
    """Pairs at a similarity of 0.8 share a hash of both collections; far pairs do not."""
    rng = random.Random(3)
    missed = met = 0
    for k in range(300):
        shared, own = [f"s{k}.{j}" for j in range(80)], [f"o{k}.{j}" for j in range(20)]
        a = near_dup._halves(near_dup.shingle_hashes({(x,) for x in shared + own[:10]}))
        b = near_dup._halves(near_dup.shingle_hashes({(x,) for x in shared + own[10:]}))
        far = near_dup._halves(near_dup.shingle_hashes({(f"f{k}.{rng.random()}",) for _ in range(90)} | {(x,) for x in shared[:5]}))
        same, other = a == b, a == far
        missed += not (same[: near_dup.HALVES].any() and same[near_dup.HALVES :].any())
        met += other[: near_dup.HALVES].any() and other[near_dup.HALVES :].any()
    assert missed == 0 and met == 0


def test_crowd_below_the_threshold_makes_no_candidates(spark):
    """Every text shares 88 of 100 words with every other: common shingles reach no index."""
    texts = [(k, " ".join([f"s{j}" for j in range(88)] + [f"u{k}x{j}" for j in range(12)])) for k in range(300)]
    df = spark.createDataFrame(texts, "node long, text string")
    wanted = df.select("node", df.node.alias("component"))
    assert near_dup._rare_pairs(df, wanted, 2, 80).count() == 0


def test_lengths_around_the_threshold_meet(spark):
    """Sets of many sizes that share a core: all pairs at or above the threshold are candidates."""
    rng = random.Random(12)
    texts = []
    for k in range(80):
        core = [f"s{j}" for j in range(rng.choice([70, 80, 88, 90]))]
        texts.append((k, " ".join(core + [f"u{rng.randrange(40)}x{j}" for j in range(rng.choice([2, 9, 16, 20]))])))
    df = spark.createDataFrame(texts, "node long, text string")
    got = {(r.a, r.b) for r in near_dup._rare_pairs(df, df.select("node", df.node.alias("component")), 2, 80).collect()}
    sets = {k: near_dup.shingles(t, 2) for k, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 100 and not want - got
