"""Near duplicates among vectors against comparing all of them."""

import math
import random

import numpy as np
import pytest

from panelspark.llm import embeddings, queries
from tests.llm.helpers import FOLDER

VECTORS = "vec_id long, embedding array<float>, label int, node string, v string, list string, component string"


def frame(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(*r, 1, "n", "v", "l", "c") for r in rows], schema)


def brute(rows, least=0.95):
    """Sorted rows (vec_id, n_links, component_id, kept), from every pair."""
    units = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, dtype=np.float32).astype(float) if good else None)
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                n[a] += 1
                n[b] += 1
                up[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = i if units[k] is None else low.get(top(k))
        out.append((i, n[k], component, i == component))
    return sorted(out, key=str)


def found(spark, rows, schema=VECTORS):
    got = embeddings.near_vectors(frame(spark, rows, schema))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def cloud(seed=5, groups=30, width=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(size=width)
        for _ in range(rng.integers(1, 12)):
            rows.append((base + rng.normal(size=width) * rng.choice([0.02, 0.15, 0.3])) * rng.uniform(0.1, 9))
    rows += [rows[3]] * 7 + [rows[10] * 2]
    random.Random(seed).shuffle(rows)
    return [(1000 - k, [float(x) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_all_pairs(spark, monkeypatch, small):
    if small:  # many parts of members and visitors, several passes
        monkeypatch.setattr(embeddings, "MEMBER_VALUES", 1)
        monkeypatch.setattr(embeddings, "VISITORS", 16)
        monkeypatch.setattr(embeddings, "PASS", 5)
    rows = cloud()
    want = brute(rows)
    assert found(spark, rows) == want and sum(r[1] for r in want) > 200


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (3, [2.0, 4.0, 6.0]), (9, v), (9, v), (None, v), (None, None), (1, None), (1, []), (2, [0.0, 0.0, 0.0]), (4, [1.0, None, 3.0])]
    rows += [(6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0]), (11, [3e38, 3e38, 3e38])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:0]) == []
    doubles = VECTORS.replace("array<float>", "array<double>")
    assert found(spark, [(1, [1e300, 1e300]), (2, [1e-300, 1e-300])], doubles) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_on_planted_copies(spark):
    """Sixty-four wide, so that probes are fewer than exactness would ask for."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 64))
    near = base[:600] + rng.normal(size=(600, 64)) * 0.22
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([base, near]))]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = int(((x @ x.T) >= 0.95).sum()) - len(rows)
    got = sum(r[1] for r in found(spark, rows))
    assert links > 500 and 0.99 * links <= got <= links


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(3)
    v = embeddings.normed(rng.normal(size=(500, 30)))
    model = embeddings.Model(v, 8)
    home, codes, error = model.encoded(v)
    for l in range(8):
        at = home == l
        low = model.bounds(v, codes[at], error[at], l)
        true = np.sqrt(np.maximum(0, 2 - 2 * v @ v[at].T))
        assert (low <= true + 1e-3).all()


def test_query_on_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_vectors"](spark, FOLDER).collect()), key=str)
    assert got == brute(rows)
