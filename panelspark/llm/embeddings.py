"""Near duplicates among vectors by product quantisation.

Vectors of length one go into coarse inverted lists (nearest centroid); each list keeps, per
member, one code byte for each short stretch of the residual, and how far the decoded member is
from the true one.  Within a list, distances from tables (query stretch to code) less the
member's own coding error are lower bounds, so a pair passed over there is no link.  What is left
is compared exactly.

A vector looks into every list whose hyperplane (halfway between its own centroid and that of
the list) is near enough.  A partner lies past it only if the two differ by that much along one
direction.  ``SIGMAS`` standard deviations of a random difference, in as many dimensions as the
sample's residuals really fill, are allowed for, at most the whole link distance, which is exact
(up to SIGMAS ** 2 dimensions it always is).

Centroids and codes only steer the work; they are fitted on a bounded sample.  Every vector is
indexed, and every one is a query.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from panelspark.llm.common import bound_batches, column
from panelspark.llm.components import components
from panelspark.session import written

# Most lists, sampled rows per list, and the most values a sample holds (32 MB as doubles).
LISTS = 4096
SAMPLE_PER_LIST = 40
LEAST_SAMPLE = 2048
SAMPLE_VALUES = 1 << 22
ROUNDS = 8
SIGMAS = 4.0
STRETCH = 4  # values per code byte
CODES = 256
# A task holds so many members (and no more than so many values of them) and lets visitors pass.
MEMBERS = 8192
MEMBER_VALUES = 1 << 22
VISITORS = 1 << 16
PASS = 512  # visitors compared at once
SLACK = 1e-6
BOUND_SLACK = 1e-3  # of single-precision table sums


def _k_means(points, k: int, seed: int):
    """Centroids by Lloyd's rounds over a sample."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def _nearest(points, centres):
    import numpy as np

    out = np.empty(len(points), dtype=np.int64)
    norms = (centres * centres).sum(1)
    for lo in range(0, len(points), 4096):
        out[lo : lo + 4096] = (norms - 2 * points[lo : lo + 4096] @ centres.T).argmin(1)
    return out


def normed(arrays):
    """Vectors of length one, as doubles; scaled first, so that no square overflows."""
    import numpy as np

    v = np.array(arrays, dtype=np.float64)
    v /= np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def unit_rows(lists):
    """The same of an Arrow column of equally long lists, without a Python object per value."""
    return normed(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))


class Model:
    """Coarse centroids and, per stretch of the residual, its codes."""

    def __init__(self, sample, lists: int):
        import numpy as np

        self.centres = _k_means(sample, lists, 0)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        width = sample.shape[1]
        self.stretches = [slice(lo, min(lo + STRETCH, width)) for lo in range(0, width, STRETCH)]
        self.codes = [_k_means(np.ascontiguousarray(rest[:, s]), CODES, 1 + k) for k, s in enumerate(self.stretches)]
        spread = np.linalg.eigvalsh(rest.T @ rest)
        self.dimensions = float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)) or 1.0

    def reach(self, least: float) -> float:
        """How far past a hyperplane a partner is looked for."""
        return distance(least) * min(1.0, SIGMAS / math.sqrt(max(self.dimensions, 1.0)))

    def encoded(self, v):
        """Home list, code bytes and decoding error of unit vectors."""
        import numpy as np

        home = _nearest(v, self.centres)
        rest = v - self.centres[home]
        codes = np.empty((len(v), len(self.stretches)), dtype=np.uint8)
        for k, s in enumerate(self.stretches):
            near = _nearest(rest[:, s], self.codes[k])
            codes[:, k] = near
            rest[:, s] -= self.codes[k][near]
        return home, codes, np.linalg.norm(rest, axis=1)

    def visits(self, v, home, reach: float):
        """(row, list) of the lists to look into, numbered above the home list: the other way round is the same pair."""
        import numpy as np

        c = self.centres
        norms = (c * c).sum(1)
        rows, lists = [], []
        for lo in range(0, len(v), 256):
            at = home[lo : lo + 256]
            far = norms - 2 * v[lo : lo + 256] @ c.T  # squared distances less one
            apart = np.sqrt(np.maximum(norms[at][:, None] + norms[None, :] - 2 * c[at] @ c.T, 0))
            margin = far - far[np.arange(len(at)), at][:, None]
            near = (margin <= 2 * apart * (reach + SLACK) + SLACK) & (np.arange(len(c))[None, :] > at[:, None])
            r, l = np.nonzero(near)
            rows.append(r + lo)
            lists.append(l)
        return np.concatenate(rows), np.concatenate(lists)

    def bounds(self, q, codes, errors, list_: int):
        """Lower bounds of the distances from each row of ``q`` to each member of a list."""
        import numpy as np

        rest = q - self.centres[list_]
        total = np.zeros((len(q), len(codes)), dtype=np.float32)
        for k, s in enumerate(self.stretches):
            part, code = rest[:, s], self.codes[k]
            table = (part * part).sum(1)[:, None] + (code * code).sum(1)[None, :] - 2 * part @ code.T
            total += table.astype(np.float32)[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0)) - errors[None, :].astype(np.float32)


def distance(least: float) -> float:
    """Largest distance of unit vectors with a cosine of ``least`` or more."""
    return math.sqrt(2 - 2 * least)


def _sized(model, least: float):
    """Members and visitors of each list, summed per batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = unit_rows(batch.column(0))
                home = _nearest(v, model.value.centres)
                _, visited = model.value.visits(v, home, model.value.reach(least))
                n = len(model.value.centres)
                members = np.bincount(home, minlength=n)
                visitors = members + np.bincount(visited, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(members), pa.array(visitors)], names=["list", "members", "visitors"]
                )

    return run


UNIT = ["list", "part", "visitor_part"]
SENT = "list int, part int, visitor_part int, visits boolean, home boolean, node long, n_rows long, v array<{element}>, codes binary, error double"


def _sent(model, least: float, parts, visitor_parts):
    """Each node to the parts of its home list as a member, and to the lists it looks into as a visitor.

    A long list is cut into parts of members and of visitors; a unit is one of each.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def spread(own, copies, kinds):
            """Row numbers repeated, with the number of each repeat."""
            times = copies[kinds]
            at = np.repeat(np.arange(len(kinds)), times)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            return own[at], kinds[at], nth, at

        for batch in batches:
            if not batch.num_rows:
                continue
            node, n_rows = (batch.column(k).to_numpy() for k in range(2))
            v = unit_rows(batch.column(2))
            home, codes, error = model.value.encoded(v)
            row, visited = model.value.visits(v, home, model.value.reach(least))
            every = np.arange(len(v))
            m_row, m_list, m_visitor_part, _ = spread(every, visitor_parts, home)
            v_row, v_list, v_part, _ = spread(np.concatenate([every, row]), parts, np.concatenate([home, visited]))
            rows = np.concatenate([m_row, v_row])
            lists = np.concatenate([m_list, v_list])
            visits = np.arange(len(rows)) >= len(m_row)
            raw = codes.tobytes()
            width = codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lists.astype(np.int32)),
                    pa.array(np.concatenate([node[m_row] % parts[m_list], v_part]).astype(np.int32)),
                    pa.array(np.concatenate([m_visitor_part, node[v_row] % visitor_parts[v_list]]).astype(np.int32)),
                    pa.array(visits),
                    pa.array(lists == home[rows]),
                    pa.array(node[rows]),
                    pa.array(n_rows[rows]),
                    batch.column(2).take(pa.array(rows)),
                    pa.array([b"" if away else raw[k * width : (k + 1) * width] for k, away in zip(rows, visits)], type=pa.binary()),
                    pa.array(error[rows]),
                ],
                names=["list", "part", "visitor_part", "visits", "home", "node", "n_rows", "v", "codes", "error"],
            )

    return run


FOUND = "node long, root long, n_links long"


def _linked(q, v, a, b, least: float):
    """Which of the candidate pairs have the cosine: dense blocks by one product, thin ones pair by pair."""
    import numpy as np

    if len(a) * 16 > len(q) * len(v):
        return (q @ v.T)[a, b] >= least
    keep = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), 1 << 14):
        cut = slice(lo, lo + (1 << 14))
        keep[cut] = np.einsum("ij,ij->i", q[a[cut]], v[b[cut]]) >= least
    return keep


class _Unit:
    """Members of one unit: counts of links, and for each the smallest node it is known to join."""

    def __init__(self, model, least: float, list_: int, v, codes, errors, node, n_rows):
        import numpy as np

        self.model, self.least, self.list = model, least, list_
        self.v, self.codes, self.errors, self.node, self.n_rows = v, codes, errors, node, n_rows
        self.root, self.n = node.copy(), np.zeros(len(node), dtype=np.int64)

    def meet(self, q, home, node, n_rows):
        """(node, root, n_links) of a pass of visitors, and (old root, new root, 0) of members."""
        import numpy as np

        low = self.model.bounds(q, self.codes, self.errors, self.list)
        a, b = np.nonzero(low <= distance(self.least) + BOUND_SLACK)
        # In the home list a pair is met from both ends; the visitor with the smaller node counts it.
        once = ~home[a] | (node[a] < self.node[b])
        a, b = a[once], b[once]
        keep = _linked(q, self.v, a, b, self.least)
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        n = np.zeros(len(node), dtype=np.int64)
        np.add.at(n, a, self.n_rows[b])
        np.add.at(self.n, b, n_rows[a])
        before, root = self.root.copy(), node.copy()
        while True:
            seen = self.root[b].sum(), root[a].sum()
            np.minimum.at(root, a, self.root[b])
            np.minimum.at(self.root, b, root[a])
            if seen == (self.root[b].sum(), root[a].sum()):
                break
        met = np.unique(a)
        moved = np.nonzero(before != self.root)[0]
        old_new = np.unique(np.stack([before[moved], self.root[moved]], 1), axis=0)
        return (
            np.concatenate([node[met], old_new[:, 0]]),
            np.concatenate([root[met], old_new[:, 1]]),
            np.concatenate([n[met], np.zeros(len(old_new), dtype=np.int64)]),
        )

    def counts(self):
        import numpy as np

        some = np.nonzero(self.n)[0]
        return self.node[some], self.node[some], self.n[some]


def _searched(model, least: float):
    """Links of every unit of a sorted partition, members ahead of visitors.

    Pairs are counted, not written: a node's links are a number, and what joins them is a row per
    node and change of root.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root", "n_links"])

        key, members, unit = None, [], None

        def gathered():
            columns = [np.concatenate([m[k] for m in members]) for k in range(5)]
            v, codes, errors, node, n_rows = columns
            return _Unit(model.value, least, key[0], v, codes, errors, node, n_rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)] + [batch.column(3).to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                this = tuple(keys[lo][:3])
                if this != key:
                    if unit is not None and unit.n.any():
                        yield batch_of(unit.counts())
                    key, members, unit = this, [], None
                for at in range(lo, hi, PASS):
                    part = batch.slice(at, min(PASS, hi - at))
                    node, n_rows = part.column(5).to_numpy(), part.column(6).to_numpy()
                    v = unit_rows(part.column(7))
                    if not keys[lo][3]:
                        codes = np.frombuffer(b"".join(part.column(8).to_pylist()), dtype=np.uint8).reshape(len(node), -1)
                        members.append((v, codes, part.column(9).to_numpy(), node, n_rows))
                        continue
                    if unit is None:
                        if not members:
                            continue
                        unit = gathered()
                    found = unit.meet(v, part.column(4).to_numpy(zero_copy_only=False), node, n_rows)
                    if found:
                        yield batch_of(found)
        if unit is not None and unit.n.any():
            yield batch_of(unit.counts())

    return run


def vector_links(nodes: DataFrame, width: int, count: int, least: float) -> DataFrame:
    """``node, root, n_links`` over distinct vectors (``node, n_rows, v``) of one width."""
    import numpy as np

    spark = nodes.sparkSession
    lists = max(1, min(LISTS, math.isqrt(count) // 2))
    size = max(1, min(max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists), SAMPLE_VALUES // width))
    sample = nodes.orderBy(F.xxhash64("v"), "node").select("v").limit(size).collect()
    model = spark.sparkContext.broadcast(Model(normed([r.v for r in sample]), lists))
    sizes = nodes.select("v").mapInArrow(_sized(model, least), "list int, members long, visitors long")
    # One row per list, at most LISTS.
    held = sizes.groupBy("list").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors")).collect()
    parts, visitor_parts = np.ones(lists, dtype=np.int64), np.ones(lists, dtype=np.int64)
    most = max(256, min(MEMBERS, MEMBER_VALUES // width))
    for r in held:
        parts[r.list] = max(1, -(-r.members // most))
        visitor_parts[r.list] = max(1, -(-r.visitors // VISITORS))
    element = nodes.schema["v"].dataType.elementType.simpleString()
    sent = nodes.select("node", "n_rows", "v").mapInArrow(_sent(model, least, parts, visitor_parts), SENT.format(element=element))
    units = sent.repartition(*UNIT).sortWithinPartitions(*UNIT, "visits")
    return units.mapInArrow(_searched(model, least), FOUND)


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """Per input row: vec_id, n_links, component_id (smallest linked id, its own included), kept.

    Rows whose vector is null, empty, zero or has null or non-finite parts link with nothing.
    Vectors of different lengths do not link; each length has its own index.  Equal vectors are
    one entry with a count, so copies cost nothing and link with one another.  Null ids take
    part; they never name a component unless it has no other id.  Repeated rows count as other
    vectors.  Other columns are left out.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    kind = df.schema[vector].dataType.elementType
    raw = column(vector) if isinstance(kind, FloatType) else column(vector).cast("array<double>")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    rows = df.select(column(id).alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), raw).alias("v"))
    usable = rows.where("v is not null")
    nodes = usable.groupBy("v").agg(F.count(F.lit(1)).alias("n_rows"), F.min("vec_id").alias("low"))
    nodes, _ = written(nodes.select(F.monotonically_increasing_id().alias("node"), "n_rows", "low", "v"), "vectors")
    widths = nodes.groupBy(F.size("v").alias("w")).count().orderBy("w").collect()
    found = None
    for w in widths:
        links = vector_links(nodes.where(F.size("v") == w["w"]), w["w"], w["count"], least)
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    found, _ = written(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "n_rows", "low").join(counts, "node", "left").join(joined, "node", "left")
    named = named.select(
        "node", "low", (F.col("n_rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    named, _ = written(named, "vector-groups")
    least_id = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = named.join(least_id, "component").select("node", "n_links", "component_id")
    of_vector = nodes.select("node", "v").join(known, "node").drop("node")
    placed = usable.join(of_vector, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle() -> str:
    return """
    WITH RECURSIVE rows_ AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    sound AS (SELECT * FROM rows_ WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM rows_ UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM rows_ JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""
