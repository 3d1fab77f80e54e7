"""Near-duplicate detection by MinHash with tensored banding.

A document is its set of word shingles.  Two small collections of ``HALVES`` hashes, each made of ``PER_HALF``
minhashes, are computed per distinct set; a table key is a pair, one hash from either
collection, so ``HALVES**2`` tables of ``2 * PER_HALF`` minhashes each cost only
``2 * HALVES * PER_HALF`` minhash computations.  With 14 and 3, sets at the threshold of 0.8 meet
in no table with probability 9e-5, at 0.85 with 3e-6.

1. Equal sets become one node.  Hashes that only one node has are dropped, so isolated
   documents send no keys at all.
2. In the tables of equal index, each bucket's members are compared with one centre, another one in each
   table: a bucket gives as many pairs as rows.  This joins nearly all groups.
3. In all tables, buckets whose members are all in one component already are done.  In the others
   every member of another component is compared with the bucket's best linked member.
4. Of buckets that are still mixed, small ones compare all members of different components;
   members of large ones go to an exact join on rare shingles (prefix and position filter), which skips pairs
   within a component.
Pairs are confirmed on the full sets, taken from the texts.

No step lists all pairs of a group, and no group has to fit one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, bound_batches, column, fresh
from panelspark.llm.components import components
from panelspark.session import written

HALVES = 14
PER_HALF = 3
SMALL_BUCKET = 8
# Members of one centre that one task confirms.
MEMBERS_PER_TASK = 500

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash_parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(94_101))
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


_MUL, _ADD = _hash_parameters(2 * HALVES * PER_HALF)


def words_of(text: str) -> list[str]:
    """Words after lower-casing A-Z only."""
    return WORD.findall(text.translate(_LOWER))


def shingles(text: str | None, width: int) -> set[tuple[str, ...]]:
    """Distinct shingles of ``width`` words; of fewer words the whole sequence is one; none without words."""
    words = words_of(text or "")
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*[words[k:] for k in range(width)]))


def shingle_hashes(found: set[tuple[str, ...]]) -> np.ndarray:
    """A 64-bit hash per shingle, sorted; the blank between words cannot occur inside one."""
    digests = b"".join([blake2b(" ".join(s).encode("utf-8", "surrogatepass"), digest_size=8).digest() for s in found])
    return np.sort(np.frombuffer(digests, dtype="<u8"))


def _halves(hashes: np.ndarray) -> np.ndarray:
    """The two collections: each entry mixes ``PER_HALF`` minhashes and its own place."""
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        block = hashes[at : at + 1024, None] * _MUL[None, :] + _ADD[None, :]
        block ^= block >> np.uint64(32)
        np.minimum(least, block.min(axis=0), out=least)
    out = np.arange(1, 2 * HALVES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in least.reshape(2 * HALVES, PER_HALF).T:
        out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.astype(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, halves = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                hashes = shingle_hashes(found)
                sizes.append(len(found))
                digest = blake2b(hashes.tobytes(), digest_size=8).digest()
                nodes.append(int.from_bytes(digest, "little", signed=True) if found else None)
                halves.append(_halves(hashes) if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(halves, pa.list_(pa.int64()))],
                ["row", "n_shingles", "node", "halves"],
            )

    return run


def _similar(a: set, b: set, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(width: int, percent: int):
    """Rows sorted by (centre, salt) with the centre's own text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, base = None, set()
        for batch in batches:
            a, b = [], []
            columns = (batch.column(k).to_pylist() for k in range(3))
            for at, node, text in zip(*columns):
                found = shingles(text, width)
                if node == at:
                    centre, base = at, found
                elif centre == at and _similar(base, found, percent):
                    a.append(at)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has (node, text).

    Texts move once to their nodes and once to the centres ``a`` they are compared with; a
    centre with many members is spread over tasks by a salt.
    """
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / MEMBERS_PER_TASK).cast("int")
    own = degrees.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = pairs.join(degrees, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    dealt = own.union(others).join(texts, "node").select("a", "node", "text", "salt", (F.col("a") == F.col("node")).alias("first"))
    n_parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n_parts, "a", "salt").sortWithinPartitions("a", "salt", F.desc("first"))
    return sorted_.select("a", "node", "text").mapInArrow(_confirm(width, percent), "a long, b long")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each bucket; rows (key, component, node) come sorted by key."""
    key, held = None, []

    def out(rows):
        a, b = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def cross(members):
        return [(min(x, y), max(x, y)) for k, (p, x) in enumerate(members) for q, y in members[:k] if p != q]

    for batch in batches:
        rows = []
        for k, c, node in zip(*(batch.column(j).to_pylist() for j in range(3))):
            if k != key:
                rows += cross(held)
                key, held = k, []
            held.append((c, node))
        yield out(rows)
    yield out(cross(held))


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, text in zip(*(batch.column(j).to_pylist() for j in range(3))):
                hashes = shingle_hashes(shingles(text, width)).astype(np.int64)
                n = len(hashes)
                filled = [pa.array(np.full(n, x, dtype=np.int64)) for x in (node, component, n)]
                yield pa.RecordBatch.from_arrays([*filled, pa.array(hashes)], ["node", "component", "n", "shingle"])

    return run


def _rare_pairs(texts: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact candidates among ``wanted`` (node, component): different components, a rare shingle in common.

    Of two sets this similar, the rarest shingles of each (one more than may be missing
    from the other) have one in common, rarity being counted among ``wanted``.
    """
    rows = wanted.join(texts, "node").select("node", "component", "text")
    rows = rows.mapInArrow(_shingle_rows(width), "node long, component long, n long, shingle long")
    rows, _ = written(rows, "shingle-rows")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = rows.join(counts, "shingle").withColumn("place", place).where((F.col("place") <= prefix) & (F.col("low") < F.col("high")))
    rare, _ = written(ranked.select("shingle", "node", "component", "n", "place"), "rare-shingles")
    # The longer set of a pair seeks, the shorter is found: its place has to leave room for what
    # both must share, which is more than a shingle that a whole crowd holds ever does.
    room = (F.col("n") - F.col("place") + 1) * (100 + percent) >= 2 * F.col("n") * percent
    x, y = rare.alias("x"), rare.where(room).alias("y")
    on = [
        F.col("x.shingle") == F.col("y.shingle"),
        (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))),
        F.col("x.component") != F.col("y.component"),
        F.col("y.n") * 100 >= F.col("x.n") * percent,
        # From here on the sets can share no more than what is left of the shorter rest.
        (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent,
    ]
    return x.join(y, on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _table_rows(halves: DataFrame, *also: str) -> DataFrame:
    """One row per node and table: every pair of a hash of either collection."""
    tables = halves.select("node", *also, F.explode("first").alias("p"), "second").select("node", *also, "p", F.explode("second").alias("q"))
    return tables.select("node", *also, F.xxhash64("p.value", "q.value").alias("key"), (F.col("q.place") - F.col("p.place") == HALVES).alias("diagonal"))


def _mixed(keyed: DataFrame) -> DataFrame:
    """Buckets that hold several components, with the lowest and highest of them and the size ``n``."""
    range_ = [F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")]
    return keyed.groupBy("key").agg(*range_).where("low < high")


def node_components(nodes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, component`` for every node with a link; ``nodes`` has (node, row, halves), ``rows`` (row, text)."""
    n_parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half = nodes.select("node", F.posexplode("halves").alias("place", "value"))
    shared = half.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    # At most 2 * HALVES entries per node.
    found = half.join(shared, "value").groupBy("node").agg(F.collect_list(F.struct("place", "value")).alias("h"))
    first, second = F.filter("h", lambda x: x["place"] < HALVES), F.filter("h", lambda x: x["place"] >= HALVES)
    halves = found.select("node", first.alias("first"), second.alias("second")).where("size(first) > 0 and size(second) > 0")
    halves, _ = written(halves, "shared-halves")
    # Only these nodes can be in a pair, so only their texts move again; repeated rows give one text.
    once = rows.groupBy("row").agg(F.first("text").alias("text"))
    texts = halves.select("node").join(nodes.select("node", "row"), "node").join(once, "row").select("node", "text")
    texts, _ = written(texts, "candidate-texts")

    # Another centre in every bucket, so that a group is compared with several.
    diagonal = _table_rows(halves).where("diagonal").select("node", "key")
    centre = F.min_by("node", F.xxhash64("node", "key")).alias("a")
    centres = diagonal.groupBy("key").agg(centre, F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    stars = diagonal.join(centres, "key").where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    pairs, _ = written(stars.distinct(), "star-pairs")
    links, _ = written(confirmed(pairs, texts, width, percent), "star-links")
    groups, _ = written(components(links), "star-groups")

    # What is still apart meets the best linked member of each of its buckets.
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    placed = halves.join(groups, "node", "left").join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node", "left")
    placed = placed.withColumns({"component": F.coalesce("component", "node"), "degree": F.coalesce("degree", F.lit(0))})
    keyed = _table_rows(placed, "component", "degree").drop("diagonal")
    open_, _ = written(keyed.join(_mixed(keyed), "key").select("key", "node", "component", "degree"), "mixed-buckets")
    hub = F.max_by(F.struct("node", "component"), F.struct("degree", F.xxhash64("node", "key"))).alias("hub")
    apart = open_.join(open_.groupBy("key").agg(hub), "key").where("component <> hub.component")
    pairs2 = apart.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    pairs2, _ = written(pairs2.join(pairs, ["a", "b"], "left_anti"), "hub-pairs")
    links2, _ = written(confirmed(pairs2, texts, width, percent), "hub-links")
    links, _ = written(links.union(links2), "links")
    groups, _ = written(components(links), "hub-groups")

    # The rest: all pairs across components in small buckets, an exact join for members of large ones.
    keyed = open_.select("key", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_, _ = written(keyed.join(_mixed(keyed), "key").select("key", "component", "node", "n"), "open-buckets")
    few = open_.where(f"n <= {SMALL_BUCKET}").select("key", "component", "node").repartition(n_parts, "key").sortWithinPartitions("key")
    many = open_.where(f"n > {SMALL_BUCKET}").select("node", "component").distinct()
    more = few.mapInArrow(_across, "a long, b long").union(_rare_pairs(texts, many, width, percent)).distinct()
    more = more.join(pairs.union(pairs2), ["a", "b"], "left_anti")
    more, seen = written(more, "rest-pairs", rows=F.count(F.lit(1)))
    if not seen["rows"]:
        return groups
    links3, _ = written(confirmed(more, texts, width, percent), "rest-links")
    return components(links.union(links3))


def grouped(df: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """Per input row: ``id, row, n_shingles, component``; the component is null without words.

    ``row`` is a key of id and text: repeated rows share it.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.xxhash64(column(id), column(text)).alias("row"), column(text).alias("text"))
    signed = rows.mapInArrow(_signatures(width), "row long, n_shingles long, node long, halves array<long>")
    ids = df.select(column(id).alias("id"), F.xxhash64(column(id), column(text)).alias("row")).distinct()
    signed, _ = written(signed, "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("halves").alias("halves"))
    nodes, _ = written(nodes, "nodes")
    linked = node_components(nodes, rows, width, percent)
    out = signed.select("row", "n_shingles", "node").join(linked, "node", "left")
    out = out.select("row", "n_shingles", F.coalesce("component", "node").alias("component"))
    return out.join(ids, "row")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (smallest linked id, its own included), kept.

    Texts without words (null, empty, blank) have an empty set and no link.  Equal texts of any
    ids are linked.  Repeated rows are all returned, all kept if their id is the smallest.
    Null ids take part; they never name a component unless it has no other id.  Other
    columns are left out.  An empty table gives an empty result.
    """
    rows, _ = written(grouped(df, id, text, width, percent), "grouped")
    least = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    named = rows.join(least, "component", "left")
    component_id = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return named.select(
        F.col("id").alias("doc_id"), "n_shingles", component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept")
    )


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id, with the columns of ``df``.

    Texts without words are linked with nothing and all stay.  Of rows with equal id and
    text one stays; of different texts with the smallest id, one by a fixed hash order.
    """
    key = fresh(df, "row_key")
    rows, _ = written(grouped(df, id, text, width, percent), "grouped")
    best = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("best")
    picks = rows.where("component is not null").groupBy("component").agg(best).select(F.col("best.row").alias(key))
    worded = F.coalesce(column(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = df.withColumn(key, F.xxhash64(column(id), column(text)))
    one = keyed.where(worded).join(picks, key, "left_semi").dropDuplicates([key]).drop(key)
    return one.unionByName(df.where(~worded))
