"""Benchmark decontamination by greedy string tiling.

Windows of ``MIN_MATCH`` tokens that a document shares with a benchmark item are seeds.  For every item with
a seed the longest unmarked common runs are marked again and again, found by
Karp-Rabin hashes of token windows and checked token by token, until none of the least length is
left.  Tiles may lie in any order, so a passage with its sentences moved about still counts.  A document is
contaminated by an item if tiles cover enough of the item's tokens.

Where that is not enough, the search length steps down to 3 and then 2 tokens, within a stretch
of the document about as long as the item around its longest tile, so that sentences shorter
than a seed are found in another order too, and chance pairs all over a long text are not.  Items
of up to ``SHORT_ITEM`` tokens need no seed of ``MIN_MATCH`` tokens for that, one of 3 is enough.

Blocks of the benchmark of bounded size are broadcast, a few in each pass over the documents; what
a pass finds is written before the next one, so that only one pass's blocks are held.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, column, fresh
from panelspark.session import written

TOKEN = re.compile(r"[^\W_]+")
MIN_MATCH = 5
MIN_COVERAGE = 50  # percent of an item's tokens
# A shorter item may be hinted at by a shorter window; items up to the second length are stepped down to these lengths.
SHORT_ITEM, STEPPED_ITEM, SHORTER = 32, 4096, (3, 2)
PAIRS = 1 << 18  # pairs of windows looked at in one go
# Characters of benchmark text that one broadcast holds, and broadcasts of one pass over the documents.
BLOCK_CHARS, PASS_BLOCKS = 8_000_000, 2

_BASE = np.uint64(0xD1342543DE82EF95)


def tokens(text: str | None) -> list[str]:
    """Letter and digit runs in lower case; marks and underscores only separate."""
    return TOKEN.findall((text or "").lower())


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` token numbers, one rolled step per position of a window."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = (ids.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(31)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out = out * _BASE + value[k : k + n]
    return out


class Block:
    """Items of the benchmark: vocabulary, token numbers end to end, and all seed windows in order of their hash."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int, shorter: tuple[int, ...] = SHORTER):
        self.shorter = shorter
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        windows: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            words = tokens(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64)
            # An item shorter than the least match has to be found whole.
            length = min(min_match, len(ids))
            windows[length].append((window_hashes(ids, length), len(self.items)))
            if shorter and length < len(ids) <= SHORT_ITEM:
                windows[shorter[0]].append((window_hashes(ids, shorter[0]), len(self.items)))
            self.items.append((item_id, ids, length))
        self.tokens = np.concatenate([i for _, i, _ in self.items]) if self.items else np.zeros(0, dtype=np.int64)
        self.begins = np.cumsum([0] + [len(i) for _, i, _ in self.items])
        self.seeds = {}
        for length, found in windows.items():
            values = np.concatenate([h for h, _ in found])
            owners = np.concatenate([np.full(len(h), k, dtype=np.int64) for h, k in found])
            places = np.concatenate([np.arange(len(h)) for h, _ in found])
            order = np.argsort(values, kind="stable")
            self.seeds[length] = values[order], owners[order], places[order]


def run_starts(doc: np.ndarray, length: int, seeds, flat: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document positions, owners, item positions) at which common runs begin, a bounded number of pairs at a time.

    A pair of windows one step behind another pair belongs to that pair's run and is left out, so
    repetitive texts have as many starts as they have diagonals, not a product of positions.
    """
    values, owners, places = seeds
    hashes = window_hashes(doc, length)
    if not len(hashes) or not len(values):
        return
    first = np.searchsorted(values, hashes)
    hits = np.flatnonzero(values[np.minimum(first, len(values) - 1)] == hashes)
    counts = np.searchsorted(values, hashes[hits], side="right") - first[hits]
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(hits):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = counts[lo:hi]
        d = np.repeat(hits[lo:hi], n)
        at = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[hits[lo:hi]], n)
        owner, t = owners[at], places[at]
        inner = (d > 0) & (t > 0)
        inner &= doc[d - 1] == flat[begins[owner] + t - 1]
        yield d[~inner], owner[~inner], t[~inner]
        lo = hi


def _run_length(doc: np.ndarray, d: int, item: np.ndarray, t: int) -> int:
    """Length of the common run that begins at ``d`` and ``t``."""
    n, step, most = 0, 32, min(len(doc) - d, len(item) - t)
    while n < most:
        same = doc[d + n : d + min(n + step, most)] == item[t + n : t + min(n + step, most)]
        if not same.all():
            return n + int(same.argmin())
        n, step = min(n + step, most), 2 * step
    return n


def tile(doc: np.ndarray, item: np.ndarray, starts, least: int, free_d: np.ndarray, free_t: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length), longest first; marks them as no longer free.

    The longest common run of free tokens is marked again and again, the earlier in the document first.
    A run that marks have cut goes back as its free stretches.
    """
    heap = [(-n, d, t) for d, t in starts if (n := _run_length(doc, d, item, t)) >= least]
    heapify(heap)
    tiles: list[tuple[int, int, int]] = []
    left = int(free_t.sum())
    while heap and left:
        n, d, t = heappop(heap)
        n = -n
        free = free_d[d : d + n] & free_t[t : t + n]
        if free.all():
            free_d[d : d + n] = False
            free_t[t : t + n] = False
            tiles.append((d, t, n))
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin >= least:
                heappush(heap, (begin - end, d + begin, t + begin))
    return tiles


def _shorter(
    doc: np.ndarray, item: np.ndarray, tiles: list[tuple[int, int, int]], centre: int, free_t: np.ndarray, lengths: tuple[int, ...]
) -> list[tuple[int, int, int]]:
    """Further tiles of fewer tokens, in a stretch of the document about as long as the item, around ``centre``.

    They catch an item whose sentences are shorter than a seed and stand in another order.
    """
    lo, hi = max(0, centre - len(item)), min(len(doc), centre + 2 * len(item))
    near = doc[lo:hi]
    free_d = np.ones(len(near), dtype=bool)
    free_t = free_t.copy()
    out = []
    for d, t, n in tiles:
        if d < hi and d + n > lo:
            free_d[max(0, d - lo) : d + n - lo] = False
            out.append((d, t, n))
        else:
            free_t[t : t + n] = True
    for least in lengths:
        values = window_hashes(item, least)
        order = np.argsort(values, kind="stable")
        seeds = values[order], np.zeros(len(values), dtype=np.int64), order
        starts = [x for d, _, t in run_starts(near, least, seeds, item, np.array([0])) for x in zip(d.tolist(), t.tolist())]
        found = tile(near, item, starts, least, free_d, free_t)
        out += [(d + lo, t, n) for d, t, n in found]
        if not found and not out:
            break
    return out


def contamination(text: str | None, block: Block, min_coverage: int) -> list[tuple[int, int, int, int]]:
    """(item_id, covered tokens, item tokens, tiles) for each item covered enough."""
    words = tokens(text)
    if not words:
        return []
    doc = np.fromiter((block.vocabulary.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    hinted: dict[int, int] = {}
    for length, seeds in block.seeds.items():
        for ds, owners, ts in run_starts(doc, length, seeds, block.tokens, block.begins):
            for d, k, t in zip(ds.tolist(), owners.tolist(), ts.tolist()):
                if length == block.items[k][2]:
                    found[k].append((d, t))
                hinted.setdefault(k, d)
    out = []
    for k in hinted:
        item_id, item, least = block.items[k]
        free_d, free_t = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
        tiles = tile(doc, item, found.get(k, []), least, free_d, free_t)
        covered = sum(n for _, _, n in tiles)
        if block.shorter and 100 * covered < min_coverage * len(item) and least < len(item) <= STEPPED_ITEM:
            # The longest tile, or the first short seeds, say where the item may stand.
            places = [tiles[0][0]] if tiles else _places(doc, item, block.shorter[0])
            for at in places:
                more = _shorter(doc, item, tiles, at, free_t, block.shorter)
                if (n := sum(x for _, _, x in more)) > covered:
                    covered, tiles_n = n, more
                    if 100 * covered >= min_coverage * len(item):
                        tiles = tiles_n
                        break
        if 100 * covered >= min_coverage * len(item):
            out.append((item_id, covered, len(item), len(tiles)))
    return sorted(out, key=lambda x: (x[0] is None, x))


def _places(doc: np.ndarray, item: np.ndarray, length: int) -> list[int]:
    """Where in a document a short item may stand: the first short seed of each stretch as long as the item."""
    values = np.unique(window_hashes(item, length))
    hits = np.flatnonzero(np.isin(window_hashes(doc, length), values)).tolist()
    out: list[int] = []
    for d in hits:
        if not out or d >= out[-1] + len(item):
            out.append(d)
    return out


def blocks_of(benchmark: DataFrame, id: str, text: str, min_match: int, block_chars: int, shorter: tuple[int, ...] = SHORTER) -> Iterator[Block]:
    """The benchmark in parts of bounded size, one at a time on the driver.

    Items are dealt by a hash; an item above the bound is a block of its own, as any document is one text.
    """
    items = benchmark.select(column(id).alias("item_id"), column(text).alias("text")).where("text is not null").distinct()
    long = F.length("text") > block_chars
    for r in items.where(long).orderBy("item_id", F.xxhash64("text")).toLocalIterator():
        yield Block([(r["item_id"], r["text"])], min_match, shorter)
    items = items.where(~long)
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()
    n = -(-2 * size["n"] // block_chars) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Block([(r["item_id"], r["text"]) for r in part.collect()], min_match, shorter)


def _passes(spark, blocks: Iterator[Block], size: int) -> Iterator[tuple[list, bool]]:
    """Broadcasts of a few blocks at a time, and whether they are the last; others go when the next ones are asked for."""
    group = list(islice(blocks, size))
    while group:
        held = [spark.sparkContext.broadcast(block) for block in group]
        group = list(islice(blocks, size))
        yield held, not group
        for shared in held if group else ():
            shared.destroy()


def _found(held, min_coverage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hits = [(k, *hit) for shared in held for k, text in enumerate(texts) for hit in contamination(text, shared.value, min_coverage)]
            rows, *rest = zip(*hits) if hits else ((),) * 5
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "covered", "item_tokens", "tiles"])

    return run


def _leaked(text: Column, held, min_coverage: int) -> Column:
    """Whether an item of the blocks contaminates a text."""

    @F.pandas_udf("boolean")
    def leaked(texts):
        return texts.map(lambda t: any(contamination(t, shared.value, min_coverage) for shared in held), na_action=None).astype(bool)

    return leaked(text)


def find_leaks(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, min_coverage: int = MIN_COVERAGE, block_chars: int = BLOCK_CHARS, shorter: tuple[int, ...] = SHORTER) -> DataFrame:
    """One row per contaminated row of ``df`` and benchmark item.

    ``doc_id, item_id, covered, item_tokens, tiles, coverage_percent``.  Ids are integers.
    Null and empty texts on either side match nothing; null ids pass through; repeated rows
    are reported each; repeated items once.  Empty tables give an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(column(id).cast("long").alias("doc_id"), column(text).alias("text"))
    schema = "doc_id long, item_id long, covered long, item_tokens long, tiles long"
    found = []
    for held, last in _passes(spark, blocks_of(benchmark, item_id, item_text, min_match, block_chars, shorter), PASS_BLOCKS):
        hits = rows.mapInArrow(_found(held, min_coverage), schema)
        found.append(hits if last else written(hits, "leaks")[0])
    return reduce(DataFrame.unionAll, found).withColumn("coverage_percent", F.expr("100 * covered div item_tokens"))


def without_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", min_match: int = MIN_MATCH, min_coverage: int = MIN_COVERAGE, item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df`` that no benchmark item contaminates, with the columns of ``df``.

    A benchmark of one pass filters the rows where they are.  Earlier passes of a larger one leave
    the digests of what they found, which the last one's rows are held against.
    """
    spark = df.sparkSession
    bound_batches(spark)
    digest, theirs = F.md5(F.coalesce(column(text), F.lit(""))), fresh(df, "leaked_digest")
    flag, gone, out = fresh(df, "leaked"), [], df
    for held, last in _passes(spark, blocks_of(benchmark, item_id, item_text, min_match, block_chars), PASS_BLOCKS):
        flagged = df.withColumn(flag, _leaked(column(text), held, min_coverage))
        if last:
            out = flagged.where(~F.col(flag)).drop(flag)
        else:
            gone.append(written(flagged.where(flag).select(digest.alias(theirs)).distinct(), "leaked")[0])
    return out.join(reduce(DataFrame.unionAll, gone), digest == F.col(theirs), "left_anti") if gone else out
