"""Greedy matching of event sites by blocks of space and time.

A block is a box of whole windows in days, rows of latitude and longitude.  Each site belongs to one
block and is copied to the few others within a window of it, so a block knows every pair of its own
sites.  Its pairs are found and settled in score order by one task: a pair of two own sites is booked
unless one of them waits; a pair that reaches a copied site cannot be decided here, so both its sites
wait, and with them the partners of their later pairs.  What is booked is therefore what the matching
over all pairs books.  Only sites that wait go on to the next turn, whose blocks lie elsewhere and are
larger, until nothing waits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from panelspark.operators.joins import lookup_join
from panelspark.session import written

EARTH_KM = 6371.0088
# Sites and (rough) pairs of one block that a task settles; fuller blocks wait for other turns.
BLOCK_SITES = 50_000
BLOCK_PAIRS = 4_000_000
# Sites that blocks give one task on average.
TASK_SITES = 100_000
# Rows of whole blocks that a task settles together, and pairs it looks at together.
CHUNK_ROWS = 60_000
CHUNK_PAIRS = 1_000_000
# Edges of a block in windows; the last one is a block of everything.
EVERYTHING = 2**30
SIZES = (4, 8, 16, 32, 64, 128, 256, 1024, 4096, EVERYTHING)
CELL = 4  # windows of a cell that loads are counted in; divides all sizes and offsets
TURNS = 12
BLOCK = ("__d", "__r", "__c")
SPENT = ("site_a", "site_b", "copies", "used_a", "used_b")


def _step(km: float) -> float:
    return math.degrees(km / EARTH_KM) * (1 + 1e-9)


def _day(days: int) -> Column:
    return F.floor(F.unix_date("date") / max(days, 1)).cast("long")


def _row(km: float) -> Column:
    return F.floor(F.col("latitude") / _step(km)).cast("long")


def _width(band: Column, size: Column, offset: Column, km: float) -> Column:
    """Longitude window of a band of rows, those beside it included, in degrees."""
    low = band * size - offset
    steep = F.least(F.lit(90.0), F.greatest(F.abs(low - 1), F.abs(low + size + 1)) * F.lit(_step(km)))
    half = F.lit(math.sin(km / EARTH_KM / 2)) / F.cos(F.radians(steep))
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), half))) * F.lit(1 + 1e-9)


def _blocks_around(width: Column, size: Column) -> Column:
    """Blocks along a band; one where there is no room for three."""
    n = F.floor(F.floor(F.lit(360.0) / width) / size).cast("long")
    return F.when(n < 3, F.lit(1).cast("long")).otherwise(n)


def _column(lon: Column, n: Column, shift: float) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n + F.lit(shift)).cast("long"), n)


def _at(number: Column, size: Column, offset: Column) -> Column:
    return F.floor((number + offset) / size).cast("long")


def _shift(turn: int) -> float:
    return (0.31 + turn * 0.618034) % 1.0


def _offset(size: int, turn: int) -> int:
    """Windows that the blocks of a turn are shifted by."""
    return size // 2 if size == EVERYTHING else int(size * _shift(turn)) // CELL * CELL


def _loads(sites: DataFrame, km: float, days: int, turn: int) -> DataFrame:
    """Sites and rough pairs of each block, for every size of block."""
    wide = CELL * _step(km)
    cells, _ = written(
        sites.groupBy(
            F.floor(_day(days) / CELL).alias("d"),
            F.floor(_row(km) / CELL).alias("r"),
            F.floor(F.col("longitude") / wide).alias("l"),
        ).agg(
            F.count_if(~F.col("__later")).cast("double").alias("a"),
            F.count_if(F.col("__later")).cast("double").alias("b"),
        ),
        "block-cells",
    )
    kinds = [F.struct(F.lit(s).cast("long").alias("size"), F.lit(_offset(s, turn)).cast("long").alias("off")) for s in SIZES]
    size, off = F.col("k.size"), F.col("k.off")
    around = _blocks_around(_width(F.col("__r"), size, off, km), size)
    return (
        cells.withColumn("k", F.explode(F.array(*kinds)))
        .withColumns({"__d": _at(F.col("d") * CELL, size, off), "__r": _at(F.col("r") * CELL, size, off)})
        .withColumn("__c", _column((F.col("l") + 0.5) * wide, around, _shift(turn)))
        .groupBy(size.alias("size"), *BLOCK)
        .agg(F.sum(F.col("a") + F.col("b")).alias("sites"), F.sum(F.col("a") * F.col("b")).alias("pairs"))
    )


def _over() -> Column:
    return (F.col("sites") > BLOCK_SITES) | (F.col("pairs") > BLOCK_PAIRS)


def _best_size(loads: DataFrame) -> Row | None:
    """The size that is likely to settle most sites: its blocks, how many are too full, and the sites of the others."""
    fits = F.when(~_over(), F.col("sites")).otherwise(0.0)
    found = loads.groupBy("size").agg(
        F.sum(fits).alias("fit"), F.sum("sites").alias("all"), F.count(F.lit(1)).alias("blocks"), F.count_if(_over()).alias("over")
    ).collect()
    best = max(found, key=lambda r: r["fit"] / r["all"] * (1 - 1 / r["size"]) ** 3, default=None)
    return best if best is not None and best["fit"] else None


def _placed(sites: DataFrame, km: float, days: int, size: int, turn: int) -> DataFrame:
    """Sites with their block, and their copies for the blocks within a window of them."""
    k, off, shift = F.lit(size).cast("long"), F.lit(_offset(size, turn)).cast("long"), _shift(turn)
    lon = F.col("longitude")

    def near(number: Column) -> Column:
        return F.explode(F.array_distinct(F.array(*[_at(number + d, k, off) for d in (-1, 0, 1)])))

    return (
        sites.withColumns({"__day": _day(days), "__row": _row(km)})
        .withColumn("__d", near(F.col("__day")))
        .withColumn("__r", near(F.col("__row")))
        .withColumn("__w", _width(F.col("__r"), k, off, km))
        .withColumn("__n", _blocks_around(F.col("__w"), k))
        .withColumn("__home", _column(lon, F.col("__n"), shift))
        .withColumn(
            "__c",
            F.explode(
                F.array_distinct(F.array(F.col("__home"), *[_column(lon + s * F.col("__w"), F.col("__n"), shift) for s in (-1, 1)]))
            ),
        )
        .withColumn(
            "__own",
            (F.col("__d") == _at(F.col("__day"), k, off)) & (F.col("__r") == _at(F.col("__row"), k, off)) & (F.col("__c") == F.col("__home")),
        )
        .drop("__day", "__home")
    )


def match_by_blocks(
    kept: DataFrame, incoming: DataFrame, km: float, days: int, levels: Sequence[str]
) -> tuple[list[DataFrame], DataFrame, DataFrame, int]:
    """Links that blocks settle, and the sites of both sides that still wait, with their number.

    Sites wait at the end only where more of them crowd a few windows than a task settles.
    """
    columns = [c for c in kept.columns if c != "dataset"]  # which the site names too
    kept, incoming = kept.select(*columns), incoming.select(*columns)
    sites = kept.withColumn("__later", F.lit(False)).unionByName(incoming.withColumn("__later", F.lit(True)))
    # A place that is no number is near nothing.
    sites = sites.where((F.abs("longitude") < float("inf")) & (F.abs("latitude") < float("inf")))
    links, waiting = [], None
    for turn in range(TURNS):
        loads, _ = written(_loads(sites, km, days, turn), "block-loads")
        best = _best_size(loads)
        if best is None:
            break
        size, aside = best["size"], None
        placed = _placed(sites, km, days, size, turn)
        if best["over"]:
            full = loads.where((F.col("size") == size) & _over()).select(*BLOCK)
            aside, _ = written(lookup_join(placed, full, BLOCK, "left_semi").where("__own").select(*sites.columns), "full-blocks")
            placed = lookup_join(placed, full, BLOCK, "left_anti")
        # Few tasks, as each starts Python and writes a file, but never less than the cluster has room for.
        room = 2 * sites.sparkSession.sparkContext.defaultParallelism
        tasks = min(best["blocks"], max(room, int(best["fit"]) // TASK_SITES))
        settled = _settled(placed, columns, km, days, levels, size, turn, tasks)
        settled, seen = written(settled, "blocks", waiting=F.count_if(F.col("copies").isNull()))
        links.append(settled.where("copies is not null").select(*SPENT))
        left = settled.where("copies is null").select(*sites.columns)
        before, waiting = waiting, seen["waiting"]
        if aside is not None:
            left = left.unionByName(aside)
            waiting += aside.count()
        sites = left
        if not waiting or (before is not None and waiting > 0.9 * before):
            break
    if waiting is None:
        waiting = sites.count()
    left = sites.withColumn("dataset", F.col("site.of"))
    return links, left.where("not __later").drop("__later"), left.where("__later").drop("__later"), waiting


def _settled(
    placed: DataFrame, columns: Sequence[str], km: float, days: int, levels: Sequence[str], size: int, turn: int, tasks: int
) -> DataFrame:
    """Blocks settled side by side: rows with ``copies`` are links, the others sites that wait."""
    shift = _shift(turn)
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    site = kinds["site"]
    schema = ", ".join(
        [f"site_a {site}", f"site_b {site}", "copies long", "used_a long", "used_b long", *[f"`{c}` {kinds[c]}" for c in [*columns, "__later"]]]
    )

    def run(batches):
        for table in _chunks(batches):
            yield from _settle_chunk(table, columns, km, days, levels, shift)

    return placed.repartition(tasks, *BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, schema)


def _chunks(batches):
    """Whole blocks together, at least ``CHUNK_ROWS`` rows as far as there are."""
    import numpy as np
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        ends = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in BLOCK]
        # The last block may go on in the next batch.
        open_from = int(np.flatnonzero(reduce(np.logical_or, [e != e[-1] for e in ends]))[-1]) + 1 if any((e != e[-1]).any() for e in ends) else 0
        if open_from:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, open_from)])
            held = [batch.slice(open_from)]
            rows = held[0].num_rows
        elif len(held) > 1:
            table = pa.Table.from_batches(held)
            cols = [table.column(c).to_numpy() for c in BLOCK]
            other = np.flatnonzero(reduce(np.logical_or, [c != c[-1] for c in cols]))
            if len(other):
                cut = int(other[-1]) + 1
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _codes(column, ordered: bool = False):
    """Integers that tell values apart, and order them if asked to; -1 for NULL."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = coded.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    at = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if not ordered or not len(coded.dictionary):
        return at
    place = np.empty(len(coded.dictionary) + 1, dtype=np.int64)
    place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    place[-1] = -1
    return place[at]


def _numbers(column, missing=0):
    import pyarrow.compute as pc

    return pc.fill_null(column, missing).to_numpy() if column.null_count else column.to_numpy()


def _site_order(site):
    """Place of each site in the order of its id and source."""
    import numpy as np
    import pyarrow as pa

    ids, of = site.field("id"), _codes(site.field("of"), ordered=True)
    if pa.types.is_integer(ids.type):
        keys = (of, _numbers(ids), np.asarray(ids.is_valid()))
    else:
        keys = (of, _codes(ids, ordered=True))
    order = np.lexsort(keys)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place


def _settle_chunk(table, columns, km, days, levels, shift):
    """Links of whole blocks and their sites that wait, as record batches."""
    import numpy as np
    import pyarrow as pa

    later = table.column("__later").to_numpy()
    own = table.column("__own").to_numpy()
    sides = [np.flatnonzero(~later), np.flatnonzero(later)]
    if not len(sides[0]) or not len(sides[1]):
        return
    site = table.column("site").combine_chunks()
    if isinstance(site, pa.ChunkedArray):
        site = pa.concat_arrays(site.chunks)
    free, used = _numbers(table.column("free")).astype(np.int64), _numbers(table.column("used")).astype(np.int64)
    a, b, score = _scored_pairs(table, sides, own, km, days, levels, shift)
    place = _site_order(site)
    order = np.lexsort((place[b], place[a], score))
    a, b = a[order], b[order]
    booked = _book(a, b, free, used, own)
    won_a, won_b, copies, used_a, used_b, waits = booked
    names = [*SPENT, *columns, "__later"]
    kinds = {c: table.schema.field(c).type for c in (*columns, "__later")}
    kinds |= {"site_a": site.type, "site_b": site.type, "copies": pa.int64(), "used_a": pa.int64(), "used_b": pa.int64()}
    if len(won_a):
        values = {"site_a": site.take(pa.array(won_a)), "site_b": site.take(pa.array(won_b))}
        values |= {"copies": pa.array(copies), "used_a": pa.array(used_a), "used_b": pa.array(used_b)}
        yield pa.RecordBatch.from_arrays([values.get(c, pa.nulls(len(won_a), kinds[c])) for c in names], names)
    left = np.flatnonzero(waits)
    if len(left):
        rest = table.select([*columns, "__later"]).take(pa.array(left))
        rest = rest.set_column(rest.schema.get_field_index("free"), "free", pa.array(free[left]))
        rest = rest.set_column(rest.schema.get_field_index("used"), "used", pa.array(used[left]))
        values = {c: pa.concat_arrays(rest.column(c).chunks) for c in rest.column_names}
        yield pa.RecordBatch.from_arrays([values.get(c, pa.nulls(len(left), kinds[c])) for c in names], names)


def _closer(values, gap):
    """The same order and steps, with no step above ``gap``; from 0 on."""
    import numpy as np

    kinds, at = np.unique(values, return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(kinds), gap))])[at]


def _scored_pairs(table, sides, own, km, days, levels, shift):
    """Pairs of the window with an own site that agree on some level: rows of both sides, and the score without the ids."""
    import numpy as np
    import pyarrow as pa

    lon, lat = table.column("longitude").to_numpy(), table.column("latitude").to_numpy()
    date, end = (table.column(c).cast(pa.int32()) for c in ("date", "enddate"))
    episode = end.is_valid().to_numpy()
    date, end = date.to_numpy().astype(np.int64), _numbers(end).astype(np.int64)
    labels = [_codes(table.column(c)) for c in levels]
    la, cos_la = np.radians(lat), np.cos(np.radians(lat))

    blocks = [table.column(c).to_numpy() for c in BLOCK]
    new = np.concatenate([[True], reduce(np.logical_or, [c[1:] != c[:-1] for c in blocks])])
    block, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    around, width = table.column("__n").to_numpy(), table.column("__w").to_numpy()
    whole = around == 1
    # Columns as wide as the window; a block that goes all around has its last column beside its first.
    ring = np.where(whole, np.maximum(np.floor(360.0 / width), 1), 2**40).astype(np.int64)
    west = (blocks[2] - shift) * (360.0 / around) - 180.0 - 2 * width
    col = np.where(
        whole,
        np.minimum(np.floor(np.mod(lon + 180.0, 360.0) / 360.0 * ring), ring - 1),
        np.floor(np.mod(lon - west, 360.0) / width),
    ).astype(np.int64)

    def inside(values, least=None):
        """Values from the block's smallest on."""
        low = np.minimum.reduceat(values, starts)
        if least is not None:
            low = np.where(least[starts], 0, low)
        return values - low[block]

    row, day = inside(table.column("__row").to_numpy()) + 1, inside(date) + days
    col = inside(col, whole) + 1
    rows, cols, span = int(row.max()) + 2, int(col.max()) + 2, int(day.max()) + 1 + days
    if (int(block[-1]) + 1) * rows * cols * span >= 2**62:
        # Gaps that no window reaches across are cut.
        row, day = _closer(row, 2) + 1, _closer(day, days + 1) + days
        rows, span = int(row.max()) + 2, int(day.max()) + 1 + days

    def key(of, row, col):
        return (((block[of] * rows + row) * cols) + col) * span

    kept, incoming = sides
    mine = key(kept, row[kept], col[kept]) + day[kept]
    at = np.argsort(mine, kind="stable")
    kept, mine = kept[at], mine[at]
    incoming = incoming[np.argsort(key(incoming, row[incoming], col[incoming]) + day[incoming], kind="stable")]
    out = [[], [], [], [], []]
    for down in (-1, 0, 1):
        for along in (-1, 0, 1):
            there = incoming
            if along:
                # With fewer than three columns the neighbours coincide.
                there = incoming[ring[incoming] > (1 if along > 0 else 2)]
            beside = np.where(whole[there], np.mod(col[there] - 1 + along, ring[there]) + 1, col[there] + along)
            there, beside = there[beside < cols], beside[beside < cols]
            base = key(there, row[there] + down, beside) + day[there]
            low = np.searchsorted(mine, base - days, "left")
            count = np.searchsorted(mine, base + days, "right") - low
            some = count > 0
            there, low, count = there[some], low[some], count[some]
            total = np.cumsum(count)
            begin = 0
            while begin < len(there):
                done = total[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(total, done + CHUNK_PAIRS, "right")))
                n = count[begin:stop]
                b = np.repeat(there[begin:stop], n)
                a = kept[np.repeat(low[begin:stop] - (total[begin:stop] - n - done), n) + np.arange(int(n.sum()))]
                begin = stop
                fits = (own[a] | own[b]) & (episode[a] == episode[b])
                fits &= ~episode[a] | (np.abs(end[a] - end[b]) <= days)
                a, b = a[fits], b[fits]
                apart = np.full(len(a), len(levels), dtype=np.int64)
                for label in labels:
                    apart -= (label[a] == label[b]) & (label[a] >= 0)
                fits = apart < len(levels)
                a, b, apart = a[fits], b[fits], apart[fits]
                h = np.sin((la[b] - la[a]) / 2) ** 2 + cos_la[a] * cos_la[b] * np.sin(np.radians(lon[b] - lon[a]) / 2) ** 2
                with np.errstate(invalid="ignore"):
                    far = 2 * EARTH_KM * np.arcsin(np.sqrt(h))
                fits = far <= km
                a, b, apart, far = a[fits], b[fits], apart[fits], far[fits]
                metres = np.floor(far * 1000 + 0.5).astype(np.int64)
                for held, part in zip(out, (a, b, apart, metres, np.abs(date[a] - date[b]))):
                    held.append(part)
    none = np.empty(0, dtype=np.int64)
    a, b, apart, metres, gap = (np.concatenate([none, *held]) for held in out)
    return a, b, (apart * (int(metres.max(initial=0)) + 1) + metres) * (days + 1) + gap


def _book(a, b, free, used, own):
    """Pairs in score order, each as far as copies are left; ``free`` and ``used`` are brought up to date.

    Pairs that are each other's best are booked together as long as that gets on, the rest one by one.
    """
    import numpy as np

    found = [[], [], [], [], []]
    best = np.empty(len(free), dtype=np.int64)
    while len(a):
        at = np.arange(len(a))
        # Written from the last to the first, a site keeps its best pair; no row is on both sides.
        best[a[::-1]] = at[::-1]
        best[b[::-1]] = at[::-1]
        won = np.flatnonzero((best[a] == at) & (best[b] == at) & own[a] & own[b])
        x, y = a[won], b[won]
        n = np.minimum(free[x], free[y])
        for held, part in zip(found, (x, y, n, used[x], used[y])):
            held.append(part)
        for side in (x, y):
            free[side] -= n
            used[side] += n
        live = (free[a] > 0) & (free[b] > 0)
        gone = len(a) - int(live.sum())
        a, b = a[live], b[live]
        if gone < 0.05 * (len(a) + gone):
            break
    waits = ~own
    late: list[list[int]] = [[], [], [], [], []]
    if len(a):
        # Only rows that still have pairs are looked up in lists.
        there, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, spent, wait = free[there].tolist(), used[there].tolist(), waits[there].tolist()
        for x, y in zip(where[: len(a)].tolist(), where[len(a) :].tolist()):
            if not left[x] or not left[y]:
                continue
            if wait[x] or wait[y]:
                wait[x] = wait[y] = True
                continue
            n = min(left[x], left[y])
            for held, part in zip(late, (x, y, n, spent[x], spent[y])):
                held.append(part)
            for side in (x, y):
                left[side] -= n
                spent[side] += n
        free[there], used[there], waits[there] = left, spent, wait
        late[0], late[1] = there[late[0]] if late[0] else [], there[late[1]] if late[1] else []
    none = np.empty(0, dtype=np.int64)
    done = [np.concatenate([none, *held, np.asarray(extra, dtype=np.int64)]) for held, extra in zip(found, late)]
    return *done, waits & own
