"""Event feeds: harmonise, classify, integrate across sources, count.

Integration (``integrate``)
---------------------------
Sources are ranked; an entry of a later source that reports the same event as an
entry of an earlier one is a duplicate.  Two entries may match when

* they come from different sources,
* start (and, for episodes, end) dates differ by at most ``days``,
* they lie within ``km`` great-circle kilometres,
* their categories agree on at least one level of the taxonomy.

An episode (end date after start date) matches episodes only.  The score of a pair
is (taxonomy levels apart, metres, days, entry of the earlier source, entry of the
later source), lower is better.  Each entry takes part in at most one match per
source pair: the best pair overall is matched, both leave, and so on.  That equals
repeating "match all pairs that are each other's best" until none is left.

Entries alike in source, category, dates and place are *copies*.  They score alike,
so they are handled as one *site* with a count: two sites that are each other's best
match as many copies as the smaller one has, in rank order.  A site that holds a
third of all entries is thus one row while matching; its copies are ranked in
chunks and never sit in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.dates import parse_date
from panelspark.functions.nulls import as_column
from panelspark.operators.blocks import EARTH_KM, match_by_blocks
from panelspark.operators.graph import components
from panelspark.operators.joins import lookup_join, shuffled, sized, split_join
from panelspark.session import written

# Sites of both sides up to which pairs are found by joins; more are settled by blocks first.
JOINED_SITES = 200_000
# Pairs of one component that a task settles; larger components go through rounds first.
COMPONENT_PAIRS = 50_000
# Pairs of one window above which the score is walked through in tiers, however few pairs there are in all.
WINDOW_PAIRS = 1_000_000
# Incoming sites around a bucket above which its kept sites go through the tiers.
CROWD_PARTNERS = 64
# Sites of one bucket that a task joins.
BUCKET_SITES = 100_000
# Copies of one link that are spelled out at a time.
LINK_CHUNK = 65_536
SITE = ("dataset", "base_category", "date", "enddate", "longitude", "latitude")
COPY_CHUNKS = 3  # hex digits of the entry's hash: 4096 chunks per site
# Entries of a bucket of sites above which its sites are ranked in chunks, and number of buckets.
BUCKET_COPIES = 200_000
COPY_BUCKETS = 2**16


def harmonise(
    feed: DataFrame,
    dataset: str,
    category: Column | str,
    date: str,
    longitude: str,
    latitude: str,
    enddate: str | None = None,
    date_format: str = "yyyy-MM-dd",
    event_id: str = "event_id",
) -> DataFrame:
    """One feed in the common form."""
    end = F.lit(None).cast("date") if enddate is None else parse_date(enddate, date_format)
    return feed.select(
        F.col(event_id).alias("event_id"),
        F.lit(dataset).alias("dataset"),
        as_column(category).cast("string").alias("base_category"),
        parse_date(date, date_format).alias("date"),
        end.alias("enddate"),
        F.col(longitude).alias("longitude"),
        F.col(latitude).alias("latitude"),
    )


def split_by_measure(
    category: Column | str, measure: Column | str, target: str, positive: str, zero: str
) -> Column:
    """Split one category by whether a measure is above zero; unknown measures keep it."""
    c, m = as_column(category), as_column(measure)
    return (
        F.when((c == target) & (m > 0), positive).when((c == target) & (m < 1), zero).otherwise(c)
    )


def classify(events: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Attach the category hierarchy by source and category."""
    return lookup_join(events, taxonomy, ["dataset", "base_category"])


def location_days(
    events: DataFrame, where: Column, date: str = "date", extra: Sequence[str] = ()
) -> DataFrame:
    """Events of one class collapsed to a row per day and location."""
    return (
        events.where(where & F.col("latitude").isNotNull())
        .groupBy(date, "latitude", "longitude", *extra)
        .agg(F.count(F.lit(1)).alias("events"))
    )


def _km(a_lon: str, a_lat: str, b_lon: str, b_lat: str) -> Column:
    la, lb = F.radians(a_lat), F.radians(b_lat)
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(
        F.sin(F.radians(F.col(b_lon) - F.col(a_lon)) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


BUCKET = ("__day", "__row", "__col")


def _columns_of(row: Column, km: float) -> Column:
    """Longitude buckets of a bucket row, as wide as the window at its latitude nearest the pole.

    The width is a function of the row alone, so both sides of a pair agree on it.  A row within one
    step of a pole becomes a single bucket.
    """
    lat_step = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    steep = F.least(F.lit(90.0), F.greatest(F.abs(row + 2), F.abs(row - 1)) * F.lit(lat_step))
    half = F.lit(math.sin(km / EARTH_KM / 2)) / F.cos(F.radians(steep))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), half))) * F.lit(1 + 1e-9)
    return F.greatest(F.lit(1), F.least(F.floor(F.lit(360.0) / width), F.lit(10**7))).cast("long")


def _column_at(lon: Column, row: Column, km: float) -> Column:
    n = _columns_of(row, km)
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)


def _row_at(km: float) -> Column:
    return F.floor(F.col("latitude") / (math.degrees(km / EARTH_KM) * (1 + 1e-9))).cast("long")


def _day_at(days: int) -> Column:
    return F.floor(F.unix_date("date") / max(days, 1)).cast("long")


def _bucketed(sites: DataFrame, km: float, days: int) -> DataFrame:
    """Sites with their space-time bucket, which is as large as the window."""
    return sites.withColumns({"__day": _day_at(days), "__row": _row_at(km)}).withColumn(
        "__col", _column_at(F.col("longitude"), F.col("__row"), km)
    )


def _neighbours(sites: DataFrame, km: float, days: int) -> DataFrame:
    """Sites once for each bucket in which a partner can be: their own and the adjacent ones."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        sites.withColumn("__row", F.explode(F.transform(near, lambda d: _row_at(km) + d)))
        .withColumn("__n", _columns_of(F.col("__row"), km))
        # With fewer than three columns the neighbours coincide.
        .withColumn(
            "__col",
            F.explode(
                F.array_distinct(
                    F.transform(
                        near,
                        lambda d: F.pmod(_column_at(F.col("longitude"), F.col("__row"), km) + d, F.col("__n")),
                    )
                )
            ),
        )
        .withColumn("__day", F.explode(F.transform(near, lambda d: _day_at(days) + d)))
        .drop("__n")
    )


def candidate_pairs(
    earlier: DataFrame,
    later: DataFrame,
    km: float,
    days: int,
    levels: Sequence[str],
    metres: tuple[int, int | None] = (-1, None),
    level: int | None = None,
    hot: bool = True,
) -> DataFrame:
    """Site pairs inside the space-time window that agree on some taxonomy level.

    Sites fall into buckets as large as the window, so a partner is in the same or
    an adjacent bucket.  The later side is copied to its 27 neighbours and the rest
    is an equi join, with ``hot`` buckets split.  ``metres`` (above, up to)
    and ``level`` narrow the pairs to one tier of the score; sites then also meet on a
    label they share, so crowded sites of unrelated categories are never compared.
    """
    left = _bucketed(earlier, km, days).select(*BUCKET, *[F.col(c).alias(f"a_{c}") for c in earlier.columns])
    right = _neighbours(later, km, days).select(*BUCKET, *[F.col(c).alias(f"b_{c}") for c in later.columns])
    keys = list(BUCKET)
    if level is not None:
        left = left.select("*", _shared_labels([f"a_{c}" for c in levels], level))
        right = right.select("*", _shared_labels([f"b_{c}" for c in levels], level))
        keys.append("__label")
    pairs = split_join(left, right, keys, rows_per_task=BUCKET_SITES) if hot else left.join(shuffled(right), keys)
    if level:
        # Met on their coarsest shared label only, so a pair comes once.
        coarser = [
            (F.col("__label.level") < j) & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) & F.col(f"a_{c}").isNotNull()
            for j, c in enumerate(levels)
        ]
        pairs = pairs.where(~reduce(lambda a, b: a | b, coarser))
    apart = reduce(
        lambda a, b: a + b,
        [F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 0).otherwise(1) for c in levels],
    )
    gap = F.abs(F.datediff("a_date", "b_date"))
    end_gap = F.abs(F.datediff("a_enddate", "b_enddate"))
    same_kind = (F.col("a_enddate").isNull() & F.col("b_enddate").isNull()) | (end_gap <= days)
    distance = _km("a_longitude", "a_latitude", "b_longitude", "b_latitude")
    return (
        pairs.where(same_kind & (gap <= days))
        .withColumns({"levels": apart, "__km": distance})
        .withColumn("metres", F.round(F.col("__km") * 1000).cast("long"))
        .where((F.col("__km") <= km) & (F.col("metres") > metres[0]))
        .where(F.lit(True) if metres[1] is None else F.col("metres") <= metres[1])
        .where(F.col("levels") < len(levels) if level is None else F.col("levels") == level)
        .select(
            F.col("a_site").alias("site_a"),
            F.col("b_site").alias("site_b"),
            F.col("levels").cast("int").alias("levels"),
            "metres",
            gap.cast("int").alias("days"),
            F.col("a_free").alias("free_a"),
            F.col("b_free").alias("free_b"),
            F.col("a_used").alias("used_a"),
            F.col("b_used").alias("used_b"),
        )
    )


def _shared_labels(labels: Sequence[str], level: int) -> Column:
    """Join tags of a site: all labels at once where all must agree, else each one."""
    if level == 0:
        tags = [F.struct(F.lit(-1).alias("level"), F.concat_ws("|", *labels).alias("name"))]
    else:
        tags = [F.struct(F.lit(j).alias("level"), F.col(c).alias("name")) for j, c in enumerate(labels)]
    return F.explode(F.array(*tags)).alias("__label")


def match_sites(pairs: DataFrame, most: int = COMPONENT_PAIRS) -> DataFrame:
    """Greedy one-to-one matching of copies over scored site pairs.

    Pairs that no chain of shared sites links have nothing to do with one another.  Each
    connected component is therefore settled on its own, in score order, components side by
    side; a long chain of pairs that wait for each other takes one step of one component.  A
    component of more than ``most`` pairs first goes through rounds: pairs that are each other's
    best book as many copies as both still have, exhausted sites drop out, and what is left
    falls apart into smaller components.  Both ways are the same matching: pairs in score
    order, each as far as copies are left.  Every step is written to the shared folder.

    Returns ``site_a, site_b, copies, used_a, used_b``; ``used`` is the number of
    copies already spent on either side before this match.
    """
    out = ["site_a", "site_b", "copies", "used_a", "used_b"]
    live, seen = written(pairs, "pairs", open=F.count(F.lit(1)))
    booked = []
    while seen["open"]:
        ends = live.select(_node("a").alias("a"), _node("b").alias("b"))
        parts = components(ends, seen["open"])
        grouped = live.withColumn("__node", _node("a")).join(shuffled(parts.withColumnRenamed("node", "__node")), "__node").drop("__node")
        giants = None
        if seen["open"] > most:
            grouped, _ = written(grouped, "grouped-pairs")
            sizes = grouped.groupBy("root").count().where(F.col("count") > most).select("root")
            giants, found = written(sizes, "giants", rows=F.count(F.lit(1)))
            giants = giants if found["rows"] else None
        if giants is not None:
            giant_pairs = split_join(grouped, giants, ["root"], "left_semi").drop("root")
            grouped = split_join(grouped, giants, ["root"], "left_anti")
        ordered = (
            grouped.withColumns({f"{side}_key": F.to_json(f"site_{side}") for side in "ab"})
            .repartition("root")
            .sortWithinPartitions("root", "levels", "metres", "days", "site_a", "site_b")
        )
        booked.append(written(ordered.mapInPandas(_settle, live.withColumn("copies", F.lit(0).cast("long")).select(*out).schema), "settled")[0])
        if giants is None:
            break
        state, seen = written(_round(giant_pairs), "round", open=F.count_if(F.col("copies") == 0))
        booked.append(state.where("copies > 0"))
        live = state.where("copies = 0").drop("copies")
    empty = live.withColumn("copies", F.lit(0).cast("long")).select(*out).limit(0)
    return reduce(DataFrame.unionByName, [b.select(*out) for b in booked], empty)


def _node(side: str) -> Column:
    """A site as a number; two that clash only share a component."""
    return F.xxhash64(F.lit(side), f"site_{side}")


def _round(live: DataFrame) -> DataFrame:
    """Pairs that are each other's best with the copies they book, and the open rest with none.

    Best pairs come from a mergeable ``min``, not from sorting a site's pairs in a window.
    """
    # Site ids make the order total; the fields behind them only ride along.
    score = F.struct(
        "levels", "metres", "days", "site_a", "site_b", "free_a", "free_b", "used_a", "used_b"
    )
    best_a = live.groupBy("site_a").agg(F.min(score).alias("score")).select("score")
    best_b = live.groupBy("site_b").agg(F.min(score).alias("score")).select("score")
    won = (
        best_a.join(shuffled(best_b), "score", "left_semi")
        .select("score.*")
        .withColumn("copies", F.least("free_a", "free_b"))
    )
    spent_a = won.select("site_a", F.col("copies").alias("q_a"))
    spent_b = won.select("site_b", F.col("copies").alias("q_b"))
    qa, qb = F.coalesce("q_a", F.lit(0)), F.coalesce("q_b", F.lit(0))
    rest = (
        live.join(shuffled(spent_a), "site_a", "left")
        .join(shuffled(spent_b), "site_b", "left")
        .withColumns(
            {
                "free_a": F.col("free_a") - qa,
                "free_b": F.col("free_b") - qb,
                "used_a": F.col("used_a") + qa,
                "used_b": F.col("used_b") + qb,
                "copies": F.lit(0).cast("long"),
            }
        )
        .where((F.col("free_a") > 0) & (F.col("free_b") > 0))
        .drop("q_a", "q_b")
    )
    return won.unionByName(rest)


def _settle(batches):
    """Book pairs that arrive by component, in score order; remembers two counters per site of one component."""
    root = None
    free: dict[str, int] = {}
    used: dict[str, int] = {}
    for frame in batches:
        copies = []
        spent: dict[str, list[int]] = {"a": [], "b": []}
        for row in frame.itertuples():
            if row.root != root:
                root, free, used = row.root, {}, {}
            sides = {"a": "a" + row.a_key, "b": "b" + row.b_key}
            for side, key in sides.items():
                if key not in free:
                    free[key], used[key] = getattr(row, f"free_{side}"), getattr(row, f"used_{side}")
                spent[side].append(used[key])
            n = min(free[key] for key in sides.values())
            copies.append(n)
            for key in sides.values():
                free[key] -= n
                used[key] += n
        frame = frame.assign(copies=copies, used_a=spent["a"], used_b=spent["b"])
        yield frame.loc[frame["copies"] > 0, ["site_a", "site_b", "copies", "used_a", "used_b"]]


def ranked_copies(entries: DataFrame) -> DataFrame:
    """Give each entry its site (smallest entry id of its copies, and their source) and its rank therein.

    Sources number their entries independently, so an id alone names nothing.

    The rank follows (leading hash digits, entry id).  Entries move once, by site; only sites in buckets
    with more than ``BUCKET_COPIES`` entries are ranked in chunks, so no task sees more than that of a site.
    """
    chunk = F.substring(F.md5(F.col("event_id").cast("string")), 1, COPY_CHUNKS)
    keyed = entries.withColumns({"__key": F.xxhash64(*SITE), "__chunk": chunk})
    bucket = F.pmod("__key", F.lit(COPY_BUCKETS)).alias("__bucket")
    hot, found = sized(keyed.groupBy(bucket).count().where(F.col("count") > BUCKET_COPIES).select("__bucket"), "hot_sites")
    if not found:
        return _ranked_at_once(keyed, entries.columns)
    keyed = keyed.select("*", bucket)
    return _ranked_at_once(lookup_join(keyed, hot, ["__bucket"], "left_anti"), entries.columns).unionByName(
        _ranked_in_chunks(lookup_join(keyed, hot, ["__bucket"], "left_semi"), entries.columns)
    )


def _ranked_at_once(keyed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Copies of a site ranked by one task.  The hash leads the sort, which then seldom compares the site itself."""
    ordered = W.partitionBy("__key", *SITE).orderBy("__chunk", "event_id")
    site = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return keyed.select(
        *columns,
        F.struct(F.min("event_id").over(site).alias("id"), F.col("dataset").alias("of")).alias("site"),
        F.count(F.lit(1)).over(site).alias("n_copies"),
        F.row_number().over(ordered).cast("long").alias("rank"),
    )


def _ranked_in_chunks(keyed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chunks of a site ranked separately and shifted by the sizes of the chunks before them."""
    sizes = keyed.groupBy(*SITE, "__chunk").agg(
        F.count(F.lit(1)).alias("__n"), F.min("event_id").alias("__first")
    )
    site = W.partitionBy(*SITE)
    before = site.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *SITE,
        "__chunk",
        F.struct(F.min("__first").over(site).alias("id"), F.col("dataset").alias("of")).alias("site"),
        F.sum("__n").over(site).alias("n_copies"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    numbered = keyed.withColumn(
        "__row", F.row_number().over(W.partitionBy(*SITE, "__chunk").orderBy("event_id"))
    )
    same = reduce(
        lambda a, b: a & b,
        [numbered[c].eqNullSafe(sizes[c]) for c in (*SITE, "__chunk")],
    )
    return numbered.join(shuffled(sizes), same).select(
        *[numbered[c] for c in columns],
        sizes["site"],
        sizes["n_copies"],
        (sizes["__before"] + numbered["__row"]).alias("rank"),
    )


def integrate(
    events: DataFrame,
    taxonomy: DataFrame,
    order: Sequence[str],
    levels: Sequence[str],
    km: float = 4.0,
    days: int = 2,
) -> DataFrame:
    """Mark duplicates across sources: all entries plus ``duplicate_of`` and ``duplicate_of_dataset``.

    Both are NULL for unique entries.  An entry is known by ``(dataset, event_id)``.

    ``events`` is in the common form of :func:`harmonise`; ``taxonomy`` carries
    ``dataset, base_category`` and the level columns, finest first.  See the module
    text for the matching rule.  Entries without a date or place stay unique.
    """
    episode_end = F.when(F.col("enddate") > F.col("date"), F.col("enddate"))
    columns = ["event_id", *SITE]
    copies, _ = written(
        ranked_copies(events.withColumn("enddate", episode_end).select(*columns)), "copies"
    )
    sites = classify(
        copies.where("rank = 1")
        .where("date is not null and longitude is not null and latitude is not null")
        .select("site", *SITE, "n_copies"),
        taxonomy.select("dataset", "base_category", *levels),
    )
    sites, count = written(
        sites.select(
            "site", "dataset", "date", "enddate", "longitude", "latitude", *levels,
            F.col("n_copies").alias("free"), F.lit(0).cast("long").alias("used"),
        ),
        "sites",
        **{f"of_{n}": F.count_if(F.col("dataset") == source) for n, source in enumerate(order)},
    )

    kept, size = sites.where(F.col("dataset") == order[0]), count["of_0"]
    links = []
    for n, source in enumerate(order[1:], 1):
        incoming = sites.where(F.col("dataset") == source)
        size += count[f"of_{n}"]
        many = size > JOINED_SITES
        found, spent = _match_source(kept, incoming, km, days, levels, many)
        links += found
        if n == len(order) - 1:
            break
        rest = _less(incoming, spent, "site_b", book=True)
        kept = kept.unionByName(written(rest, "kept")[0] if many else rest)
    if not links:
        nothing = {"duplicate_of": F.lit(None).cast("long"), "duplicate_of_dataset": F.lit(None).cast("string")}
        return copies.select(*columns).withColumns(nothing)
    return _expand(copies, reduce(DataFrame.unionByName, links))


def _site_key(*columns: str) -> Column:
    """A number that leads a join's keys: sorting by it seldom compares the site itself."""
    return F.xxhash64(*columns)


def _less(sites: DataFrame, links: DataFrame, side: str, book: bool) -> DataFrame:
    """Sites with the copies that links took removed; exhausted sites go."""
    spent = links.groupBy(_site_key(side).alias("__key"), F.col(side).alias("site")).agg(F.sum("copies").alias("__q"))
    q = F.coalesce("__q", F.lit(0))
    used = F.col("used") + q if book else F.col("used")
    return (
        sites.withColumn("__key", _site_key("site"))
        .join(shuffled(spent), ["__key", "site"], "left")
        .drop("__key")
        .withColumns({"free": F.col("free") - q, "used": used})
        .where("free > 0")
        .drop("__q")
    )


def _crowding(kept: DataFrame, incoming: DataFrame, km: float, days: int) -> tuple[int, int, int, int]:
    """Rough number of pairs in all windows and in the fullest one, number of sites in all and in the fullest window.

    From counts per coarse bucket, which combine before they move.
    """
    cell = 2 * math.degrees(km / EARTH_KM)

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(
            F.floor(F.unix_date("date") / (2 * max(days, 1))).alias("d"),
            F.floor(F.col("latitude") / cell).alias("r"),
            F.floor(F.col("longitude") / cell).alias("c"),
        ).agg(F.count(F.lit(1)).cast("double").alias(name))

    buckets = counts(kept, "a").join(shuffled(counts(incoming, "b")), ["d", "r", "c"], "full").fillna(0.0)
    met, sites = F.col("a") * F.col("b"), F.col("a") + F.col("b")
    row = buckets.agg(F.sum(met), F.max(met), F.sum(sites), F.max(sites)).first()
    return tuple(int(v or 0) for v in row)


def _calm(
    kept: DataFrame, incoming: DataFrame, km: float, days: int, levels: Sequence[str], partners: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that no crowded bucket has a part in, and the sites of both sides that are left to the tiers.

    A bucket is crowded when its kept sites have more than ``partners`` incoming sites around
    them.  Pairs outside are few for each site and scored at once.  Those that a chain of shared sites
    links with an incoming site beside a crowded bucket have to wait for its better pairs: they
    are handed over with their sites.
    """
    keys = list(BUCKET)
    placed, _ = written(_bucketed(kept, km, days), "placed")
    around, _ = written(_neighbours(incoming, km, days).select(*keys, "site"), "around")
    crowded = around.groupBy(*keys).count().where(F.col("count") > partners).select(*keys)
    crowded, _ = written(placed.select(*keys).distinct().join(shuffled(crowded), keys), "crowded")
    dense = split_join(placed, crowded, keys, "left_semi").drop(*keys)
    others = split_join(placed, crowded, keys, "left_anti").drop(*keys)
    beside = split_join(around, crowded, keys, "left_semi").select("site").distinct()
    pairs, seen = written(candidate_pairs(others, incoming, km, days, levels), "calm-pairs", rows=F.count(F.lit(1)))
    parts = components(pairs.select(_node("a").alias("a"), _node("b").alias("b")), seen["rows"])
    pairs, _ = written(
        pairs.withColumn("__node", _node("a")).join(shuffled(parts.withColumnRenamed("node", "__node")), "__node").drop("__node"), "calm-parts"
    )
    waiting = pairs.join(shuffled(beside.withColumnRenamed("site", "site_b")), "site_b", "left_semi").select("root").distinct()
    handed, _ = written(pairs.join(shuffled(waiting), "root", "left_semi"), "handed-over")
    mine = handed.select(F.col("site_a").alias("site")).union(dense.select("site")).distinct()
    theirs = handed.select(F.col("site_b").alias("site")).union(beside).distinct()
    return (
        pairs.join(shuffled(waiting), "root", "left_anti").drop("root"),
        kept.join(shuffled(mine), "site", "left_semi"),
        incoming.join(shuffled(theirs), "site", "left_semi"),
    )


def _pair_budget(sites: int) -> int:
    """Pairs worth looking at in one go: in proportion to the sites."""
    return max(200_000, 20 * sites)


def _at_once(kept: DataFrame, incoming: DataFrame, km: float, days: int, levels: Sequence[str]) -> DataFrame | None:
    """Links from all pairs of the window in one go; None where windows are too crowded for that."""
    pairs, fullest, size, densest = _crowding(kept, incoming, km, days)
    if pairs > _pair_budget(size) or fullest > WINDOW_PAIRS:
        return None
    return match_sites(candidate_pairs(kept, incoming, km, days, levels, hot=8 * densest > BUCKET_SITES))


def _match_source(
    kept: DataFrame, incoming: DataFrame, km: float, days: int, levels: Sequence[str], blocks: bool
) -> tuple[list[DataFrame], DataFrame]:
    """Match one later source against the entries kept so far.

    Many sites are settled by blocks of space and time first; joins then see only sites that still wait.
    """
    if not blocks:
        return _match_joined(kept, incoming, km, days, levels)
    links, kept, incoming, waiting = match_by_blocks(kept, incoming, km, days, levels)
    if waiting or not links:
        links = links + _match_joined(kept, incoming, km, days, levels)[0]
    return links, reduce(DataFrame.unionByName, links)


def _match_joined(
    kept: DataFrame, incoming: DataFrame, km: float, days: int, levels: Sequence[str]
) -> tuple[list[DataFrame], DataFrame]:
    """Match one later source against the entries kept so far, pairs found by joins.

    Normally all pairs of the window are scored at once.  Where many sites crowd a
    window that would be quadratic.  What no crowded window has a part in is still scored at
    once; for the sites that are left the score is walked through in tiers,
    best first: by taxonomy levels apart, and within a level by growing rings around
    each site.  A tier sees only sites that better tiers left over.  Every pair of a
    tier scores above every pair of the tiers before, so the result is the same, and
    after a ring no two matchable sites closer than its radius are left.  For the same
    reason what the tiers so far left over is scored at once as soon as it is few enough.
    """
    found = _at_once(kept, incoming, km, days, levels)
    if found is not None:
        return [found], found
    calm, kept, incoming = _calm(kept, incoming, km, days, levels, CROWD_PARTNERS)
    links = [match_sites(calm)]
    one = F.count(F.lit(1))
    kept, mine = written(kept, "kept", rows=one)
    incoming, theirs = written(incoming, "incoming", rows=one)
    if not mine["rows"] or not theirs["rows"]:
        return links, links[0]
    rings = _rings(km)
    tiers = [(level, ring) for level in range(len(levels)) for ring in zip([-1, *rings[:-1]], rings)]
    for level, (inner, outer) in tiers:
        # Half a metre of margin: whole metres decide which ring a pair is in.
        reach = km if outer is None else (outer + 0.5) / 1000
        pairs = candidate_pairs(kept, incoming, reach, days, levels, (inner, outer), level)
        found = match_sites(pairs)
        links.append(found)
        if (level, (inner, outer)) == tiers[-1]:
            break
        # Kept entries may serve every later source anew, so only the copies of
        # this step count as spent on their side.
        kept, mine = written(_less(kept, found, "site_a", book=True), "kept", rows=one)
        incoming, theirs = written(_less(incoming, found, "site_b", book=True), "incoming", rows=one)
        if not mine["rows"] or not theirs["rows"]:
            break
        rest = _at_once(kept, incoming, km, days, levels)
        if rest is not None:
            links.append(rest)
            break
    return links, reduce(DataFrame.unionByName, links)


def _rings(km: float) -> list[int | None]:
    """Outer ends of the rings in metres, doubling twice per step; None ends at the window."""
    inner = [math.floor(km * 1000 / f) for f in (64, 16, 4)]
    return [m for m in inner if m > 0] + [None]


def _expand(copies: DataFrame, links: DataFrame) -> DataFrame:
    """Site links back to entry links: rank r of one side meets rank r of the other.

    A link becomes one row per copy it took, no more rows than there are entries, so
    both joins are on ``(site, rank)``, a key of one entry.
    """
    first = F.col("__chunk") * LINK_CHUNK
    last = F.least(F.col("copies"), first + LINK_CHUNK)
    taken = links.withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LINK_CHUNK)))
    ).withColumn("__k", F.explode(F.sequence(first + 1, last)))
    taken = taken.select(
        F.col("site_b").alias("__site_b"),
        (F.col("used_b") + F.col("__k")).alias("__rank_b"),
        F.col("site_a").alias("site"),
        (F.col("used_a") + F.col("__k")).alias("rank"),
    )
    keys = ["__key", "site", "rank"]
    keyed = copies.withColumn("__key", _site_key("site", "rank"))
    earlier = keyed.select(*keys, F.col("event_id").alias("duplicate_of"), F.col("dataset").alias("duplicate_of_dataset"))
    pairs = (
        taken.withColumn("__key", _site_key("site", "rank"))
        .join(shuffled(earlier), keys)
        .select(
            _site_key("__site_b", "__rank_b").alias("__key"),
            F.col("__site_b").alias("site"), F.col("__rank_b").alias("rank"), "duplicate_of", "duplicate_of_dataset",
        )
    )
    return keyed.join(shuffled(pairs), keys, "left").drop(*keys, "n_copies")


def unique_events(integrated: DataFrame) -> DataFrame:
    """Entries that are no duplicate of an earlier source."""
    return integrated.where(F.col("duplicate_of").isNull()).drop("duplicate_of", "duplicate_of_dataset")


def taxonomy_frame(spark, rows: Mapping[tuple[str, str], Sequence[str]], levels: Sequence[str]):
    """Taxonomy from a literal table ``(dataset, category) -> level labels``."""
    schema = ", ".join(f"{c} string" for c in ("dataset", "base_category", *levels))
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], schema)
