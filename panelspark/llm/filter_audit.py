"""How document filters act on one another, for every order in which they may run.

A document's failures are a mask of bits.  What happens to it at each step of each order
follows from the mask alone, so every mask has one big integer: a field for each step of
each order and each kind of outcome.  A part's integers, each times its count of documents,
are added up; unpacking the sum gives the whole report at once.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column, word_array
from panelspark.session import written

FIELD = 64  # Bits of a field.  No field can exceed a part's documents, a long count below 2**63.
KINDS = ("removed", "redundant", "good_lost", "toxic_lost")
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)

DUPLICATE = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: letter to whether it fails."""
    words = word_array(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> tuple[DataFrame, str]:
    """Counts per ``part, mask, good, toxic`` and the letters of the mask's bits, lowest first.

    Texts leave the first scan as a digest and a mask.  Equal texts are known by SHA-256; a
    document fails the last filter when its text occurs under a smaller id anywhere.  Rows with
    a null id have no smaller id and are none.  Several labels of one id count when any says so.
    """
    whole = F.coalesce(column(text), F.lit(""))
    checks = text_failures(whole)
    letters = "".join(checks) + DUPLICATE
    mask = sum((F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(checks.values())), F.lit(0))
    seen = docs.select(
        column(id).alias("id"),
        F.coalesce(column(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        mask.alias("mask"),
    )
    # Copies of one row count once per task before they move.
    seen, _ = written(seen.groupBy("id", "part", "digest", "mask").count(), "filter-masks")
    named = seen.where("id is not null")
    # One row per text, met on text and id together: a text that most rows share is no hot key.
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    late = F.when(F.col("first").isNull(), F.lit(1 << (len(letters) - 1))).otherwise(0)
    flagged = named.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + late).alias("mask"), "count")
    marks = labels.where(column(id).isNotNull()).groupBy(column(id).alias("id")).agg(
        F.max(F.coalesce(column("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(column("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = flagged.join(marks, "id", "left").select("part", "mask", "count", "good", "toxic")
    unnamed = seen.where("id is null").select("part", "mask", "count", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    counts = marked.union(unnamed).select("part", "mask", *flags, "count")
    return counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("count").alias("count")), letters


@lru_cache(maxsize=256)
def packed(mask: int, good: bool, toxic: bool, letters: str) -> int:
    """One document's outcomes: four fields for each step of each order, in order of steps."""
    total = 0
    at = 0
    for order in permutations(range(len(letters))):
        gone = False
        for filter in order:
            fails = mask >> filter & 1
            here = fails and not gone
            for k, outcome in enumerate((here, fails and gone, here and good, here and toxic)):
                if outcome:
                    total |= 1 << (at + k) * FIELD
            gone = gone or bool(fails)
            at += len(KINDS)
    return total


def unpacked(total: int, letters: str) -> list[tuple[int, ...]]:
    """The fields of a sum, one tuple of KINDS per step."""
    import numpy as np

    fields = factorial(len(letters)) * len(letters) * len(KINDS)
    flat = np.frombuffer(total.to_bytes(fields * FIELD // 8, "little"), dtype="<u8")
    return [tuple(int(x) for x in row) for row in flat.reshape(-1, len(KINDS))]


def _report(letters: str):
    def of_part(frame):
        import pandas as pd

        total = documents = 0
        alone = [0] * len(letters)
        part = frame["part"].iloc[0]
        for mask, good, toxic, count in zip(frame["mask"], frame["good"], frame["toxic"], frame["count"]):
            mask, count = int(mask), int(count)
            total += packed(mask, bool(good), bool(toxic), letters) * count
            documents += count
            if mask and mask & (mask - 1) == 0:
                alone[mask.bit_length() - 1] += count
        steps = unpacked(total, letters)
        orders = list(permutations(range(len(letters))))
        shapley = [0] * len(letters)
        for k, order in enumerate(orders):
            for step, filter in enumerate(order):
                shapley[filter] += steps[k * len(letters) + step][0]
        out = []
        for k, order in enumerate(orders):
            kept = documents
            name = "".join(letters[f] for f in order)
            for step, filter in enumerate(order):
                removed, redundant, good_lost, toxic_lost = steps[k * len(letters) + step]
                kept -= removed
                out.append((part, name, step + 1, kept, removed, redundant, alone[filter], good_lost, toxic_lost, shapley[filter]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPORT.split(", ")])

    return of_part


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """The report of ``part, mask, good, toxic, count`` rows.

    A part has at most 4 * 2**filters of them, whatever the table's size: that is all one
    task holds.  Six filters or more have too many orders to list them.
    """
    if len(letters) > 5:
        raise ValueError("orders are listed for up to five filters")
    return masks.groupBy("part").applyInPandas(_report(letters), REPORT)


def filter_report(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null part the empty string.  Repeated rows count as often as they
    occur; copies with the smallest id of their text all pass the last filter.  Other columns
    are left out.  An empty table has no parts and gives no rows; empty labels mark nothing.
    """
    return audit(*failure_masks(docs, labels, id, text, part))


def oracle() -> str:
    return r"""
    WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
            [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS w FROM documents),
    marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
            'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
            'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), 'D': regexp_matches(t, '[#$%&*|]'),
            'E': coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false)} AS f
        FROM words LEFT JOIN marks USING (doc_id)),
    grouped AS (SELECT part, good, toxic, f, count(*) AS n FROM failed GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS s FROM orders),
    seen AS (SELECT g.*, o, s, o[s] AS x, f[o[s]] AS fails,
            len([k for k in [1, 2, 3, 4, 5] if k < s AND f[o[k]]]) > 0 AS gone,
            len([k for k in [1, 2, 3, 4, 5] if f[o[k]]]) AS total FROM grouped g, steps),
    report AS (SELECT part, o, s, x, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed,
            sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND total = 1) AS unique_fails,
            sum(n) FILTER (fails AND NOT gone AND good) AS good_lost, sum(n) FILTER (fails AND NOT gone AND toxic) AS toxic_lost
        FROM seen GROUP BY ALL)
    SELECT part, o AS filter_order, s::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
        coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
        coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
        (sum(coalesce(removed, 0)) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM report"""
