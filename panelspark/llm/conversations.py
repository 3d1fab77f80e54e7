"""Repair of conversations by the cheapest edits that give them a legal structure.

A legal conversation is an optional system turn, then user and assistant in turn.  The edits
are keep, re-role, delete and insert; a dynamic program over (turn, state) finds the cheapest,
and among the cheapest the one whose letters come first in ASCII.

A conversation's turns are cut into pieces of about the square root of the longest
conversation.  One pass backward over pieces stores the costs to the end, per state, only at
the ends of pieces (checkpoints); a piece reaches there by its own cost matrix, so pieces of one
conversation are worked on side by side.  Walking forward, each piece computes its inner cost
vectors again and takes the least letter among the tight edges, those that reach the end at
exactly the stored cost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, column
from panelspark.session import written

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEAST_PIECE = 256
FLUSH = 2000
FAR = 1 << 60

# States: nothing yet, after system, after user, after assistant.  Legal ends: 0 and 3.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # what the next user or assistant turn leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL_PAIRS = ("su", "ua", "au")
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3

REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with faults put in by the CRC-32 of the row's key, modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes its
    role user.  A null in the key, a role or a text is one space.
    """
    key = F.concat(F.coalesce(column(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(column(turn).cast("string"), F.lit(" ")))
    fault = (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault")
    said = F.coalesce(column(text), F.lit(" "))
    by = F.coalesce(column(role), F.lit(" "))
    rows = df.select(column(conv).alias("conv"), column(turn).alias("turn"), by.alias("role"), said.alias("text"), fault)
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("fault <> 0").select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


# --- the dynamic program -------------------------------------------------------------------


def end_costs() -> tuple[int, ...]:
    """Costs to a legal end with no turn left."""
    return tuple(0 if s in (START, ASSISTANT) else INSERT + (0 if NEXT[s] == ASSISTANT else INSERT) for s in STATES)


def edges(state: int, kind: tuple[str, int]) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the ways to take one turn, in ASCII order of the letters."""
    initial, fault = kind
    yield "D", DELETE, state
    if fault in (BLANK_FAULT, DUPLICATE_FAULT):
        return
    extra = TRUNCATED if fault == TRUNCATED_FAULT else 0
    kept = INITIAL.get(initial)
    if kept is not None and (kept == NEXT[state] if kept != SYSTEM else state == START):
        yield "K", KEEP + extra, kept
    yield "R", REROLE + extra, NEXT[state]


def before(kind: tuple[str, int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a turn, insertions ahead of it included."""
    cost = [min(w + after[t] for _, w, t in edges(s, kind)) for s in STATES]
    for _ in range(2):  # two insertions lead from any state to any that inserting reaches
        cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in STATES]
    return tuple(cost)


def unit(s: int) -> tuple[int, ...]:
    return tuple(0 if t == s else FAR for t in STATES)


def walked(kinds: list[tuple[str, int]], state: int, after: tuple[int, ...], last: bool) -> tuple[str, int]:
    """Letters through the turns of one piece, and the state behind them.

    ``after`` are the stored costs behind the piece; those within it are computed here and
    dropped with it.
    """
    costs = [after]
    for kind in reversed(kinds):
        costs.append(before(kind, costs[-1]))
    costs.reverse()
    letters = []
    for k, kind in enumerate(kinds):
        while True:
            steps = [("I", INSERT + costs[k][NEXT[state]], NEXT[state])]
            steps += [(x, w + costs[k + 1][t], t) for x, w, t in edges(state, kind)]
            letter, _, state = min(s for s in steps if s[1] == costs[k][state])
            letters.append(letter)
            if letter != "I":
                break
    while last and state not in (START, ASSISTANT):
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


# --- streams of sorted rows ----------------------------------------------------------------


def _rows(batches) -> Iterator[tuple]:
    """Rows of Arrow batches as plain values, ids and nulls as they are."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], schema) -> Iterator:
    import pyarrow as pa

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= FLUSH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


def _streamed(df: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over the rows of each partition, one row at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from _batches(step(_rows(batches)), arrow)

    return df.mapInArrow(run, schema)


def _placed(length: int):
    """Cut each conversation of a sorted partition into pieces; a piece is named by its first row."""

    def step(rows):
        conv = piece = object()
        for at, (segment, *row) in enumerate(rows):
            if at == 0 or row[0] != conv or at - piece >= length:
                conv, piece = row[0], at
            yield (segment, piece, at, *row)

    return step


def _matrices(rows):
    """Per piece: counts, borders, and the least costs from each state ahead of it to each state behind it."""

    def done():
        m = [before_all(s) for s in STATES]
        return (segment, piece, conv, n, *counts, illegal, first, last, low, high, turns, [c for row in m for c in row])

    def before_all(s):
        return [composed[t][s] for t in STATES]

    key = None
    for segment_, piece_, _, conv_, turn, initial, fault in rows:
        if key != (segment_, piece_):
            if key is not None:
                yield done()
            segment, piece, conv = segment_, piece_, conv_
            key = (segment, piece)
            n = illegal = turns = 0
            counts = [0, 0, 0]
            first, last, low, high = initial, None, None, None
            # composed[t][s]: least cost from s ahead of the piece to t behind the turns seen so far
            composed = [[0 if s == t else FAR for s in STATES] for t in STATES]
        n += 1
        if fault:
            counts[fault - 1] += 1
        if last is not None and last + initial not in LEGAL_PAIRS:
            illegal += 1
        last = initial
        if turn is not None and turn != high:
            turns += 1
            low = turn if low is None else low
            high = turn
        through = _through(initial if initial in INITIAL else "", fault)
        composed = [[min(FAR, min(composed[m][s] + through[m][t] for m in STATES)) for s in STATES] for t in STATES]
    if key is not None:
        yield done()


_THROUGH: dict[tuple[str, int], list[tuple[int, ...]]] = {}


def _through(initial: str, fault: int):
    """Least cost from state m to state t over one turn, insertions ahead of it included."""
    kind = (initial, fault)
    if kind not in _THROUGH:
        columns = [before(kind, unit(t)) for t in STATES]
        _THROUGH[kind] = [tuple(columns[t][m] for t in STATES) for m in STATES]
    return _THROUGH[kind]


PIECE = (
    "segment int, piece long, conv {conv}, n long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long, costs array<long>"
)
CHECKPOINT = "segment int, piece long, conv {conv}, after array<long>, pieces long, at long, figures array<long>"


def _checkpoints(rows):
    """Per piece of a conversation: costs behind it; with its first piece, the conversation's figures.

    Holds one conversation's pieces, about the square root of its turns.
    """

    def done(pieces):
        after = [end_costs()]
        for p in reversed(pieces):
            costs = p[-1]
            after.append(tuple(min(costs[4 * s + t] + after[-1][t] for t in STATES) for s in STATES))
        after.reverse()
        totals = [sum(p[k] for p in pieces) for k in range(4, 8)]
        illegal, turns, high, low = totals[3], 0, None, None
        for k, p in enumerate(pieces):
            if k and pieces[k - 1][9] + p[8] not in LEGAL_PAIRS:
                illegal += 1
            if p[10] is not None:
                turns += p[12] - (p[10] == high)
                low = p[10] if low is None else low
                high = p[11]
        gaps = 0 if low is None else high - low + 1 - turns
        figures = [gaps, *totals[:3], illegal, after[0][START]]
        for k, p in enumerate(pieces):
            yield (*p[:3], list(after[k + 1]), len(pieces), k, figures if k == 0 else None)

    held: list[tuple] = []
    for row in rows:
        if held and row[2] != held[0][2]:
            yield from done(held)
            held = []
        held.append(row)
    if held:
        yield from done(held)


EXIT = "segment int, piece long, conv {conv}, exits array<int>"
ENTRY = "segment int, piece long, entry int"


def _exits(rows):
    """Per piece of a long conversation: the state behind it for every state ahead of it."""
    for (segment, piece), held in _pieces(rows):
        kinds = [(r[5] if r[5] in INITIAL else "", r[6]) for r in held]
        after = tuple(held[0][7])
        yield segment, piece, held[0][3], [walked(kinds, s, after, False)[1] for s in STATES]


def _entries(rows):
    """The state ahead of each piece, from its conversation's start on."""
    conv, state = object(), START
    for segment, piece, conv_, exits in rows:
        if conv_ != conv:
            conv, state = conv_, START
        yield segment, piece, state
        state = exits[state]


def _pieces(rows):
    """Rows of one piece at a time."""
    key, held = None, []
    for row in rows:
        if row[:2] != key:
            if held:
                yield key, held
            key, held = row[:2], []
        held.append(row)
    if held:
        yield key, held


# What goes to the last pass: the audit letters of a piece (text null) and lines of the repaired conversation.
LINE = "conv {conv}, segment int, at long, part int, kind string, role string, turn {turn}, old_role string, digest binary"


def _edited(rows):
    """Per piece its letters; per kept or inserted turn a line."""
    for (segment, piece), held in _pieces(rows):
        kinds = [(r[5] if r[5] in INITIAL else "", r[6]) for r in held]
        conv, after, pieces, at, entry = held[0][3], tuple(held[0][7]), held[0][8], held[0][9], held[0][10]
        state = entry
        letters, _ = walked(kinds, entry, after, at == pieces - 1)
        yield conv, segment, piece, -1, "audit", letters, None, None, None
        k = part = 0
        for letter in letters:
            row = held[min(k, len(held) - 1)]
            place = row[2] if k < len(held) else row[2] + 1
            if letter == "I":
                state = NEXT[state]
                yield conv, segment, place, part, "insert", ROLE[state], None, None, None
                part += 1
                continue
            if letter == "K":
                state = INITIAL[row[5]]
                yield conv, segment, place, part, "line", row[11], row[4], row[11], row[12]
            elif letter == "R":
                state = NEXT[state]
                yield conv, segment, place, part, "line", ROLE[state], row[4], row[11], row[12]
            k, part = k + 1, 0


LAST = "conv {conv}, " + REPORT


def _closed(rows):
    """One row per conversation: its figures, audit letters joined, repaired lines hashed as they come."""

    def done():
        return (conv, *figures, "".join(audit), digest.hexdigest())

    conv, open_ = None, False
    for conv_, segment, at, part, kind, role, text, stated in rows:
        if not open_ or conv_ != conv:
            if open_:
                yield done()
            conv, open_, figures, audit, digest, lines = conv_, True, [0] * 6, [], hashlib.sha256(), 0
        if kind == "figures":
            figures = stated
        elif kind == "audit":
            audit.append(role)
        elif kind != "conversation":
            digest.update((("\n" if lines else "") + role + ":" + (text or "")).encode("utf-8", "surrogatepass"))
            lines += 1
    if open_:
        yield done()


# --- the jobs ------------------------------------------------------------------------------


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``conv, turn, role, text``: faults, cheapest edits, digest of the repaired text.

    Turns are ordered by ``turn`` (nulls first), then role, then the SHA-256 of their text; equal
    rows are neighbours.  A null conversation id is one conversation.  An empty role has no
    initial and cannot be kept.  ``every`` adds conversations that have no turns left; they get
    zeros, no letters and the digest of nothing, as an emptied conversation does.  An empty
    table gives an empty result.

    Only ids, turns, initials and digests are sorted; texts move once to the lines they belong
    to and once to their conversation's hash, which SHA-256 has to read in order.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    types = {f.name: f.dataType.simpleString() for f in turns.schema}
    kinds = {"conv": types["conv"], "turn": types["turn"]}
    every = turns.select("conv") if every is None else every.select("conv")
    digest = F.unhex(F.sha2(F.col("text"), 256))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", BLANK_FAULT).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED_FAULT)
    narrow = turns.select("conv", "turn", "role", digest.alias("digest"), fault.cast("int").alias("fault"), F.spark_partition_id().alias("split"))
    longest = turns.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    length = max(LEAST_PIECE, math.isqrt(longest))
    # Range partitions cut long conversations too; the partition number parts rows that are equal.
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest")] + [F.col("split").asc()]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("segment"), "conv", "turn", "role", "digest", "fault")
    placed = f"segment int, piece long, at long, conv {kinds['conv']}, turn {kinds['turn']}, role string, digest binary, fault int"
    sorted_, _ = written(_streamed(ranged, _placed(length), placed), "turns")

    # The first of each role and text in a conversation is no duplicate.
    first = sorted_.groupBy("conv", "role", "digest").agg(F.min(F.struct("segment", "at")).alias("f")).select("f.segment", "f.at", F.lit(True).alias("new"))
    late = F.when((F.col("fault") != BLANK_FAULT) & F.col("new").isNull(), DUPLICATE_FAULT).otherwise(F.col("fault")).alias("fault")
    judged = sorted_.join(first, ["segment", "at"], "left").select(
        "segment", "piece", "at", "conv", "turn", F.substring("role", 1, 1).alias("initial"), late.cast("int"), "role", "digest"
    )
    judged, _ = written(judged, "judged-turns")

    def by_piece(df):
        return df.repartition("segment", "piece").sortWithinPartitions("segment", "piece", "at")

    def by_conversation(df, *then):
        return df.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *then)

    bare = judged.select("segment", "piece", "at", "conv", F.col("turn").cast("long"), "initial", "fault")
    pieces = _streamed(by_piece(bare), _matrices, PIECE.format(**kinds))
    points = _streamed(by_conversation(pieces, "segment", "piece"), _checkpoints, CHECKPOINT.format(**kinds))
    points, seen = written(points, "checkpoints", long=F.max("pieces"))

    # Where a conversation has several pieces, the state ahead of each follows from those before it.
    if (seen["long"] or 1) > 1:
        several = points.where("pieces > 1").select("segment", "piece", "after")
        exits = _streamed(by_piece(bare.join(several, ["segment", "piece"]).select(*bare.columns, "after")), _exits, EXIT.format(**kinds))
        entries = _streamed(by_conversation(exits, "segment", "piece"), _entries, ENTRY)
        stated = points.join(entries, ["segment", "piece"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    else:
        stated = points.withColumn("entry", F.lit(START))
    known = stated.select("segment", "piece", "after", "pieces", F.col("at").alias("number"), "entry")
    full = judged.join(known, ["segment", "piece"]).select(
        "segment", "piece", "at", "conv", "turn", "initial", "fault", "after", "pieces", "number", "entry", "role", "digest"
    )
    edited, _ = written(_streamed(by_piece(full), _edited, LINE.format(**kinds)), "edits")

    # Only the first of equal rows is ever kept, so each line meets one text.
    def row_key(role):
        known = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv", "turn")]
        return F.unhex(F.sha2(F.concat_ws("|", *known, F.hex("digest"), F.col(role)), 256)).alias("row_key")

    texts = turns.withColumn("digest", digest).select(row_key("role"), "text").groupBy("row_key").agg(F.first("text").alias("text"))
    kept = edited.where("kind = 'line'").select("conv", "segment", "at", "part", "kind", "role", row_key("old_role"))
    lines = kept.join(texts, "row_key").drop("row_key")
    none = F.lit(None)
    figures = none.cast("array<long>").alias("figures")
    parts = [
        lines.withColumn("figures", none.cast("array<long>")),
        edited.where("kind <> 'line'").select("conv", "segment", "at", "part", "kind", "role", none.cast("string").alias("text"), figures),
        points.where("at = 0").select(
            "conv", "segment", F.lit(-1).alias("at"), F.lit(-1).alias("part"), F.lit("figures").alias("kind"), none.cast("string").alias("role"), none.cast("string").alias("text"), "figures"
        ),
        every.distinct().select(
            "conv", F.lit(-1).alias("segment"), F.lit(-1).alias("at"), F.lit(-1).alias("part"), F.lit("conversation").alias("kind"),
            none.cast("string").alias("role"), none.cast("string").alias("text"), figures,
        ),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return _streamed(by_conversation(union, "segment", "at", "part"), _closed, LAST.format(**kinds))


def repair_damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage every conversation of ``df`` and repair it: one row per original conversation id.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; see
    ``damaged`` and ``repair`` for nulls, ties, repeated rows and empty tables.  Other columns
    are left out.
    """
    turns = damaged(df, conv, turn, role, text)
    return repair(turns, df.select(column(conv).alias("conv"))).withColumnRenamed("conv", "conv_id")


def oracle() -> str:
    """The same in DuckDB: best (cost, letters) per state, carried forward turn by turn."""
    table = [0]
    for n in range(1, 16):
        c = n
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    nibbles = "[" + ", ".join(f"{c}::UBIGINT" for c in table) + "]"
    half = "xor(({c}) >> 4, {t}[(xor({c}, {b}) & 15)::BIGINT + 1])"
    low = half.format(c="c", t=nibbles, b="b")
    step = half.format(c=low, t=nibbles, b="(b >> 4)")
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: {step}), 4294967295::UBIGINT)"

    def way(state: str, cost: str, letter: str, line: str = "") -> str:
        lines = f"list_append({state}.lines, {line})" if line else f"{state}.lines"
        return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'lines': {lines}}}"

    def best(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    far = "{'cost': 1000000000::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
    start = "{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
    extra = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    kept, as_user, as_assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"

    def taken(*ways: str) -> str:
        return f"CASE WHEN fault IN (1, 2) THEN {ways[0]} ELSE {best(*ways)} END"

    def only(condition: str, one: str) -> str:
        return f"CASE WHEN {condition} THEN {one} ELSE {far} END"

    to_user = [only("i = 'u'", way(x, extra, "K", kept)) for x in ("g0", "g1", "g3")] + [way(x, f"1 + {extra}", "R", as_user) for x in ("g0", "g1", "g3")]
    gaps = f"""SELECT *, {best("f2", way("f0", "5", "I", "'user:'"), way("f1", "5", "I", "'user:'"), way("f3", "5", "I", "'user:'"))} AS g2, f0 AS g0, f1 AS g1"""
    return rf"""
    WITH RECURSIVE source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    drawn AS (SELECT *, {crc} % 20 AS h FROM source),
    hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE h <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending FROM hurt),
    judged AS (SELECT *, left(role, 1) AS i, CASE WHEN ending = '' THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
            WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS p FROM placed),
    figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
            count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows_ FROM judged GROUP BY conv_id),
    walk AS (SELECT conv_id, 0::BIGINT AS n, {start} AS f0, {far} AS f1, {far} AS f2, {far} AS f3 FROM figures
        UNION ALL
        SELECT conv_id, n, {way("g0", "2", "D")}, {taken(way("g1", "2", "D"), only("i = 's'", way("g0", extra, "K", kept)))},
            {taken(way("g2", "2", "D"), *to_user)},
            {taken(way("g3", "2", "D"), only("i = 'a'", way("g2", extra, "K", kept)), way("g2", f"1 + {extra}", "R", as_assistant))}
        FROM (SELECT *, {best("f3", way("g2", "5", "I", "'assistant:'"))} AS g3 FROM ({gaps} FROM (
            SELECT walk.conv_id, judged.n, f0, f1, f2, f3, role, text, i, fault FROM walk JOIN judged
            ON walk.conv_id IS NOT DISTINCT FROM judged.conv_id AND judged.n = walk.n + 1) r) r) r),
    ended AS (SELECT conv_id, {best("f0", way("g2", "5", "I", "'assistant:'"), "f3")} AS b FROM (
        {gaps} FROM walk JOIN figures USING (conv_id) WHERE n = rows_) r)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
        sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN figures USING (conv_id) LEFT JOIN ended USING (conv_id)"""
