"""Mixing sources to target weights over a domain - language - source tree.

Capacities (tokens available times the epochs allowed) are summed from the leaves up; the
budget is then shared from the root down.  At each node, children that cannot use their weighted share give
the rest to their siblings; since a node never gets more than its subtree can use, a shortage is
made up among siblings first and only what a whole subtree lacks goes to the ancestors'
other children.  A leaf spends its budget in seeded epochs: whole epochs, then the
prefix of the next epoch's seeded order that fits.

The work is DataFrame functions only.  Documents are reduced once to narrow rows; order within a leaf comes from
the digits of a seeded digest, and only the slice of a leaf at which its budget runs out is
looked at again, digit by digit, so neither a leaf nor an id with a third of all rows is a burden.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import column, fresh, word_count
from panelspark.session import written

LEVELS = ("domain", "language", "source")


@dataclass(frozen=True)
class Mix:
    """Integer weights (1 to 1000) by child value, for each level; ``default`` for the rest."""

    domain: dict[str, int] = field(default_factory=dict)
    language: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    default: int = 1
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 11


def leaf_key(c: Column) -> Column:
    """A value as a key that keeps null apart from every text."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c.cast("string")))


def _weight(level: str, mix: Mix) -> Column:
    weights = getattr(mix, level)
    out = F.lit(mix.default)
    for value, w in sorted(weights.items()):
        out = F.when(F.col(level) == "=" + value, F.lit(w)).otherwise(out)
    return out.cast("long")


def _shared(children: DataFrame, parent: list[str], level: str, mix: Mix) -> DataFrame:
    """Each child's tokens, given its node's ``total``: the filling of unequal vessels.

    Children in rising order of capacity per weight are full as long as the level of the
    rest reaches them; the others get equal tokens per weight.  Rows here are nodes of the tree.
    """
    w = children.withColumn("weight", _weight(level, mix))
    ratio = (F.col("cap").cast("decimal(38,0)") * 1_000_000 / F.col("weight")).cast("decimal(38,0)")
    order = Window.partitionBy(*parent, "total").orderBy(ratio.asc(), F.col(level).asc())
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    w = w.withColumn("weights", F.sum("weight").over(rest))
    fills = F.col("cap").cast("decimal(38,0)") * F.col("weights") <= F.col("left").cast("decimal(38,0)") * F.col("weight")
    w = w.withColumn("open", F.when(~fills, F.struct(ratio.alias("r"), F.col(level), "left", "weights")))
    # The first child that does not fill sets the level for itself and all after it.
    w = w.withColumn("first", F.min("open").over(Window.partitionBy(*parent, "total")))
    by_level = F.expr("(first.left * weight) div first.weights")
    full = F.col("first").isNull() | (F.struct(ratio, F.col(level)) < F.struct(F.col("first.r"), F.col(f"first.{level}")))
    return w.withColumn("total", F.when(full, F.col("cap")).otherwise(by_level)).drop("weight", "left", "weights", "open", "first")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, language, source, tokens) with ``cap`` and the budget as ``total``."""
    caps = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    root = caps.agg(F.expr(f"sum(tokens) * {mix.budget_percent} div 100").alias("total"))
    level1 = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(root))  # one row
    level1 = _shared(level1, [], "domain", mix).select("domain", "total")
    level2 = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(level1, "domain")
    level2 = _shared(level2, ["domain"], "language", mix).select("domain", "language", "total")
    return _shared(caps.join(level2, ["domain", "language"]), ["domain", "language"], "source", mix)


def domain_of(source: Column, domains: int = 4) -> Column:
    """Production rule: the number at the end of a source's name deals it to a domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("long") % domains).cast("string")))


# How the place where a leaf's budget ends is narrowed down: digits of the seeded digest, the
# key, digits of the text's digest, the text, and the part of the table a repeated row stands in.
_STEPS = ("left(order, 3)", "left(order, 6)", "concat(order, key)", "left(text_key, 3)", "text_key", "chunk")


def _placed(rows: DataFrame, place: Column) -> DataFrame:
    """Per leaf and ``place`` the rows, the tokens and the tokens before it; one row per place."""
    before = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*LEVELS, place.alias("place")).agg(F.sum("tokens").alias("inside"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0)))


def _prefixes(held: DataFrame, plan: DataFrame, seed: int, keep: list[str]) -> DataFrame:
    """Every row with ``extra``: 1 where the prefix of its leaf's last epoch holds it.

    Each step keeps only the rows at the place where the budget ends, until they are one row, or
    repeats of one row, of which as many are taken as fit.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("key")))
    rows = held.join(plan.select(*LEVELS, "epochs", "part"), list(LEVELS)).withColumn("order", order)
    fits = F.col("before") + F.col("inside") <= F.col("part")
    cut = ~fits & (F.col("before") < F.col("part")) & (F.col("n") > 1)
    wanted = [*keep, *LEVELS, "tokens", "epochs"]
    extra = F.when(fits & (F.col("tokens") > 0), 1).otherwise(0).alias("extra")
    out = []
    for place in map(F.expr, _STEPS):
        met = rows.withColumn("place", place).join(written(_placed(rows, place), "mixing-places")[0], [*LEVELS, "place"])
        out.append(met.where(~cut).select(*wanted, extra))
        left = met.where(cut).withColumn("part", F.col("part") - F.col("before")).select(*rows.columns)
        rows, seen = written(left, "mixing-cut", rows=F.count(F.lit(1)))
        if not seen["rows"]:
            break
    else:
        # Repeats of one row in one part of the table, for each leaf.
        nth = F.row_number().over(Window.partitionBy(*LEVELS).orderBy("tokens"))
        taken = (nth * F.col("tokens") <= F.col("part")) & (F.col("tokens") > 0)
        out.append(rows.withColumn("nth", nth).select(*wanted, F.when(taken, 1).otherwise(0).alias("extra")))
    return reduce(DataFrame.unionByName, out)


def choose(df: DataFrame, mix: Mix, domain: Column, key: Column, lang: str = "lang", source: str = "source", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Per input row its leaf, tokens and ``copies``: how often the mix takes it.

    ``key`` orders rows by a seeded digest; rows with the same key in a leaf follow one another by their texts' digests,
    and of repeated rows as many are taken as fit, whichever they are.  Tokens are words.  Rows without
    tokens (null and empty texts) cost nothing and are taken as often as whole epochs are, never by a prefix.
    Null language or source is a leaf of its own.  An empty table gives an empty result.
    """
    narrow = df.select(
        *[c.alias(n) for n, c in (carry or {}).items()],
        leaf_key(domain).alias("domain"),
        leaf_key(column(lang)).alias("language"),
        leaf_key(column(source)).alias("source"),
        F.coalesce(key.cast("string"), F.lit("null")).alias("key"),
        F.md5(F.coalesce(column(text), F.lit(""))).alias("text_key"),
        word_count(column(text)).alias("tokens"),
        F.spark_partition_id().alias("chunk"),
    )
    held, _ = written(narrow, "mixing")
    leaves = held.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets, _ = written(leaf_budgets(leaves, mix), "budgets")
    # Whole epochs, and the number of the epoch that is taken in part.
    full = F.when(F.col("leaf_tokens") > 0, F.expr("total div leaf_tokens")).otherwise(0)
    plan = budgets.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), "total")
    plan = plan.withColumn("epochs", full).withColumn("part", F.col("total") - F.col("epochs") * F.col("leaf_tokens"))
    rows = _prefixes(held, plan, mix.seed, list(carry or {}))
    return rows.select(*(carry or {}), *LEVELS, "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("copies"))


def mix_report(df: DataFrame, mix: Mix, domain: Column, id: str = "doc_id", **names) -> DataFrame:
    """Per input row: id, leaf, tokens and copies (0 where the mix leaves it out)."""
    bare = lambda c: F.when(F.col(c) != "null", F.substring(c, 2, 1 << 30)).alias(c)
    chosen = choose(df, mix, domain, column(id), carry={"doc_id": column(id)}, **names)
    return chosen.select("doc_id", *map(bare, LEVELS), "tokens", "copies")


def mixed(df: DataFrame, mix: Mix, domain: Column, id: str = "doc_id", **names) -> DataFrame:
    """The rows of the mix with the columns of ``df``, each as often as it is taken.

    Rows are numbered once, in a written table, so that repeated rows can be taken one by one.
    """
    number = fresh(df, "row_number")
    held, _ = written(df.withColumn(number, F.monotonically_increasing_id()), "mixing-rows")
    theirs, copies = fresh(held, "taken_number"), fresh(held, "taken_copies")
    chosen = choose(held, mix, domain, column(id), carry={"mix_row": column(number)}, **names).where("copies > 0")
    taken = chosen.select(F.col("mix_row").alias(theirs), F.col("copies").alias(copies))
    joined = held.join(taken, F.col(number) == F.col(theirs))
    if mix.max_epochs > 1:
        joined = joined.withColumn(fresh(joined, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*[column(c) for c in df.columns])
