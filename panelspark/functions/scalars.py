"""Scalar recodes."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.nulls import as_column

# The two wealth vocabularies in use and their common rank.
WEALTH_LABELS = {
    1: ("poorest", "lowest"),
    2: ("poorer", "second"),
    3: ("middle",),
    4: ("richer", "fourth"),
    5: ("richest", "highest"),
}
# Minutes to the water source for answers given in words.
WATER_LABELS = {"on premises": 0.0, "more than 12 hours": 720.0, "995+": 995.0}


def recode(c: Column | str, mapping: Mapping[str, object], keep_rest: bool = True) -> Column:
    """Replace listed values; the rest stays, or becomes NULL."""
    value = as_column(c)
    pairs = [F.lit(p) for kv in mapping.items() for p in kv]
    looked_up = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(looked_up, value) if keep_rest else looked_up


def wealth_rank(c: Column | str) -> Column:
    value, out = as_column(c), None
    for rank, labels in WEALTH_LABELS.items():
        hit = value.isin(list(labels))
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out


def water_minutes(c: Column | str) -> Column:
    """Minutes to water: worded answers by table, plain numbers as they are."""
    value = as_column(c)
    return F.coalesce(recode(value, WATER_LABELS, keep_rest=False), value.try_cast("double"))


def programme_wave(
    year: Column | str, programme: str, waves: Mapping[int, int] | None = None
) -> Column:
    """Survey id of a pre-aggregated programme, ``<wave year><programme>``.

    ``waves`` maps a data year to its wave year (field work may span two years);
    years outside the map get a NULL id.  Without a map each year is its own wave.
    """
    y = as_column(year).cast("int")
    if waves is not None:
        y = F.try_element_at(F.create_map(*[F.lit(p) for kv in waves.items() for p in kv]), y)
    return F.concat(y.cast("string"), F.lit(programme))


def split_pair(c: Column | str, sep: str = "_") -> tuple[Column, Column]:
    """First and second part of a separated text; missing parts are NULL, extra ones drop."""
    parts = F.split(as_column(c), re.escape(sep))
    return F.get(parts, 0), F.get(parts, 1)


def year_in_name(name: str) -> int | None:
    """Year carried by a column name, e.g. ``lights_1995_mean``."""
    found = re.search(r"(?<!\d)(\d{4})(?!\d)", name)
    return int(found.group(1)) if found else None


def fix_mojibake(c: Column | str) -> Column:
    """Undo UTF-8 text that was decoded as Latin-1 (``Ã©`` for ``é``).

    Applied only where the tell-tale byte pair shows, every character fits into
    Latin-1, and the re-read bytes are valid UTF-8; other text stays as it is.
    """
    text = as_column(c)
    reread = F.encode(text, "ISO-8859-1").cast("string")
    broken = text.rlike("[Â-ô][\u0080-¿]") & ~text.rlike("[^\u0000-ÿ]")
    return F.when(broken, F.when(F.is_valid_utf8(reread), reread).otherwise(text)).otherwise(text)
