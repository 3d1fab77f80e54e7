"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the word windows that a text repeats; the
verdict looks at the share of the words' characters that lie inside such windows, and
inside repeated lines.  Everything is per text, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, bound_batches, column, fresh

# Largest share, in percent, of characters inside repeated windows of so many words, as in
# the published repetition rules for web text.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
MIN_WORDS = 50
REPEAT_LIMIT = 50
SYMBOLS = "#*$%&|<>"

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Words inside the windows of ``length`` that begin at ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _exact_triples(ids: np.ndarray, n_kinds: int) -> np.ndarray:
    """One number per three-word window, equal only for equal windows."""
    pairs = ids[:-1] * n_kinds + ids[1:]
    if n_kinds > 1 << 20:
        _, pairs = np.unique(pairs, return_inverse=True)
    return pairs[:-1] * n_kinds + ids[2:]


def measure(text: str | None, limits: dict[int, int], line_limit: int) -> tuple:
    """All figures of one text.  A missing or empty text has no words and fails the base."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(sizes.sum())
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(map(len, WORD.findall(line)))
        elif WORD.search(line):
            seen.add(line)
    repeat_words, grams = 0, [0] * len(limits)
    if n >= 3:
        kinds: dict[str, int] = {}
        ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), dtype=np.int64, count=n)
        starts = np.flatnonzero(_repeated(_exact_triples(ids, len(kinds))))
        if len(starts):
            repeat_words = int(_covered(starts, 3, n).sum())
            value = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
            value ^= value >> np.uint64(29)
            rolled, at = value, {length: k for k, length in enumerate(sorted(limits))}
            for length in range(2, max(limits) + 1):
                if n < length:
                    break
                rolled = rolled[:-1] * _BASE + value[length - 1 :]
                if length in at:
                    starts = np.flatnonzero(_repeated(rolled))
                    if not len(starts):
                        break  # no longer window can repeat
                    grams[at[length]] = int(sizes[_covered(starts, length, n)].sum())
    base_failed = n < MIN_WORDS or 100 * repeat_words > REPEAT_LIMIT * n
    within = all(100 * c <= limits[length] * chars for length, c in zip(sorted(limits), grams))
    kept = not base_failed and within and 100 * dup_line_chars <= line_limit * chars
    return n, chars, symbols, dup_lines, repeat_words, dup_line_chars, grams, base_failed, kept


def figures(text: Column, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> Column:
    """A struct of all figures of a text column (fields in ``FIELDS``)."""
    limits = dict(limits or NGRAM_LIMITS)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t, limits, line_limit) for t in texts], columns=names)

    return run(text)


def quality_report(df: DataFrame, id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """One row per input row: its id and all figures.

    Null and empty texts: zero counts, ``base_failed``, not kept.  Null ids pass through.
    Repeated rows are judged each for itself.  Other columns are left out, so their names
    cannot clash.  An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    q = fresh(df, "figures")
    judged = df.select(column(id).alias("doc_id"), figures(column(text), **rules).alias(q))
    return judged.select("doc_id", f"{q}.*")


def keep_good(df: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows whose text passes, with the columns of ``df`` and no others."""
    bound_batches(df.sparkSession)
    q = fresh(df, "figures")
    judged = df.withColumn(q, figures(column(text), **rules))
    return judged.where(F.col(q)["kept"]).drop(q)
