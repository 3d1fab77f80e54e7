"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language inside each task and sums the partial counts
with Spark; the driver receives one row per language and used bucket, whatever the number of documents.
The matrix of log probabilities is broadcast, and batches of texts are scored as sparse rows: gather the
matrix rows of all n-grams of a block, then sum them per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, column

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
# More languages than this are refused: it bounds the broadcast matrix (BUCKETS * 4 bytes each).
MAX_LANGUAGES = 512
BLOCK_CHARS = 200_000
UNKNOWN = "und"

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _prepared(text: str) -> np.ndarray:
    """Lower-case letters as code points, every run of other characters as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, np.uint32(32))[keep]


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included; none if it has no letter."""
    codes = _prepared(text or "")
    if len(codes) == 0:
        return np.zeros(0, dtype=np.int32)
    # A blank on each side, so that word ends at the text's ends count as such.
    codes = np.concatenate([[32], codes, [32]] if codes[-1] != 32 else [[32], codes]).astype(np.uint32)
    out = []
    for order in ORDERS:
        if len(codes) >= order:
            value = np.full(len(codes) - order + 1, order, dtype=np.uint32)
            for k in range(order):
                value = (value ^ codes[k : k + len(value)]) * np.uint32(_MULTIPLIERS[k])
                value ^= value >> np.uint32(15)
            out.append(value % np.uint32(buckets))
    return np.concatenate(out).astype(np.int32)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush():
        for lang, row in sums.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(row[used])], ["lang", "bucket", "n"]
            )
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in sums and len(sums) >= MAX_LANGUAGES:
                yield from flush()
            row = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
            row[:BUCKETS] += np.bincount(features(text.as_py()), minlength=BUCKETS)
            row[BUCKETS] += 1
    yield from flush()


class Model:
    """Languages in order, and the log probability of each bucket (buckets x languages); the last row is the log prior."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows of ``df`` that name a language; null texts teach nothing.

    The prior of a language is its share of these rows.
    """
    bound_batches(df.sparkSession)
    rows = df.select(column(lang).alias("lang"), column(text).alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(_count_task, "lang string, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toPandas()
    langs = sorted(got["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((BUCKETS + 1, len(langs)), SMOOTHING)
    counts[BUCKETS] = 0
    at = {x: k for k, x in enumerate(langs)}
    counts[got["bucket"].to_numpy(dtype=np.int64), got["lang"].map(at).to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=float)
    if langs:
        counts[:BUCKETS] /= counts[:BUCKETS].sum(axis=0)
        counts[BUCKETS] /= counts[BUCKETS].sum()
        counts = np.log(counts)
    return Model(langs, counts.astype(np.float32))


def _scored(texts: list, model: Model) -> list[tuple[str, float]]:
    """Best language and its posterior for each text, in blocks of bounded size."""
    out: list[tuple[str, float]] = []

    def settle(block):
        sizes = np.array([len(f) for f in block])
        used = np.flatnonzero(sizes)
        answers = [(UNKNOWN, 0.0)] * len(block)
        if len(used) and model.langs:
            begins = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            sums = np.add.reduceat(model.log_p[np.concatenate([block[k] for k in used])], begins, axis=0, dtype=np.float64)
            sums += model.log_p[BUCKETS]
            best = sums.argmax(axis=1)
            share = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b, s in zip(used, best, share):
                answers[k] = model.langs[b], float(s)
        out.extend(answers)

    block, held = [], 0
    for text in texts:
        block.append(features(text))
        held += len(block[-1])
        if held >= BLOCK_CHARS:
            settle(block)
            block, held = [], 0
    settle(block)
    return out


def predicted(text: Column, model) -> Column:
    """A struct (lang_pred, score) of a text column; ``model`` is a broadcast ``Model``."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(_scored(list(texts), model.value), columns=["lang_pred", "score"])

    return run(text)


def identify(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, language, posterior.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if
    the model has learned no language.  Of equal posteriors the first language by name wins.
    Null ids pass through, repeated rows are scored each, other columns are left out.
    """
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    scored = df.select(column(id).alias("doc_id"), predicted(column(text), shared).alias("p"))
    return scored.select("doc_id", "p.*")


def held_out(id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(id.cast("string"), F.lit("")), "UTF-8")) % folds == 0
