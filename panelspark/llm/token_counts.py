"""Exact token counts at every prefix of a text.

Let ``c[i]`` be the count of the first ``i`` chunks (chunk: a run between ASCII blanks).
No token of the vocabulary and no rule of its normaliser reaches across a blank, so
``c[i] = c[i-1] + tokens(chunk i)``: one forward pass of dynamic programming fills the table, each
distinct chunk is encoded once per worker, and the table answers counts of whole texts, of
any prefix (one partial chunk more), and a long prefix within a budget, cut at a token's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, column, fresh

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
# Chunks, and pieces of chunks, that a worker remembers at least (and twice that at most), and the longest worth it.
REMEMBERED = 200_000
MEMO_CHARS = 64

# How this tokenizer's file cuts lower-case text into pieces.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Below this code point and printable, lower case and the classes above leave no room for doubt.
_PLAIN_BELOW = "\u0250"

_coders: dict[str, _Coder] = {}


class _Memo:
    """Counts by text in two generations: what is not asked for while one fills up is forgotten."""

    def __init__(self):
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def missing(self, texts) -> list[str]:
        """Texts without a count; counts of the old generation move to the new one."""
        out = []
        for t in texts:
            if t not in self.new:
                if t in self.old:
                    self.new[t] = self.old[t]
                else:
                    out.append(t)
        return out

    def age(self) -> None:
        if len(self.new) > REMEMBERED:
            self.new, self.old = {}, self.new


class _Coder:
    """A tokenizer of a worker, with its memos."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.pieces = _Memo(), _Memo()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def whole(self, texts: list[str]) -> list[int]:
        """Counts by the library, text by text."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> None:
        """Count pieces in one run: each of them ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.int64)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            self.pieces.new.update(zip(pieces, self.whole(pieces)))
        else:
            self.pieces.new.update(zip(pieces, np.diff(stops, prepend=0).tolist()))

    def of_chunks(self, chunks: list[str]) -> None:
        """Count chunks that are not remembered: plain ones by their pieces, others by the library."""
        plain, other = [], []
        for c in chunks:
            if c.isprintable() and max(c) < _PLAIN_BELOW and "<|" not in c and normalize("NFC", c) == c:
                plain.append((c, _PIECE.findall(c.lower())))
            else:
                other.append(c)
        if other:
            self.chunks.new.update(zip(other, self.whole(other)))
        if new := self.pieces.missing({p for _, pieces in plain for p in pieces}):
            self.of_pieces(new)
        known = self.pieces.new
        self.chunks.new.update((c, sum([known[p] for p in pieces])) for c, pieces in plain)
        self.pieces.age()


def _coder(path: str) -> _Coder:
    if path not in _coders:
        _coders[path] = _Coder(path)
    return _coders[path]


def chunk_counts(chunks: list[str], path: str) -> np.ndarray:
    """Tokens of each chunk."""
    coder = _coder(path)
    kinds = set(chunks)
    long = {c for c in kinds if len(c) > MEMO_CHARS}
    kinds -= long
    memo = coder.chunks
    if new := memo.missing(kinds):
        coder.of_chunks(new)
    known = memo.new
    if long:
        own = dict(zip(long, coder.whole(list(long))))
        counts = [own[c] if c in own else known[c] for c in chunks]
    else:
        counts = map(known.__getitem__, chunks)
    out = np.fromiter(counts, dtype=np.int64, count=len(chunks))
    memo.age()
    return out


class PrefixCounts:
    """The table of one text: ``ends[i]`` code points hold ``counts[i]`` tokens."""

    def __init__(self, text: str | None, path: str):
        self.text, self.path = text or "", path
        pieces = self.text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1) - 1
        used = [k for k, p in enumerate(pieces) if p]
        chunks = [pieces[k] for k in used]
        self.ends = np.concatenate([[0], ends[used]]).astype(np.int64)
        self.begins = self.ends[1:] - np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self.counts = np.concatenate([[0], np.cumsum(chunk_counts(chunks, path))]).astype(np.int64)

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        k = int(np.searchsorted(self.ends, chars, side="right")) - 1
        if k == len(self.begins) or chars <= self.begins[k]:
            return int(self.counts[k])
        part = self.text[self.begins[k] : chars]
        return int(self.counts[k] + chunk_counts([part], self.path)[0])

    def longest(self, budget: int) -> int:
        """Code points of a long prefix that fits ``budget`` tokens: all whole chunks, then all of the next one up to a token's end.

        A prefix cut inside a chunk is taken only if it counts as fitting itself.
        """
        k = int(np.searchsorted(self.counts, budget, side="right")) - 1
        room = budget - int(self.counts[k])
        if k == len(self.begins) or room <= 0:
            return int(self.ends[k])
        begin = int(self.begins[k])
        chunk = self.text[begin : int(self.ends[k + 1])]
        tokenizer = _coder(self.path).tokenizer
        ends = [end for _, end in tokenizer.encode(chunk, add_special_tokens=False).offsets[:room]]
        # A cut may split what the whole chunk has as one token, seldom more than one or two.
        while ends and len(tokenizer.encode(chunk[: ends[-1]], add_special_tokens=False).ids) > room:
            ends.pop()
        return begin + ends[-1] if ends and ends[-1] else int(self.ends[k])


def _counts(text: Column, path: str, limit: int) -> Column:
    @F.pandas_udf("n_tokens long, fit_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            tables = (PrefixCounts(t, path) for t in texts)
            yield pd.DataFrame([(t.total(), t.longest(limit)) for t in tables], columns=["n_tokens", "fit_chars"])

    return run(text)


def prefix_tables(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id and the table itself: ``ends`` and ``counts``, both starting at 0."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("ends array<long>, counts array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            tables = [PrefixCounts(t, path) for t in texts]
            yield pd.DataFrame({"ends": [t.ends.tolist() for t in tables], "counts": [t.counts.tolist() for t in tables]})

    return df.select(column(id).alias("doc_id"), run(column(text)).alias("t")).select("doc_id", "t.*")


def count_tokens(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, bytes, tokens, whether over ``limit``, and the code points that fit it.

    A null text counts as empty: no bytes, no tokens.  Null ids pass through, repeated rows
    are counted each, other columns are left out, an empty table gives an empty result.
    ``path`` must be readable where tasks run (an installed package or a shared folder).
    """
    bound_batches(df.sparkSession)
    body = column(text)
    t = fresh(df, "t")
    size = F.octet_length(F.coalesce(body, F.lit(""))).cast("long")
    counted = df.select(column(id).alias("doc_id"), size.alias("n_bytes"), _counts(body, path, limit).alias(t))
    return counted.select(
        "doc_id",
        "n_bytes",
        F.col(t)["n_tokens"].alias("n_tokens"),
        (F.col(t)["n_tokens"] > limit).alias("over_limit"),
        F.col(t)["fit_chars"].alias("fit_chars"),
    )
