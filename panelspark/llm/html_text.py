"""Main text of web pages by removing site templates.

Every element subtree of a page is hashed (names, classes, text and children, not link targets).  Spark counts
per host on how many pages each subtree stands; subtrees that recur across many pages of a
host are its template and are deleted, wherever they stand outside the article.  Elements whose name, role or
class says that they are no article (menus, adverts, forms, comments) are deleted as
well, which is all there is to go by on hosts with few pages; a form, header or marked container
that holds the article, or most of a page without one, stays.  Inside an article only marked
containers can be template, so a passage that many pages quote stays.

Copies of one page or article at many addresses count as one page, so that they do not make a
template of their own text.  Only containers beside the element that makes up most of the page count at each address.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, column
from panelspark.session import written

# A subtree on at least so many pages of a host belongs to its template.
MIN_PAGES = 10

_RAW = r"<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|noembed|xmp)\b"
_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _markup(attributes: str) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|{_RAW}(?P<void>{attributes})>"
        rf"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{attributes})>"
        r"|<[!?/][^>]*+(?:>|\Z)",
        re.DOTALL | re.IGNORECASE,
    )


# Behind a quote that nothing closes, tags end at the next ">", quoted or not.
_MARKUP, _UNQUOTED = _markup(_QUOTED), _markup("[^>]*+")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[-_:]+")

_set = lambda text: frozenset(text.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
BLOCK = _set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
)
# What an opening tag ends: the innermost open element of these names, if none of the fences is nearer.
_ENDS = {
    "li": (_set("li"), _set("ul ol menu dir")),
    "dt": (_set("dt dd"), _set("dl")),
    "dd": (_set("dt dd"), _set("dl")),
    "tr": (_set("tr td th"), _set("table")),
    "td": (_set("td th"), _set("table tr")),
    "th": (_set("td th"), _set("table tr")),
    "option": (_set("option"), _set("select")),
}
_P = (_set("p"), _set("td th caption table button"))
ROOTS = _set("article main")
NO_TEXT = _set("head nav footer aside button select dialog menu object canvas")
# No text either, but for pages that put all they have into one.
SOFT = _set("form fieldset header")
# Names that mark an element as no part of an article: a whole class, id or role, or its first or last part.
MARKS = _set(
    "nav navbar navigation menu menubar sidebar complementary footer contentinfo masthead topbar banner ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup popup modal overlay share sharing social related recommended recommendations breadcrumb breadcrumbs pagination "
    "pager toolbar widget search login"
)
COMMENTS = _set("comment comments commentlist disqus replies respond")
# A name that starts so says something about an element around or beside the marked one.
_ABOUT = _set("has have with without no not is show shows hide hides js")
_FREE = _set("html body main")
# Beside the element that makes up most of a page these are its text and not a container of their own.
_FLOW = _set("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure")


def any_within(roots: list[tuple[int, int]], starts: list[int], start: int, end: int) -> bool:
    """Whether a span lies inside one of the articles."""
    at = bisect_right(starts, start) - 1
    return at >= 0 and roots[at][1] >= end


def marked(names: list[str]) -> frozenset[str]:
    """Marks among class names, ids and roles."""
    found = set()
    for name in names:
        parts = [p for p in _NAME_PARTS.split(name) if p]
        if parts and parts[0] not in _ABOUT:
            found.update((MARKS | COMMENTS).intersection((name, parts[0], parts[-1])))
    return frozenset(found)


HARD_REMOVAL, SOFT_REMOVAL = 1, 2


class _Open:
    __slots__ = ("name", "label", "start", "parts", "removal", "root", "holds_root", "place")

    def __init__(self, name: str, label: str, start: int, removal: int, root: bool, place: int):
        self.place = place
        self.name, self.label, self.start, self.removal, self.root = name, label, start, removal, root
        self.parts: list[bytes] = [name.encode(), label.encode("utf-8", "replace")]
        self.holds_root = False


class Page:
    """One page taken apart: text pieces with block breaks (None), and ranges of its elements."""

    def __init__(self, html: str | None, by_name: bool = True):
        self.by_name = by_name
        self.pieces: list[str | None] = []
        self.removed: list[tuple[int, int]] = []  # by name or mark
        self.subtrees: list[tuple[int, int, int]] = []  # hash, start, end
        self.roots: list[tuple[int, int]] = []
        self._elements: list[tuple[str, int, bool, int, int]] = []  # name, place of the parent, removed or root, start, end
        self._owners: list[int] = []  # places of the subtrees' elements
        self._removals: list[tuple[int, int]] = []  # place, kind
        self._root_places: list[int] = []
        self._stack: list[_Open] = []
        self._at: dict[str, list[int]] = {}  # open elements by name: their heights in the stack
        self._blocks: list[int] = []  # heights of open blocks
        self._inside_root = self._inside_hard = 0
        self._read(html or "")
        while self._stack:
            self._close()
        self._resolve()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self._stack and (bare := " ".join(text.split())):
            self._stack[-1].parts.append(bare.encode("utf-8", "surrogatepass"))

    def _break(self) -> None:
        if self.pieces and self.pieces[-1] is not None:
            self.pieces.append(None)

    def _open(self, name: str, attrs: str) -> None:
        label, marks = "", frozenset()
        if attrs and "=" in attrs:
            values = [unescape("".join(m[1:])) for m in _ATTRIBUTE.findall(attrs)]
            label = " ".join(" ".join(values).split())
            marks = marked(label.lower().split())
        removal, root = HARD_REMOVAL if name == "head" else 0, False
        if self.by_name:
            if name in NO_TEXT or (marks & COMMENTS and name not in _FREE | ROOTS):
                removal = HARD_REMOVAL
            elif (marks and name not in _FREE) or (name in SOFT and (name != "header" or not self._inside_root)):
                removal = SOFT_REMOVAL
            root = name in ROOTS and not self._inside_root and not self._inside_hard
        height = len(self._stack)
        parent = self._stack[-1].place if self._stack else -1
        self._stack.append(_Open(name, label, len(self.pieces), removal, root, len(self._elements)))
        self._at.setdefault(name, []).append(height)
        if name in BLOCK:
            self._blocks.append(height)
        self._elements.append((name, parent, False, len(self.pieces), -1))
        self._inside_root += root
        self._inside_hard += removal == HARD_REMOVAL

    def _close(self) -> None:
        x = self._stack.pop()
        self._at[x.name].pop()
        if x.name in BLOCK:
            self._blocks.pop()
            self._break()
        end = len(self.pieces)
        self._elements[x.place] = (*self._elements[x.place][:4], end)
        digest = blake2b(b"\0".join(x.parts), digest_size=8).digest()
        if self._stack:
            self._stack[-1].parts.append(digest)
            self._stack[-1].holds_root |= x.holds_root or x.root
        if x.root:
            self._inside_root -= 1
            self._root_places.append(x.place)
        if x.removal:
            self._removals.append((x.place, x.removal))
            self._inside_hard -= x.removal == HARD_REMOVAL
        if x.name not in BLOCK or x.root or x.holds_root or x.name in ("html", "body", "head") or len(x.parts) < 3:
            return
        if x.label or not self._inside_root:
            self.subtrees.append((int.from_bytes(digest, "little", signed=True), x.start, end))
            self._owners.append(x.place)

    def _resolve(self) -> None:
        """What goes by name or mark: all but a form, header or marked container that holds the article or most of the page.

        Outermost elements first; an element stays when the articles left are all inside it, or,
        if there are none, when it holds more than half of the text left.
        """
        chars = np.array([0] + [len(p.strip()) if p else 0 for p in self.pieces]).cumsum()
        hard = [p for p, kind in self._removals if kind == HARD_REMOVAL]
        spans = sorted((self._elements[p][3], -self._elements[p][4], p) for p in hard)
        gone: list[tuple[int, int]] = []  # outermost removed spans, in order
        for start, end, _ in spans:
            if not gone or start >= gone[-1][1]:
                gone.append((start, -end))
        lost = np.zeros(len(self.pieces) + 1, dtype=np.int64)
        for start, end in gone:
            lost[start] += 1
            lost[end] -= 1
        held = np.array([0] + [0 if out else len(p.strip()) if p else 0 for p, out in zip(self.pieces, np.cumsum(lost[:-1]))]).cumsum()
        roots = sorted((self._elements[p][3], self._elements[p][4]) for p in self._root_places)
        total, live = int(held[-1]), len(roots)
        removed = set(hard)
        soft = sorted((self._elements[p][3], -self._elements[p][4], p) for p, kind in self._removals if kind == SOFT_REMOVAL)
        starts = [r[0] for r in roots]
        until = -1
        for start, end, place in soft:
            end = -end
            if end <= until:
                removed.add(place)
                continue
            inside = bisect_left(starts, end) - bisect_left(starts, start) if end > start else 0
            text = int(held[end] - held[start])
            within = any_within(roots, starts, start, end)
            if (live and inside == live) or (within or not live) and 2 * text > total:
                continue
            removed.add(place)
            live, total, until = live - inside, total - text, end
        self.removed = [(self._elements[p][3], self._elements[p][4]) for p in sorted(removed)]
        cut = np.zeros(len(self.pieces) + 1, dtype=np.int64)
        for start, end in self.removed:
            cut[start] += 1
            cut[end] -= 1
        out = np.cumsum(cut)
        kept = {p for p in self._root_places if not out[self._elements[p][3]] or self._elements[p][3] == self._elements[p][4]}
        self.roots = [(self._elements[p][3], self._elements[p][4]) for p in self._root_places if p in kept]
        for p in removed | kept:
            name, parent, _, start, end = self._elements[p]
            self._elements[p] = (name, parent, True, start, end)

    def _nearest(self, names: frozenset[str]) -> int:
        """Height of the innermost open element of these names, or -1."""
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=-1)

    def _close_for(self, name: str) -> None:
        """Ends that an opening tag implies."""
        for rule in (_ENDS.get(name), _P if name in BLOCK else None):
            if rule is None:
                continue
            ends, fences = rule
            at = self._nearest(ends)
            if at >= 0 and at > self._nearest(fences - ends):
                while len(self._stack) > at:
                    self._close()

    def _end(self, name: str) -> None:
        at = self._nearest(frozenset((name,)))
        if at < 0 or (name not in BLOCK and self._blocks and self._blocks[-1] > at):
            return  # an inline end does not close blocks
        while len(self._stack) > at:
            self._close()

    def _read(self, html: str) -> None:
        at = text = 0
        lower, markup, unclosed = None, _MARKUP, set()
        last = html.rfind(">")
        while True:
            at = html.find("<", at)
            if at < 0:
                self._text(html[text:])
                return
            if at > last and html[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1  # no tag ends from here on
                continue
            m = markup.match(html, at)
            if not m and at < last and html[at + 1 : at + 2].isalpha():
                markup = _UNQUOTED
                m = markup.match(html, at)
            if not m:
                at += 1
                continue
            self._text(html[text:at])
            at = text = m.end()
            if m["raw"]:
                # Raw text runs to its own end tag, whatever looks like markup in it.
                name = m["raw"].lower()
                void = m["void"].endswith("/")
                if name in unclosed or (void and name == "svg"):
                    at = text = at if void else len(html)
                    continue
                if lower is None:
                    lower = html.lower()
                    lower = lower if len(lower) == len(html) else html
                close = lower.find("</" + name, at)
                if close < 0:
                    unclosed.add(name)
                    at = len(html) if not void else at
                else:
                    stop = html.find(">", close)
                    at = stop + 1 if stop >= 0 else len(html)
                text = at
            elif m["name"]:
                name = m["name"].lower()
                if m["end"]:
                    self._end(name)
                    if name in BLOCK:
                        self._break()
                    continue
                self._close_for(name)
                if name in BLOCK:
                    self._break()
                if name in VOID:
                    if name == "br":
                        self._text(" ")
                    continue
                self._open(name, m["attrs"])

    def _text_hash(self, start: int, end: int, stays: np.ndarray) -> int:
        """A hash of the words between two pieces that are not removed by name or mark."""
        words = " ".join("".join(" " if p is None else p for p, kept in zip(self.pieces[start:end], stays[start:end]) if kept).split())
        return int.from_bytes(blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def copies(self) -> list[int | None]:
        """Per subtree a hash of what it stands in, the article or the page; None if it counts at each address."""
        chars = np.array([0] + [len(p) if p else 0 for p in self.pieces]).cumsum()
        gone = np.zeros(len(self.pieces) + 1, dtype=np.int64)
        for start, end in self.removed:
            gone[start] += 1
            gone[end] -= 1
        stays = np.cumsum(gone[:-1]) == 0
        roots = {span: self._text_hash(*span, stays) for span in self.roots}
        page = self._text_hash(0, len(self.pieces), stays)
        # Outermost element with most of the page's text, and all around it.
        most, around = -1, {-1}
        for k, (name, parent, other, start, end) in enumerate(self._elements):
            if parent in around and not other and 2 * int(chars[end] - chars[start]) > int(chars[-1]):
                if name not in ("html", "body"):
                    most = k
                    break
                around.add(k)
        around |= {k for k, e in enumerate(self._elements) if e[0] in ("html", "body") and e[1] in around}
        within: list[int | None] = []
        for k, (name, parent, _, start, end) in enumerate(self._elements):
            if (start, end) in roots:
                within.append(roots[start, end])
            elif parent not in around:
                within.append(within[parent])
            else:
                within.append(page if most in (-1, k) or k in around or name in _FLOW else None)
        return [within[k] for k in self._owners]

    def main_text(self, template: frozenset[int] = frozenset()) -> str:
        """Blocks of the article, or of the whole body where no article is marked."""
        chars = np.array([0] + [len(p) if p else 0 for p in self.pieces]).cumsum()
        gone = np.zeros(len(self.pieces) + 1, dtype=np.int64)

        def drop(start, end):
            gone[start] += 1
            gone[end] -= 1

        for start, end in self.removed:
            drop(start, end)
        for h, start, end in self.subtrees:
            # What makes up most of a page is its content, however often it is copied.
            if h in template and 2 * int(chars[end] - chars[start]) <= int(chars[-1]):
                drop(start, end)
        stays = np.cumsum(gone[:-1]) == 0
        if self.roots:
            inside = np.zeros(len(self.pieces), dtype=bool)
            for start, end in self.roots:
                inside[start:end] = True
            stays &= inside
        blocks: list[str] = []
        now: list[str] = []
        for piece, kept in zip(self.pieces, stays):
            if piece is None or not kept:
                if piece is None and now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
                continue
            now.append(piece)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n\n".join(b for b in blocks if b)


def host_of(url: Column) -> Column:
    """Lower-case host of an address; null where it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _subtrees(by_name: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, copies = [], [], []
            for k, html in enumerate(batch.column(1)):
                page = Page(html.as_py(), by_name)
                found: dict[int, int | None] = {}
                for (h, _, _), c in zip(page.subtrees, page.copies()):
                    # Of several places of a subtree one that counts at each address goes first.
                    if found.get(h, 0) is not None:
                        found[h] = c
                rows += [k] * len(found)
                hashes += found
                copies += found.values()
            taken = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(hashes, pa.int64()), pa.array(copies, pa.int64())], ["row", "subtree", "copy"])

    return run


def _extracted(html: Column, template: Column, by_name: bool) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, templates in batches:
            yield pd.Series([Page(h, by_name).main_text(frozenset(() if t is None else t.tolist())) for h, t in zip(pages, templates)], dtype=object)

    return run(html, template)


def main_texts(
    df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, by_name: bool = True
) -> DataFrame:
    """Per input row: page_id, url, text, n_chars (code points), n_template (template subtrees found).

    Null and empty pages have empty text.  Pages without a host share no template.  Null ids
    pass through; a repeated row is extracted each time and counts like a copy at one more address; other columns
    are left out.  An empty table gives an empty result.  Without ``by_name`` no name, class or
    role decides anything: what recurs on a host goes, all else stays.
    """
    bound_batches(df.sparkSession)
    row = F.xxhash64(column(id), column(url), column(html))
    pages = df.select(column(id).alias("page_id"), column(url).alias("url"), column(html).alias("html"), row.alias("row"))
    found = pages.where(host_of(F.col("url")).isNotNull() & F.col("html").isNotNull()).select(F.struct("row", host_of(F.col("url")).alias("host")).alias("row"), "html")
    found = found.mapInArrow(_subtrees(by_name), "row struct<row:long,host:string>, subtree long, copy long")
    keyed = found.select("row.row", F.xxhash64("row.host", "subtree").alias("site"), "subtree", "copy")
    keyed, _ = written(keyed, "subtrees")
    often = keyed.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages).select("site")
    # Copies with one text count as one page.
    apart = keyed.join(often, "site").groupBy("site", "copy").agg(F.count(F.lit(1)).alias("n"))
    pages_of = F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("pages")
    common = apart.groupBy("site").agg(pages_of).where(F.col("pages") >= min_pages).select("site")
    # A page's own list: as long as the page has subtrees.
    lists = keyed.join(common, "site").groupBy("row").agg(F.collect_set("subtree").alias("template"))
    joined = pages.join(lists, "row", "left")
    text = joined.select("page_id", "url", _extracted(F.col("html"), F.col("template"), by_name).alias("text"), F.coalesce(F.size("template"), F.lit(0)).alias("n_template"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
