"""Page texts on written-out pages, archives by round trips with planted damage."""

import base64
import hashlib
import io
import random
import time
from collections import Counter

import pytest

from panelspark.llm import html_text, queries, warc
from panelspark.session import scratch_path
from tests.llm.helpers import FOLDER

PAGES = "page_id long, url string, html string, text string, n_chars string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


CASES = [
    ("<p>One<p>Two &amp; three&nbsp;x<br>four", "One\n\nTwo & three x four"),
    ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p><b>Open<br><p>Second</article><footer>f</footer>", "T\n\nOpen\n\nSecond"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<div class='side sidebar-left'>no</div><div id=cookie-notice>no</div><div class=content>yes</div>", "yes"),
    ("<article>a<form>no<input></form><section class=comments><p>no</p></section><p>b</p></article>", "a\n\nb"),
    ("<article><p>x <i>y</i>z</p><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "x yz\n\n1\n\n2\n\n3\n\n4"),
    ("<main><article><p>in main</p></article></main><p>out</p>", "in main"),
    ("<aside><article>no</article></aside><p>yes</p>", "yes"),
    ("<p>a < b and 1<2 &lt;tag&gt; &am &#65;&#x42;</p>", "a < b and 1<2 <tag> &am AB"),
    ("<b><p>bold</b> still</p>", "bold still"),
    ("<header>no</header><article><header><h1>Kept</h1></header>text</article>", "Kept\n\ntext"),
    ("<div role=navigation>no</div><div hidden>kept</div>", "kept"),
    ("plain  text\n\n only", "plain text only"),
    ("<p>cut <a href='x", "cut <a href='x"),
    ("<textarea>no <p></textarea>yes<title>no</title>", "yes"),
    ("", ""),
    (None, ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


STORY = "A long story about many things that happened in the town over the years."
CONTAINERS = [
    f"<form id=aspnetForm><nav>m</nav><article>{STORY}</article></form>",
    f"<div class='layout has-sidebar'><article>{STORY}</article></div>",
    f"<div id=page class='no-ads'><article>{STORY}</article></div>",
    f"<article class='post widget-area'>{STORY}</article>",
    f"<main><p class=notice>{STORY}</p></main>",
    f"<div class=widget-area><p>{STORY}</p></div><div class=sidebar>no</div>",
    f"<form><div id=comments><article>c1</article><article>c2</article></div><article>{STORY}</article></form>",
    f"<article>{STORY}</article><article class='ad'>no</article>",
    f"<div class=page-header><form class=search>no</form></div><article>{STORY}</article><div class=site-footer>no</div>",
    f"<form>{STORY}<div class=comments>{STORY * 3}</div></form>",
    f"<body class='login modal'><header><h1>no</h1></header><p>{STORY}</p></body>",
]


@pytest.mark.parametrize("html", CONTAINERS)
def test_containers_of_the_article_stay(html):
    assert html_text.Page(html).main_text() == STORY


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", '<a "' * 100_000, '<a "' * 100_000 + ">", "<svg/>" * 100_000, "<p>" * 50_000 + "<b>" * 50_000 + "</i>" * 50_000])
def test_parsing_is_linear(html):
    start = time.time()
    html_text.Page(html).main_text()
    assert time.time() - start < 10  # quadratic ways take minutes


def test_counts_alone_find_the_template(spark):
    """No name or class is looked at: what 30 pages of a host share goes, and only that."""
    rows, want = [], {}
    for k in range(60):
        host = k % 2
        top = f"<header><ul><li>Site {host}</li><li>About</li></ul></header><nav class=x><p>Menu {host}</p></nav><aside><p>Popular here {host}</p></aside>"
        foot = f"<footer><p>All rights of {host}</p></footer><div class=cookie><p>We use cookies on {host}</p></div>"
        rows.append((k, f"http://h{host}.example/{k}", f"<html><head><title>t</title></head><body>{top}<article><h1>Title {k}</h1><p>Own text of page {k}.</p><p>More of {k}, and more of it.</p></article>{foot}</body></html>"))
        want[k] = f"Title {k}\n\nOwn text of page {k}.\n\nMore of {k}, and more of it."
    got = {r.page_id: r.text for r in html_text.main_texts(pages(spark, rows), by_name=False).collect()}
    assert got == want


@pytest.mark.parametrize("html,text", CASES)
def test_page_text(html, text):
    assert html_text.Page(html).main_text() == text


def test_query_is_the_generator(spark):
    """The given pages have one article of headings and paragraphs, taken here by plain patterns."""
    import re
    from html import unescape

    rows = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.QUERIES["op2_main_text"](spark, FOLDER).collect()
    assert len(got) == len(rows)
    for r in got:
        body = re.search("<article>(.*?)</article>", rows[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (rows[r.page_id].url, len(r.text))


def test_templates_go_and_quoted_passages_stay(spark):
    rows = []
    for k in range(40):
        top = "<div><span>Site name</span></div><div><p>Call us any time</p></div>"
        body = f"<div><p>Quoted by all pages.</p><p>Own text of page {k} with some more words than the rest of it has here.</p></div>"
        rows.append((k, f"https://User@Host.example:80/p{k}", top + body))
        rows.append((100 + k, f"https://art.example/p{k}", f"{top}<article><p>Quoted by all pages.</p><div class=box>Box</div><p>Own {k}</p></article>"))
    rows += [(200, "https://few.example/", top + "<p>x</p>"), (201, None, top), (202, "no address", None), (None, "https://few.example/", "<p>y</p>"), (200, "https://few.example/", top + "<p>x</p>")]
    got = [(r.page_id, r.text) for r in html_text.main_texts(pages(spark, rows)).collect()]
    want = []
    for k in range(40):
        # Without an article the quoted paragraph looks like template and goes.
        want.append((k, f"Own text of page {k} with some more words than the rest of it has here."))
        want.append((100 + k, f"Quoted by all pages.\n\nOwn {k}"))
    few = "Site name\n\nCall us any time"
    want += [(200, few + "\n\nx"), (200, few + "\n\nx"), (201, few), (202, ""), (None, "y")]
    assert Counter(got) == Counter(want)
    assert html_text.main_texts(pages(spark, rows).limit(0)).count() == 0


def test_copies_of_a_whole_page_keep_their_text(spark):
    html = "<div><p>Menu</p></div><div><p>A story that was copied to many addresses of one site.</p></div>"
    got = {r.text for r in html_text.main_texts(pages(spark, [(k, f"http://a.example/{k}", html) for k in range(30)])).collect()}
    assert got == {"A story that was copied to many addresses of one site."}


A, B, C = ("The first paragraph of a story.", "A second one, about as long.", "And here the third one ends.")
COPIED = [
    f"<div><p>{A}</p><p>{B}</p><p>{C}</p></div>",
    f"<body><p>{A}</p><p>{B}</p><p>{C}</p></body>",
    f"<html><body><nav>{'menu ' * 40}</nav><h1>{A}</h1><div><p>{B}</p><div><p>{C}</p></div></div></body></html>",
    f"<div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p></div>",
    f"<nav>{'menu ' * 40}</nav><article><p class=a>{A}</p><section id=b><p>{B}</p></section><div role=c>{C}</div></article>",
    f"<h1>{A}</h1><div class=content><p>{B}</p><p>{C}</p></div>",
]


@pytest.mark.parametrize("html", COPIED)
def test_copies_keep_every_paragraph(spark, html):
    rows = [(k, f"http://a.example/{k}", html) for k in range(12)]
    got = {r.text for r in html_text.main_texts(pages(spark, rows)).collect()}
    assert got == {f"{A}\n\n{B}\n\n{C}"}


def test_template_around_copies_still_goes(spark):
    """The same box stands in copies and on pages of their own; copies beside it keep their text."""
    box = "<div class=box><p>Call us any time</p></div>"
    copied = f"<div>{box}<p>{A}</p><p>{B}</p><p>{C}</p></div>"
    rows = [(k, f"http://a.example/{k}", copied) for k in range(12)]
    rows += [(100 + k, f"http://a.example/own{k}", f"<div>{box}<p>Own text {k} of some length.</p><p>And more {k}.</p></div>") for k in range(12)]
    got = {r.page_id: r.text for r in html_text.main_texts(pages(spark, rows)).collect()}
    assert got[0] == f"{A}\n\n{B}\n\n{C}" and got[103] == "Own text 3 of some length.\n\nAnd more 3."


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [i for i in groups[payload] if i is not None]
        first = min(ids) if ids else None
        revisit = first is not None and page_id != first
        out[(page_id, len(payload), digest(payload), "revisit" if revisit else "response", first if revisit else None)] += 1
    return out


def test_query_round_trip(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op3_warc"](spark, FOLDER).collect()) == expected(rows)


AWKWARD = [
    (5, "http://a/\r\nX: y", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"),
    (None, "u", "<p>same</p>"), (None, "u", "alone"), (None, "v", "alone"), (7, "u", None), (8, "u", ""), (10, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
    (11, "ü", "é\r\n\r\n" * 1000), (12, "long", "x\x1f y" * 700_000), (-4, "neg", "z"),
]


@pytest.mark.parametrize("packed", [True, False])
def test_awkward_pages(spark, packed):
    df = pages(spark, AWKWARD)
    root = scratch_path(spark, "warc-test")
    files = warc.write_archives(df, root, packed=packed)
    records = warc.read_archives(files, root)
    assert records.where("kind = 'gap'").count() == 0
    assert Counter(tuple(r) for r in warc.page_records(records).collect()) == expected(AWKWARD)
    by_id = {r.fields["warc-record-id"]: bytes(r.payload).decode() for r in records.where("kind = 'response'").collect()}
    assert by_id["<urn:page:12>"] == AWKWARD[11][2] and by_id["<urn:page:11>"] == AWKWARD[10][2]
    assert warc.archived(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_addresses_of_any_length(spark, packed):
    long = "data:text/html," + "xyü" * 350_000
    rows = [(1, "http://a/", "<p>a</p>"), (2, long, "<p>same</p>"), (3, long + "?", "<p>same</p>"), (4, "http://b/", "<p>same</p>")]
    root = scratch_path(spark, "warc-long")
    records = warc.read_archives(warc.write_archives(pages(spark, rows), root, packed=packed), root)
    assert records.where("kind = 'gap'").count() == 0
    assert Counter(tuple(r) for r in warc.page_records(records).collect()) == expected(rows)
    urls = {r.fields["warc-record-id"]: r.fields["warc-target-uri"] for r in records.collect()}
    assert urls["<urn:page:2>"] == long and urls["<urn:page:3>"] == long + "?"


def test_false_marks_before_long_lines():
    """After damage, header lines without end are given up at the bound, all but one address."""
    parts = archive(False, 2)
    line = b"X: " + b"y" * (warc.MAX_HEADER + 10)
    for junk in (b"WARC/1.1\r\n" + line, (b"WARC/1.1\r\nWARC-Target-URI: " + b"z" * 200_000 + b"\r\n") * 3 + b"?", b"WARC/1.1\r\n" + b"A: b\r\n" * 20_000):
        got, gaps = read(parts[0] + junk + parts[1])
        assert got == ids(0, 1) and [g[:2] for g in gaps] == [(len(parts[0]), len(parts[0]) + len(junk))]


def archive(packed, n=8):
    parts = []
    for k in range(n):
        payload = (f"<p>page {k}</p>" * 50).encode()
        data = warc.record("response", k, f"http://a/{k}", payload, None, digest(payload))
        parts.append(warc.member(data) if packed else data)
    return parts


def read(data):
    found = list(warc.salvage(io.BytesIO(data)))
    return [w["warc-record-id"] for k, w in found if k == "record"], [w for k, w in found if k == "gap"]


def ids(*numbers):
    return [f"<urn:page:{k}>" for k in numbers]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 97)
    parts = archive(packed)
    at = [sum(map(len, parts[:k])) for k in range(9)]
    whole = b"".join(parts)
    assert read(whole) == (ids(*range(8)), [])

    hurt = bytearray(whole)
    hurt[at[2] + len(parts[2]) // 2] ^= 0xFF
    got, gaps = read(bytes(hurt))
    assert got == ids(0, 1, 3, 4, 5, 6, 7) and [g[:2] for g in gaps] == [(at[2], at[3])]

    # Two records in a row, a hole, garbage in between, and the end cut off.
    lost = bytearray(whole)
    for k in (3, 4):
        lost[at[k] : at[k] + 6] = b"??????"
    got, gaps = read(bytes(lost))
    assert got == ids(0, 1, 2, 5, 6, 7) and [g[:2] for g in gaps] == [(at[3], at[5])]
    junk = b"\x1f\x8b\x08 garbage WARC/ \x00" * 5
    got, gaps = read(parts[0] + junk + parts[1])
    assert got == ids(0, 1) and [g[:2] for g in gaps] == [(at[1], at[1] + len(junk))]
    got, gaps = read(whole[: at[7] + 40])
    assert got == ids(*range(7)) and [g[:2] for g in gaps] == [(at[7], at[7] + 40)]
    got, gaps = read(whole[10:])
    assert got == ids(*range(1, 8)) and gaps[0][:2] == (0, at[1] - 10)
    assert read(b"") == ([], []) and read(b"no archive")[0] == []


def test_wrong_digest_is_quarantined():
    payload = b"<p>x</p>"
    wrong = warc.record("response", 1, "u", payload, None, digest(b"other"))
    good = warc.record("response", 2, "u", payload, None, digest(payload))
    got, gaps = read(warc.member(wrong) + warc.member(good))
    assert got == ids(2) and gaps[0][2] == "payload digest"


class Counting(io.BytesIO):
    """A stream that remembers how far it has been read."""

    def read(self, n=-1):
        self.reached = self.tell() + n
        return super().read(n)


@pytest.mark.parametrize("packed", [True, False])
def test_search_after_damage_reads_little_ahead(packed):
    rng = random.Random(1)
    payloads = [rng.randbytes(40_000) for _ in range(60)]
    parts = []
    for k, payload in enumerate(payloads * 8):
        data = warc.record("response", k, "u", payload, None, digest(payload))
        parts.append(warc.member(data, 1) if packed else data)
    hurt = bytearray(parts[1])
    hurt[200] ^= 0xFF
    stream = Counting(parts[0] + bytes(hurt) + b"".join(parts[2:]))
    found = warc.salvage(stream)
    seen = [next(found) for _ in range(3)]
    assert [k for k, _ in seen] == ["record", "gap", "record"] and stream.reached < 4 * warc.READ_BYTES
    assert len([k for k, _ in found if k == "record"]) == len(parts) - 3


def test_many_false_marks_cost_little():
    parts = archive(True, 40)
    junk = (warc.MEMBER + b"no member at all" + b"WARC/ no record" + bytes(2000)) * 3000
    start = time.time()
    got, gaps = read(parts[0] + junk + b"".join(parts[1:]))
    assert got == ids(*range(40)) and len(gaps) == 1 and time.time() - start < 20


def test_member_of_several_records(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 501)
    plain = archive(False, 6)
    alone = archive(True, 8)
    data = alone[0] + warc.member(b"".join(plain[1:5])) + alone[7]
    assert read(data) == (ids(0, 1, 2, 3, 4, 7), [])
    # A record whose digest differs is left out of the member, the others are not.
    wrong = plain[2].replace(b"page 2", b"page ?")
    got, gaps = read(alone[0] + warc.member(plain[1] + wrong + plain[3] + plain[4]) + alone[7])
    assert got == ids(0, 1, 3, 4, 7) and len(gaps) == 1 and gaps[0][2] in ("digest", "payload digest")
    # A broken end of such a member costs what cannot be inflated.
    cut = warc.member(b"".join(plain[1:5]))
    got, gaps = read(alone[0] + cut[: len(cut) * 2 // 3] + alone[7])
    assert got[0] == ids(0)[0] and got[-1] == ids(7)[0] and len(gaps) == 1
