"""Per-text operators against plain counting and against the library itself."""

import zlib
from collections import Counter

import pytest

from panelspark.llm import langid, quality, queries, token_counts
from tests.llm.helpers import FOLDER, WORD, awkward, documents


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    repeat = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), failed


def coverage(words, n):
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    inside = {k + j for k, g in enumerate(grams) if g in twice for j in range(n)}
    return sum(len(words[k]) for k in inside)


def verdict(text):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    if any(100 * coverage(words, n) > limit * chars for n, limit in quality.NGRAM_LIMITS.items()):
        return False
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            dup += sum(map(len, WORD.findall(line)))
        seen.add(line)
    return 100 * dup <= quality.LINE_LIMIT * chars


def hold(rows, texts):
    assert len(rows) == len(texts)
    want = Counter((i, *base(t), not base(t)[-1] and verdict(t)) for i, t in texts)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows)
    assert got == want


def test_quality_query_is_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    hold(queries.QUERIES["op9_quality"](spark, FOLDER).collect(), texts)


def test_quality_awkward_rows(spark):
    line = "one line of ten plain words that stands here twice\n"
    rows = awkward() + [(20, line * 12, "en", "a"), (21, "a b c a b c a b c " * 30, "en", "a"), (22, "x y\n\n\nx y\n \n \nz", "en", "a")]
    df = documents(spark, rows)
    hold(quality.quality_report(df).collect(), [(r[0], r[1]) for r in rows])
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if not base(r[1])[-1] and verdict(r[1]))
    assert quality.quality_report(df.limit(0)).count() == 0


def test_many_kinds_of_words_keep_triples_exact(monkeypatch):
    import numpy as np

    ids = np.array([5, 6, 7, 5, 6, 7, 8, 5, 6])
    small = quality._exact_triples(ids, 9)
    large = quality._exact_triples(ids, (1 << 20) + 1)
    assert (quality._repeated(small) == quality._repeated(large)).all()


PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_token_query_is_the_library(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_tokens"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


AWKWARD_TEXTS = [
    "<|endoftext|> and <|startoftext|>x<|endoftext|>",
    "don't we'll I'M they've 'sx",
    "áb  é\n̸x  y z \x85q \x1cr\x1f",
    "ΣΑΣ ΌΣΟΣ İstanbul ﬁ ǅ ß",
    "tabs\tand\r\nlines\x0bvertical\x0cfeeds",
    "x" * 500 + " " + "!?" * 200,
    "汉字 かな 한국어 😀👩‍👩‍👧 12 345,6",
    "",
    " \n\t ",
]


def test_prefix_table_answers_every_prefix(tokenizer):
    for text in AWKWARD_TEXTS:
        table = token_counts.PrefixCounts(text, PATH)
        for k in range(len(text) + 1):
            assert table.at(k) == len(tokenizer.encode(text[:k], add_special_tokens=False).ids), (text, k)
        assert table.total() == table.at(len(text))
        for budget in (0, 1, 3, 10, 10_000):
            k = table.longest(budget)
            assert table.at(k) <= budget


@pytest.mark.parametrize("text", ["数据处理系统" * 4000, "YWJjZGVm" * 3000, "a-b_c.d/" * 2000, "word " * 100 + "supercalifragilistic" * 400])
def test_longest_prefix_of_texts_without_blanks(text, tokenizer):
    table = token_counts.PrefixCounts(text, PATH)
    assert table.total() > 2048 or text.startswith("word")
    budget = min(2048, table.total() - 5)
    k = table.longest(budget)
    assert 0 < k < len(text) and budget - 8 <= table.at(k) <= budget
    assert table.longest(table.total()) == len(text)


def test_tokens_awkward_rows(spark, tokenizer):
    rows = awkward() + [(100 + k, t, "en", "s") for k, t in enumerate(AWKWARD_TEXTS)]
    df = documents(spark, rows)
    got = Counter(tuple(r)[:4] for r in token_counts.count_tokens(df, PATH).collect())
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 2048) for r in rows)
    tables = token_counts.prefix_tables(df.where("doc_id = 1"), PATH).collect()
    assert tables[0].counts[-1] == count(rows[0][1]) and len(tables[0].ends) == len(tables[0].counts)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_memo_overflow_and_long_chunks(monkeypatch, tokenizer):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    text = "one two three four five six seven one two " + "y" * 100
    for _ in range(2):
        assert token_counts.PrefixCounts(text, PATH).total() == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_language_query_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.98 * len(out)


def test_language_awkward_rows(spark):
    df = documents(spark, awkward())
    model = langid.train(df)
    assert model.langs == ["de", "en", "fr"]
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.identify(df, model).collect()}
    assert {(3, "und", False), (4, "und", False), (5, "und", False), (None, "und", False), (10, "und", False), (9, "de", True)} <= got
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.train(df.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, none).collect()} == {("und", 0.0)}


def test_language_model_is_the_plain_count(spark):
    import numpy as np

    rows = [(1, "abba cab", "x", "s"), (2, "dad", "y", "s"), (3, None, "y", "s"), (4, "zzz", None, "s")]
    model = langid.train(documents(spark, rows))
    counts = np.stack([np.bincount(langid.features(t), minlength=langid.BUCKETS) for t in ("abba cab", "dad")], axis=1) + langid.SMOOTHING
    assert np.allclose(model.log_p[:-1], np.log(counts / counts.sum(axis=0)), atol=1e-5)
    assert np.allclose(model.log_p[-1], np.log([0.5, 0.5]), atol=1e-6)


def test_posteriors_are_those_of_the_model(spark):
    """Prior times likelihoods over plain counts, language by language."""
    import math

    rows = [(k, t, x, "s") for k, (t, x) in enumerate([("the cat sat", "en"), ("the dog", "en"), ("a hat the", "en"), ("der hund", "de"), ("le chat", "fr")])]
    model = langid.train(documents(spark, rows))
    counts, prior = {}, Counter(r[2] for r in rows)
    for _, text, lang, _ in rows:
        counts.setdefault(lang, Counter()).update(langid.features(text).tolist())
    texts = ["the", "hund", "chat le", "zzz", "cat der", "x"]
    got = {r.doc_id: r for r in langid.identify(documents(spark, [(k, t, None, "s") for k, t in enumerate(texts)]), model).collect()}
    for k, text in enumerate(texts):
        score = {}
        for lang, seen in counts.items():
            total = sum(seen.values()) + langid.SMOOTHING * langid.BUCKETS
            score[lang] = math.log(prior[lang] / len(rows)) + sum(math.log((seen[f] + langid.SMOOTHING) / total) for f in langid.features(text).tolist())
        best = max(sorted(score), key=score.get)
        assert got[k].lang_pred == best
        assert abs(got[k].score - 1 / sum(math.exp(v - score[best]) for v in score.values())) < 1e-4
    assert got[5].lang_pred == "en"  # nothing known about it: the prior decides
