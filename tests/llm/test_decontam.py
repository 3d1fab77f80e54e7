"""Leaks against a plain tiling, reordered passages and clean texts."""

import random
from collections import Counter

from panelspark.llm import decontam, queries
from tests.llm.helpers import FOLDER, PROSE, awkward, documents


def plain_tiling(doc, item, least):
    """Covered item tokens by the textbook loop: the longest unmarked common run first."""
    used_d, used_t, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for t in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and t + n < len(item) and doc[d + n] == item[t + n] and d + n not in used_d and t + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, d, t)
        n, d, t = best
        if n < least:
            return covered
        used_d |= set(range(d, d + n))
        used_t |= set(range(t, t + n))
        covered += n


def brute(docs, items):
    out = Counter()
    kinds = {}
    for item_id, text in set(items):
        words = decontam.tokens(text)
        if words:
            kinds.setdefault((item_id, text), words)
    for doc_id, text in docs:
        words = decontam.tokens(text)
        for (item_id, _), item in kinds.items():
            if not set(words) & set(item):
                continue
            covered = plain_tiling(words, item, min(decontam.MIN_MATCH, len(item)))
            if 100 * covered >= decontam.MIN_COVERAGE * len(item) and covered:
                out[(doc_id, item_id, covered, len(item))] += 1
    return out


def shapes(df):
    return Counter((r.doc_id, r.item_id, r.covered, r.item_tokens) for r in df.collect())


def items_and_docs():
    rng = random.Random(8)
    words = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 9, 24, 40])))) for k in range(12)]
    docs = []
    for k in range(60):
        item = items[k % 12][1].split()
        filler = rng.choices(words, k=60)
        cut = rng.randrange(1, len(item))
        moved = item[cut:] + rng.choices(words, k=7) + item[:cut]
        part = item[: max(1, len(item) // 3)]
        body = [item, moved, part, [], item * 3][k % 5]
        docs.append((k, (" ".join(filler[:30] + body + filler[30:])).title().replace(" ", ", " if k % 2 else " ")))
    return items, docs


def test_tiling_is_the_plain_loop(spark):
    items, docs = items_and_docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, [(i, t, "en", "s") for i, t in docs])
    want = brute(docs, items)
    assert len(want) > 20 and len({k[0] for k in want}) < len(docs)
    assert shapes(decontam.find_leaks(df, bench, shorter=())) == want
    # The same in several blocks of the benchmark, or with each item as a block of its own.
    assert shapes(decontam.find_leaks(df, bench, block_chars=400, shorter=())) == want
    assert shapes(decontam.find_leaks(df, bench, block_chars=4, shorter=())) == want
    stepped = shapes(decontam.find_leaks(df, bench))
    assert not want - stepped
    clean = decontam.without_leaks(df, bench, block_chars=400)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {k[0] for k in stepped}


def test_sentences_shorter_than_a_seed_in_another_order(spark):
    rng = random.Random(5)
    sentences = ["red birds sing", "old stones wait here", "rivers turn", "no child sleeps", "warm bread rises", "seven lamps burn low"]
    item = ". ".join(sentences)
    moved = sentences[:]
    rng.shuffle(moved)
    assert moved != sentences
    filler = [f"w{k}" for k in range(3000)]
    texts = [
        (1, " ".join(filler[:500]) + " " + ". ".join(moved) + " " + " ".join(filler[500:900])),
        (2, " ".join(f"{a} {' '.join(filler[40 * k : 40 * k + 40])}" for k, a in enumerate(sentences))),  # spread over a long text
        (3, "red birds sing of rivers and of bread"),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.find_leaks(documents(spark, [(i, t, "en", "s") for i, t in texts]), bench).collect()
    assert [(r.doc_id, r.tiles > 2, r.coverage_percent > 80) for r in got] == [(1, True, True)]


def test_long_items_and_repetitive_texts(spark):
    """An item above the bound of a block, and texts in which every window matches every other."""
    long = " ".join(f"t{k}" for k in range(1_300_000))
    assert len(long) > decontam.BLOCK_CHARS
    bench = spark.createDataFrame([(1, long), (2, "echo " * 2000), (3, "a b " * 700)], "item_id long, text string")
    texts = [(1, " ".join(f"t{k}" for k in range(400_000, 1_100_000))), (2, "echo " * 20_000), (3, "b a " * 10_000), (4, " ".join(f"t{k}" for k in range(1000)))]
    got = decontam.find_leaks(documents(spark, [(i, t, "en", "s") for i, t in texts]), bench).collect()
    assert {(r.doc_id, r.item_id): r.covered for r in got} == {(1, 1): 700_000, (2, 2): 2000, (3, 3): 1400}


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        w = decontam.tokens(t)
        for k in range(len(w) - 4):
            grams.setdefault(tuple(w[k : k + 5]), set()).add(i)
    near = []
    for d, t in docs:
        w = decontam.tokens(t)
        if any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)):
            near.append((d, t))
    want = brute([x for x in near if len(x[1]) < 4000], items) + brute([x for x in near if len(x[1]) >= 4000], items)
    folder = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert shapes(decontam.find_leaks(*folder, shorter=())) == want
    assert not want - shapes(queries.QUERIES["op1_decontaminate"](spark, FOLDER))


def test_reordered_sentences_are_caught_and_prose_is_not(spark):
    item = PROSE.split()
    thirds = [" ".join(item[k : k + 16]) for k in range(0, len(item), 16)]
    texts = [(1, ". ".join(reversed(thirds))), (2, " ".join(sorted(item))), (3, PROSE.upper()), (4, "nothing of that kind is said here at all")]
    bench = spark.createDataFrame([(9, PROSE), (9, PROSE), (10, None), (11, ""), (None, "zz yy xx ww vv uu")], "item_id long, text string")
    df = documents(spark, [(i, t, "en", "s") for i, t in texts] + awkward()[3:6] + [(None, "a zz yy xx ww vv uu b", "en", "s")])
    assert {(r.doc_id, r.item_id, r.tiles > 1) for r in decontam.find_leaks(df, bench).collect()} == {(1, 9, True), (3, 9, False), (None, None, False)}
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.without_leaks(df, bench.limit(0)).count() == df.count()


def test_passes_over_many_blocks(spark):
    """Small blocks in many passes find what one block finds."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20 + k))) for k in range(12)]
    texts = [(k, f"some prose before {items[k % 12][1]} and {items[(k + 5) % 12][1]} after it") for k in range(24)]
    rows = [(i, t, "en", "s") for i, t in texts] + awkward()
    df, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = decontam.find_leaks(df, bench)
    parts = list(decontam.blocks_of(bench, "item_id", "text", decontam.MIN_MATCH, 400))
    assert len(parts) > 2 * decontam.PASS_BLOCKS
    assert sorted(decontam.find_leaks(df, bench, block_chars=400).collect()) == sorted(want.collect()) and want.count() == 48
    clean = decontam.without_leaks(df, bench, block_chars=400)
    assert clean.columns == df.columns
    assert Counter(clean.collect()) == Counter(decontam.without_leaks(df, bench).collect()) and clean.count() == len(awkward())
