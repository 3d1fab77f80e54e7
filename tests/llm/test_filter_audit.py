"""Filter audit against running every order over every document."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from panelspark.llm import filter_audit as A
from panelspark.llm import queries
from tests.llm.helpers import FOLDER, WORD, awkward, documents

LABELS = "doc_id long, quality int, toxic int, mask string, part string"


def brute(docs, labels):
    """Sorted report rows; docs are (doc_id, text, lang)."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, quality, bad in labels:
        good |= {i} if quality == 1 and i is not None else set()
        toxic |= {i} if bad == 1 and i is not None else set()
    parts = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        parts[lang or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, members in parts.items():
        removed_at, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order):
                gone = [m for m in left if f in m[0]]
                left_after = [m for m in left if f not in m[0]]
                redundant = sum(f in m[0] for m in members) - len(gone)
                alone = sum(m[0] == {f} for m in members)
                removed_at[f] += len(gone)
                rows.append([part, "".join(order), step + 1, len(left_after), len(gone), redundant, alone, sum(m[1] for m in gone), sum(m[2] for m in gone)])
                left = left_after
        out += [(*r, removed_at[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], LABELS)


def test_awkward_documents(spark):
    rows = awkward()
    rows += [(20, " ".join(f"word{k}" for k in range(300)), "en", "s"), (21, " ".join(f"word{k}" for k in range(300)), "de", "s"), (21, "A B C " * 90, "en", "s"), (22, "50% of it", "", "s"), (22, "50% of it", None, "s")]
    labels = [(20, 1, 0), (21, 0, 1), (21, 1, None), (1, 1, 1), (None, 1, 1), (99, 1, 1), (2, None, None)]
    got = sorted(tuple(r) for r in A.filter_report(documents(spark, rows), labelled(spark, labels)).collect())
    assert got == brute([r[:3] for r in rows], labels)
    assert A.filter_report(documents(spark, rows[:0]), labelled(spark, labels)).count() == 0
    unlabelled = A.filter_report(documents(spark, rows), labelled(spark, [])).collect()
    assert sum(r.good_lost + r.toxic_lost for r in unlabelled) == 0 and len(unlabelled) == len(got)


def test_query_on_given_table(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_filter_audit"](spark, FOLDER).collect())
    assert got == brute(docs, labels)


def test_fields_hold_counts_near_the_limit(spark):
    """Every field is as large as a part's documents; none spills into the next."""
    huge = 2**54  # 120 orders of it still fit a long
    masks = spark.createDataFrame([("p", 31, True, True, huge), ("p", 0, True, False, huge), ("p", 1, False, True, huge - 1)], "part string, mask int, good boolean, toxic boolean, count long")
    rows = {(r.filter_order, r.step): r for r in A.audit(masks, "ABCDE").collect()}
    first, second = rows["ABCDE", 1], rows["ABCDE", 2]
    assert (first.kept, first.removed, first.redundant) == (huge, 2 * huge - 1, 0)
    assert (second.kept, second.removed, second.redundant, second.toxic_lost) == (huge, 0, huge, 0)
    assert rows["EABCD", 2].removed == huge - 1 and rows["EABCD", 2].redundant == huge and first.good_lost == huge and first.toxic_lost == 2 * huge - 1
