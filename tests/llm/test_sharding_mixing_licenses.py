"""Placement, budgets and licence rules against their definitions."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import numpy as np
import pytest

from panelspark.llm import licenses, mixing, queries, sharding
from panelspark.llm.common import column
from tests.llm.helpers import FOLDER, PROSE, WORD, awkward, documents


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation_and_inverts(n):
    f = sharding.Feistel(n)
    p = f.forward(np.arange(n))
    assert sorted(p) == list(range(n)) and (f.back(p) == np.arange(n)).all()
    shard, slot = sharding.place(np.arange(n), n)
    assert (sharding.row_at(shard, slot, n) == np.arange(n)).all()


def test_feistel_shuffles():
    p = sharding.Feistel(10_000).forward(np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05
    assert (sharding.Feistel(10_000, 1).forward(np.arange(10_000)) != p).mean() > 0.99


def shard_brute(rows):
    """(doc_id, size, crc, shard, slot) by sorting all rows."""
    keyed = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    keyed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    shard, slot = sharding.place(np.arange(len(keyed)), len(keyed)) if keyed else ([], [])
    return Counter((*k, int(a), int(b)) for k, a, b in zip(keyed, shard, slot))


def test_shard_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.QUERIES["op7_shard"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == shard_brute(rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_shards_of_awkward_rows(spark):
    rows = awkward() * 3
    df = documents(spark, rows)
    got = sharding.shard_documents(df).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == shard_brute(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    whole = sharding.shard_rows(df, [column("doc_id")])
    assert sorted(whole.columns) == sorted([*[c for c in df.columns if c != "shard"], "shard", "slot"]) and whole.count() == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(df.limit(0)).count() == 0


def fill(total, children):
    """Weighted filling by repeated rounds: {child: (cap, weight)} -> shares."""
    out, left = {}, dict(children)
    while left:
        w = sum(x[1] for x in left.values())
        full = [k for k, (cap, weight) in left.items() if cap * w <= total * weight]
        if not full:
            return out | {k: total * weight // w for k, (_, weight) in left.items()}
        # One at a time, least capacity per weight first.
        k = min(full, key=lambda k: (left[k][0] / left[k][1], k))
        out[k] = left[k][0]
        total -= left.pop(k)[0]
    return out


def mix_brute(rows, mix, domain):
    docs = []
    for doc_id, text, lang, source in rows:
        leaf = tuple("null" if v is None else "=" + v for v in (domain(source), lang, source))
        docs.append((doc_id, md5((text or "").encode()).hexdigest(), leaf, len(WORD.findall(text or ""))))
    tokens = Counter()
    for *_, leaf, n in docs:
        tokens[leaf] += n
    cap = {k: n * mix.max_epochs for k, n in tokens.items()}

    def weights(level, keys, depth, prefix):
        named = getattr(mix, level)
        return {k: (sum(c for leaf, c in cap.items() if leaf[: depth + 1] == (*prefix, k)), named.get(k[1:], mix.default)) for k in keys}

    total = sum(tokens.values()) * mix.budget_percent // 100
    budget = {}
    for d, b in fill(total, weights("domain", {k[0] for k in cap}, 0, ())).items():
        for g, b2 in fill(b, weights("language", {k[1] for k in cap if k[0] == d}, 1, (d,))).items():
            for s, b3 in fill(b2, weights("source", {k[2] for k in cap if k[:2] == (d, g)}, 2, (d, g))).items():
                budget[(d, g, s)] = b3
    out = Counter()
    for leaf, b in budget.items():
        own = [(i, h, n) for i, h, x, n in docs if x == leaf]
        epochs = b // tokens[leaf] if tokens[leaf] else 0
        part = b - epochs * tokens[leaf]
        order = lambda r: (md5(f"{mix.seed}|{epochs}|{'null' if r[0] is None else r[0]}".encode()).hexdigest(), str(r[0]), r[1])
        spent = 0
        for i, _, n in sorted(own, key=order):
            spent += n
            out[(i, *[None if v == "null" else v[1:] for v in leaf], n, epochs + (1 if spent <= part and n > 0 else 0))] += 1
    return out


def domain(source):
    import re

    m = re.search("([0-9]{1,9})$", source or "")
    return f"d{int(m[1]) % 4}" if m else "other"


@pytest.mark.parametrize("mix", [queries.MIX, mixing.Mix(budget_percent=150, max_epochs=3), mixing.Mix({"d1": 9}, {"de": 7}, {}, 1, 30, 1)])
def test_mix_is_brute_force(spark, mix):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for rows in (docs, awkward() * 2):
        got = mixing.mix_report(documents(spark, rows), mix, mixing.domain_of(column("source"))).collect()
        assert Counter(tuple(r) for r in got) == mix_brute(rows, mix, domain)


def test_mixed_rows_are_the_copies(spark):
    rows = awkward() + [(50 + k, "plain words here " * (k + 1), "en", f"src{k % 7}") for k in range(60)]
    df, mix = documents(spark, rows), mixing.Mix(budget_percent=120, max_epochs=2)
    want = Counter()
    for (i, *_, n, copies), times in mix_brute(rows, mix, domain).items():
        want[i] += copies * times
    out = mixing.mixed(df, mix, mixing.domain_of(column("source")))
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mixed(df.limit(0), mix, mixing.domain_of(column("source"))).count() == 0
    assert mixing.mix_report(df.limit(0), mix, mixing.domain_of(column("source"))).count() == 0


@pytest.mark.parametrize("percent", [40, 60, 110])
def test_one_id_holds_most_rows(spark, percent):
    same = [(None if k % 2 else 7, PROSE, "en", "src1") for k in range(700)]
    rows = same + [(7, f"{PROSE} and {k}", "en", "src1") for k in range(300)] + [(k, "few words", "en", "src1") for k in range(100)]
    df, mix = documents(spark, rows).repartition(5), mixing.Mix(budget_percent=percent, max_epochs=2)
    want = mix_brute(rows, mix, domain)
    got = mixing.mix_report(df, mix, mixing.domain_of(column("source"))).collect()
    assert Counter(tuple(r) for r in got) == want
    # No more than one document short of the budget.
    budget = sum(r.tokens for r in got) * percent // 100
    assert 0 <= budget - sum(r.tokens * r.copies for r in got) < max(r.tokens for r in got)
    out = mixing.mixed(df, mix, mixing.domain_of(column("source"))).groupBy("doc_id").count().collect()
    copies = Counter()
    for (i, *_, n, times), rows_ in want.items():
        copies[i] += times * rows_
    assert Counter({r.doc_id: r["count"] for r in out}) == +copies


def test_shortage_goes_to_siblings_first(spark):
    """A source too small for its share is made up for by its language's other source."""
    rows = [(k, "a " * 10, "en", "src1" if k < 2 else "src5") for k in range(100)] + [(200 + k, "a " * 10, "de", "src1") for k in range(100)]
    mix = mixing.Mix(budget_percent=50, max_epochs=1)
    got = mixing.mix_report(documents(spark, rows), mix, mixing.domain_of(column("source"))).collect()
    spent = Counter()
    for r in got:
        spent[(r.language, r.source)] += r.tokens * r.copies
    assert spent == {("en", "src1"): 20, ("en", "src5"): 480, ("de", "src1"): 500}


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licence_rules(spark):
    texts = [
        (1, MIT),
        (2, "Some prose without an end\nReleased under the MIT License."),
        (3, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (4, "The MIT licence was discussed, and released under the MIT License it was not"),
        (5, None),
        (6, ""),
        (7, MIT.replace("The above copyright", "The below copyright")),
        (None, "SPDX-License-Identifier: Apache-2.0"),
        (8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"),
    ]
    df = documents(spark, [(i, t, "en", "s") for i, t in texts])
    got = {r.doc_id: (r.n_sentences, r.n_matches, r.licenses) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: (4, 2, "mit"), 2: (1, 1, "mit"), 3: (3, 3, "apache-2.0,cc-by-nc-4.0"), 4: (0, 0, ""), 5: (0, 0, ""), 6: (0, 0, ""),
        7: (3, 2, "mit,mit-incomplete"), None: (1, 1, "apache-2.0"), 8: (1, 0, ""),
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in texts])
    assert {r[0]: tuple(r[1:]) for r in con.execute(licenses.oracle()).fetchall()} == got


def test_no_rule_begins_inside_another():
    for name, rule in licenses.RULES:
        for other, longer in licenses.RULES:
            assert all(longer[k] != rule[0] for k in range(1, len(longer))), (name, other)


NOTICES = {
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
    "agpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. More.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.",
    "zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable. Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin",
    "cc0-1.0": "SPDX-License-Identifier: CC0-1.0",
    "isc": "// x\nSPDX-License-Identifier: ISC\ncode",
    "gpl-2.0": "SPDX-License-Identifier: GPL-2.0-only\n",
    "gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later\n",
    "bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "epl-2.0": "Eclipse Public License - v 2.0",
    "lgpl-3.0": "SPDX-License-Identifier: LGPL-3.0-only",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
}


def test_common_notices_are_known(spark):
    names = list(NOTICES)
    df = documents(spark, [(k, "Some text before.\n\n" + NOTICES[n], "en", "s") for k, n in enumerate(names)])
    assert {names[r.doc_id]: r.licenses for r in licenses.scan_licenses(df).collect()} == {n: n for n in names}


def test_wordings_have_one_identifier():
    plain = [licenses._plain(w) for wordings in licenses.SENTENCES.values() for w in wordings]
    assert len(set(plain)) == len(plain)
    assert {s for _, sequence in licenses.RULES for s in sequence} <= set(licenses.SENTENCES)
