"""The pipeline against its stages written out by brute force."""

from collections import Counter

import numpy as np

import corpus_pipeline as corpus
from panelspark.llm import decontam, sharding
from tests.llm.helpers import FOLDER, awkward, documents
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_quality_tokens_lang import base, verdict
from tests.llm.test_sharding_mixing_licenses import domain, mix_brute


def kept_by_hand(rows, items):
    rows = [r for r in rows if not base(r[1])[-1] and verdict(r[1])]
    _, top, _ = near_brute([r[:2] for r in rows], 5)
    firsts = {}
    for k, t in enumerate(top):
        if t not in firsts or rows[k][0] < rows[firsts[t]][0]:
            firsts[t] = k
    rows = [rows[k] for k in sorted(firsts.values())]
    block = decontam.Block(items, decontam.MIN_MATCH)
    rows = [r for r in rows if not decontam.contamination(r[1], block, decontam.MIN_COVERAGE)]
    taken = {r[0] for r in mix_brute(rows, corpus.PIPELINE_MIX, domain) if r[-1] > 0}
    return [r for r in rows if r[0] in taken]


def test_pipeline_is_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = sorted(kept_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in docs], items))
    assert 20 < len(want) < len(docs)
    out = corpus.run(spark, FOLDER)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    shard, slot = sharding.place(np.arange(len(want)), len(want))
    got = sorted((r.doc_id, r.text, r.lang, r.source, r.shard, r.slot) for r in out.collect())
    assert got == [(*w, int(a), int(b)) for w, a, b in zip(want, shard, slot)]


def test_stages_bear_awkward_rows(spark):
    df = documents(spark, awkward() * 2)
    for name, stage in corpus.STAGES:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, FOLDER)
            assert out.count() <= docs.count(), name
            if stage is not corpus.STAGES[-1][1]:
                assert out.columns == docs.columns
            else:
                assert sorted(out.columns) == sorted({*docs.columns, "shard", "slot"}) and out.count() == docs.count()


def test_first_stage_drops_empty_texts(spark):
    out = corpus.STAGES[0][1](spark, documents(spark, awkward()), FOLDER)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in awkward() if not base(r[1])[-1] and verdict(r[1]))
