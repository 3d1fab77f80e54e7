"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.llm import conversations, decontam, embeddings, filter_audit, html_text, langid, licenses, mixing, near_dup, quality, sharding, token_counts, warc
from panelspark.llm.common import column, table

# Where the public vocabularies are installed; a parameter of the operator.
TOKENIZER_PACKAGE = "public_tokenizers"

MIX = mixing.Mix(
    domain={"d0": 4, "d1": 3, "d2": 2},
    language={"en": 5, "de": 3, "fr": 3, "es": 2},
    source={"src0": 3},
    budget_percent=60,
    max_epochs=2,
)


def tokenizer_path(name: str = token_counts.TOKENIZER) -> str:
    from importlib import import_module

    return str(import_module(TOKENIZER_PACKAGE).path(name))


def leaks(spark, folder):
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def main_text(spark, folder):
    return html_text.main_texts(table(spark, folder, "pages"))


def archive(spark, folder):
    return warc.archived(table(spark, folder, "pages"))


def near_duplicates(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


def mix(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"), MIX, mixing.domain_of(column("source")))


def languages(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def shards(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


def tokens(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path()).drop("fit_chars")


def repetition(spark, folder):
    report = quality.quality_report(table(spark, folder, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return report.select(*first, "dup_line_chars")


def license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


def near_vectors(spark, folder):
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


def repaired_conversations(spark, folder):
    return conversations.repair_damaged(table(spark, folder, "conversations"))


def filter_interactions(spark, folder):
    return filter_audit.filter_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_decontaminate": leaks,
    "op2_main_text": main_text,
    "op3_warc": archive,
    "op4_near_dup": near_duplicates,
    "op5_mix": mix,
    "op6_language": languages,
    "op7_shard": shards,
    "op8_tokens": tokens,
    "op9_quality": repetition,
    "op10_licenses": license_scan,
    "op11_vectors": near_vectors,
    "op12_conversations": repaired_conversations,
    "op13_filter_audit": filter_interactions,
}


def _mix_sql() -> str:
    m = MIX

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '={k}' THEN {w}" for k, w in sorted(getattr(m, level).items()))
        return f"CASE {cases} ELSE {m.default} END" if cases else str(m.default)

    def key(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN 'null' ELSE '=' || {c} END"

    def filled(name: str, nodes: str, parent: str, level: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        prefix = f"{parent}, " if parent else ""
        return f"""{name}_w AS (SELECT *, {weight(level)} AS weight FROM ({nodes}) n),
        {name}_o AS (SELECT *, row_number() OVER ({by} ORDER BY cap::DECIMAL(38,0) / weight, {level}) AS k FROM {name}_w),
        {name}_l AS (SELECT *, total - coalesce(sum(cap) OVER ({by} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            sum(weight) OVER ({by} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {name}_o),
        {name}_f AS (SELECT *, min(CASE WHEN cap::HUGEINT * weights > rest::HUGEINT * weight THEN k END) OVER ({by or ''}) AS first FROM {name}_l),
        {name} AS (SELECT {prefix}{level}, cap, CASE WHEN first IS NULL OR k < first THEN cap
            ELSE (max(CASE WHEN k = first THEN rest END) OVER ({by}) * weight) // max(CASE WHEN k = first THEN weights END) OVER ({by}) END AS total FROM {name}_f)"""

    return f"""
    WITH docs AS (SELECT doc_id, {key("CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'other' ELSE 'd' || (regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)::BIGINT % 4) END")} AS domain,
            {key("lang")} AS language, {key("source")} AS source, coalesce(doc_id::VARCHAR, 'null') AS key, md5(coalesce(text, '')) AS text_key,
            len([w for w in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''])::BIGINT AS tokens FROM documents),
    leaves AS (SELECT domain, language, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {m.max_epochs} AS cap FROM docs GROUP BY ALL),
    root AS (SELECT (sum(tokens)::BIGINT * {m.budget_percent}) // 100 AS total FROM leaves),
    {filled("one", "SELECT domain, sum(cap)::BIGINT AS cap, any_value(root.total) AS total FROM leaves, root GROUP BY domain", "", "domain")},
    {filled("two", "SELECT domain, language, sum(l.cap)::BIGINT AS cap, any_value(one.total) AS total FROM leaves l JOIN one USING (domain) GROUP BY domain, language", "domain", "language")},
    {filled("three", "SELECT domain, language, source, l.cap, two.total FROM leaves l JOIN two USING (domain, language)", "domain, language", "source")},
    plan AS (SELECT domain, language, source, tokens AS leaf_tokens, CASE WHEN tokens > 0 THEN total // tokens ELSE 0 END AS epochs,
            total - CASE WHEN tokens > 0 THEN total // tokens ELSE 0 END * tokens AS part FROM leaves JOIN three USING (domain, language, source)),
    rows_ AS (SELECT d.*, epochs, part, md5('{m.seed}|' || epochs::BIGINT || '|' || key) AS ord FROM docs d JOIN plan USING (domain, language, source)),
    upto AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY ord, key, text_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM rows_)
    SELECT doc_id, CASE WHEN domain <> 'null' THEN domain[2:] END AS domain, CASE WHEN language <> 'null' THEN language[2:] END AS language,
        CASE WHEN source <> 'null' THEN source[2:] END AS source, tokens,
        (epochs + CASE WHEN c <= part AND tokens > 0 THEN 1 ELSE 0 END)::INTEGER AS copies FROM upto"""


ORACLES = {
    "op5_mix": _mix_sql(),
    "op10_licenses": licenses.oracle(),
    "op11_vectors": embeddings.oracle(),
    "op12_conversations": conversations.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
