"""The thin queries op1 to op10 over the input tables, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, common, decontam, html_text, oracle, packing, pii, quality, simhash, substring_dedup, token_counts, url_filter

VOCABULARY = "byte_bpe_50k.json"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), vocabulary_path())


def op2_quality_rules(spark, sf_dir):
    return quality.rules(common.table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.remove(common.table(spark, sf_dir, "documents"))


def op4_simhash_pigeonring(spark, sf_dir):
    return simhash.components(common.table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark, sf_dir):
    return chat.format_chat(common.table(spark, sf_dir, "conversations"))


def op6_url_filters(spark, sf_dir):
    return url_filter.judge(common.table(spark, sf_dir, "pages"), RULES)


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), vocabulary_path())


def op8_html_extraction(spark, sf_dir):
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op9_pii_pseudonyms(spark, sf_dir):
    return pii.pseudonymize(common.table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontam.overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_substring_dedup, op4_simhash_pigeonring, op5_chat_formatting, op6_url_filters, op7_token_counts, op8_html_extraction, op9_pii_pseudonyms, op10_decontamination)}

ORACLE: dict[str, str] = oracle.sql(RULES)
