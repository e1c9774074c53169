"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from ratecraft.llm import (
    classifier,
    decontaminate,
    filter_audit,
    hmm,
    html_main_text,
    jaccard,
    mixing,
    periodic_runs,
    quality_rules,
    repeats,
    sharding,
    token_files,
    warc_archive,
)
from ratecraft.llm.common import load
from ratecraft.llm.oracle import SQL  # noqa: F401


def op1_suffix_dedup(spark, sf_dir):
    return repeats.removal_report(load(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.token_report(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_classifier(spark, sf_dir):
    return classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_join(load(spark, sf_dir, "documents"))


def op6_warc_archive(spark, sf_dir):
    return warc_archive.archive_report(load(spark, sf_dir, "pages"))


def op7_hmm_scores(spark, sf_dir):
    return hmm.hmm_scores(load(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_report(load(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_report(load(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_report(spark, f"{sf_dir}/documents.parquet", load(spark, sf_dir, "labels"))


def op12_html_main_text(spark, sf_dir):
    return html_main_text.main_texts(load(spark, sf_dir, "pages"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.run_report(load(spark, sf_dir, "documents"), plant=True)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_warc_archive": op6_warc_archive,
    "op7_hmm_scores": op7_hmm_scores,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_html_main_text": op12_html_main_text,
    "op13_periodic_runs": op13_periodic_runs,
}
