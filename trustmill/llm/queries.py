"""The registered queries of the text operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trustmill.llm import conversations, decontaminate, language_id, periodic_runs, pii, quality, quality_model, secrets, sentencepiece_codec, sharding, simhash, substring_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_sharding": sharding.op5_sharding,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_language_id": language_id.op7_language_id,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_quality_classifier": quality_model.op13_quality_classifier,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_quality_rules": quality.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_secret_scan": secrets.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op12_periodic_runs": periodic_runs.ORACLE,
}
