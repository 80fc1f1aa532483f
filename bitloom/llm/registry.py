"""Queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.conversation_repair import op12_conversation_repair
from bitloom.llm.decontaminate import OP2_SQL, op2_decontamination
from bitloom.llm.language_id import op8_language_id
from bitloom.llm.media import op9_media_columns
from bitloom.llm.merge_replay import op11_merge_replay
from bitloom.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from bitloom.llm.near_dedup import OP10_SQL, op10_near_dedup
from bitloom.llm.packing import op6_packing
from bitloom.llm.quality import op7_quality_classifier
from bitloom.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from bitloom.llm.token_counts import op3_token_counts
from bitloom.llm.toxicity import op4_toxicity
from bitloom.llm.url_filters import OP5_SQL, op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_id": op8_language_id,
    "op9_media_columns": op9_media_columns,
    "op10_near_dedup": op10_near_dedup,
    "op11_merge_replay": op11_merge_replay,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op5_url_filters": OP5_SQL, "op10_near_dedup": OP10_SQL, "op13_merkle_manifest": OP13_SQL}
