"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, language, lines, neighbours, packing, repetition, seekable, sentence, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_quality_rules": repetition.op2_quality_rules,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_quality_classifier": neighbours.op4_quality_classifier,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_seekable_token_ids": seekable.op6_seekable_token_ids,
    "op7_language_id": language.op7_language_id,
    "op8_sentencepiece": sentence.op8_sentencepiece,
    "op9_avi": avi.op9_avi,
    "op10_warc": warc.op10_warc,
}

SQL: dict[str, str] = {"op1_line_dedup": lines.OP1_SQL, "op2_quality_rules": repetition.OP2_SQL, "op10_warc": warc.OP10_SQL}
