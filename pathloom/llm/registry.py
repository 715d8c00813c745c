"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, chat, lines, mixing, neardup, packing, planes, quality, warc, wordpiece
from .common import ship

_FUNCTIONS = [chat.op1_chat, planes.op2_bit_planes, lines.op3_fuzzy_lines, ann.op4_vantage_points, warc.op5_warc, quality.op6_host_rules, packing.op7_pack, wordpiece.op8_token_counts, neardup.op9_near_duplicates, mixing.op10_mix]


def _shipped(f: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in _FUNCTIONS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op4_vantage_points": ann.OP4_SQL, "op5_warc": warc.OP5_SQL, "op6_host_rules": quality.OP6_SQL, "op10_mix": mixing.OP10_SQL}
