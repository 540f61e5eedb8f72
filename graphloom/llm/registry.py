"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import oracles, oracles_rows
from .op01_substring_dedup import op1_substring_dedup
from .op02_minhash_dedup import op2_minhash_dedup
from .op03_decontaminate import op3_decontaminate
from .op04_line_dedup import ORACLE_SQL as OP4_SQL
from .op04_line_dedup import op4_line_dedup
from .op05_pii import op5_pii
from .op06_token_counts import op6_token_counts
from .op07_language_id import op7_language_id
from .op08_quality_classifier import op8_quality_classifier
from .op09_packing import op9_packing
from .op10_quality_rules import op10_quality_rules
from .op11_mixing import op11_mixing
from .op12_merkle_manifest import op12_merkle_manifest
from .op13_vector_codes import op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_line_dedup": op4_line_dedup,
        "op5_pii": op5_pii,
        "op6_token_counts": op6_token_counts,
        "op7_language_id": op7_language_id,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_mixing": op11_mixing,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracles.OP1,
        "op2_minhash_dedup": oracles.OP2,
        "op3_decontaminate": oracles.OP3,
        "op4_line_dedup": OP4_SQL,
        "op11_mixing": oracles_rows.OP11,
        "op12_merkle_manifest": oracles_rows.OP12,
        "op13_vector_codes": oracles_rows.OP13,
    }
