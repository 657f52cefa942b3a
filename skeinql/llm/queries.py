"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP8_SQL, op8_decontamination
from .licenses import op10_licenses
from .lm import op9_lm
from .materialise import op5_materialise
from .packing import op7_packing
from .pii import op6_pii
from .quality import OP2_SQL, op2_quality
from .repeats import op1_repeats
from .sentences import op4_sentences
from .simhash import op3_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_run_length_index": op1_repeats,
        "op2_line_frequency": op2_quality,
        "op3_simhash_vantage": op3_simhash,
        "op4_sentence_spans": op4_sentences,
        "op5_training_order": op5_materialise,
        "op6_pii_field": op6_pii,
        "op7_cost_balanced_packing": op7_packing,
        "op8_decontamination": op8_decontamination,
        "op9_lm_partial_matching": op9_lm,
        "op10_license_compression": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_frequency": OP2_SQL, "op8_decontamination": OP8_SQL}
