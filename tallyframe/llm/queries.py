"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.op1_token_planes import op1_token_planes
from tallyframe.llm.op2_language import op2_language
from tallyframe.llm.op3_toxicity import op3_toxicity
from tallyframe.llm.op4_string_tiling import op4_string_tiling
from tallyframe.llm.op5_line_spread import OP5_SQL, op5_line_spread
from tallyframe.llm.op6_token_counts import op6_token_counts
from tallyframe.llm.op7_tiles import OP7_SQL, op7_tiles
from tallyframe.llm.op8_superminhash import OP8_SQL, op8_superminhash
from tallyframe.llm.op9_urls import op9_urls
from tallyframe.llm.op10_best_fit import op10_best_fit
from tallyframe.llm.op11_quality_rules import OP11_SQL, op11_quality_rules
from tallyframe.llm.op12_dimension_lloyd import OP12_SQL, op12_dimension_lloyd
from tallyframe.llm.op13_resident_lloyd import OP13_SQL, op13_resident_lloyd


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_planes, op2_language, op3_toxicity, op4_string_tiling, op5_line_spread, op6_token_counts, op7_tiles, op8_superminhash,
        op9_urls, op10_best_fit, op11_quality_rules, op12_dimension_lloyd, op13_resident_lloyd,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_spread": OP5_SQL, "op7_tiles": OP7_SQL, "op8_superminhash": OP8_SQL, "op11_quality_rules": OP11_SQL,
        "op12_dimension_lloyd": OP12_SQL, "op13_resident_lloyd": OP13_SQL,
    }
