"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact, licences, mixing, packing, pii, rans, repeats, simhash, sketch, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [packing.op1_best_fit_packing, simhash.op2_simhash, rans.op3_rans_tokens, mixing.op4_entropy_mixing, exact.op5_exact_dedup]
    found += [sketch.op6_bottom_k, pii.op7_private_data, licences.op8_licence_scan, toxicity.op9_toxicity, repeats.op10_repeats]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact.ORACLE, "op10_repeats": repeats.ORACLE}
