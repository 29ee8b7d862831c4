"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, fingerprint, html, language, licenses, mixing, packing, periods, quality, secrets, sharding, simhash

QUERIES: tuple = (
    html.op1_html_blocks,
    mixing.op2_poisson_mixing,
    quality.op3_quality_rules,
    licenses.op4_license_scan,
    language.op5_language_id,
    sharding.op6_minimax_shards,
    secrets.op7_secret_scan,
    packing.op8_harmonic_packing,
    fingerprint.op9_weighted_fingerprints,
    simhash.op10_simhash,
    periods.op11_periodic_runs,
    chat.op12_chat_format,
    codes.op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query over (spark, sf_dir)."""
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL; only the operators that SQL can express."""
    return {"op2_poisson_mixing": mixing.OP2_SQL, "op12_chat_format": chat.OP12_SQL, "op13_vector_codes": codes.OP13_SQL}
