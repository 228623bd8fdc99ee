"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query and the module that has it.
_PLACES = {
    "op1_simhash": "simhash",
    "op2_sharding": "sharding",
    "op3_perplexity": "perplexity",
    "op4_exact_dedup": "exact_dedup",
    "op5_toxicity": "toxicity",
    "op6_token_files": "token_files",
    "op7_packing": "packing",
    "op8_language_id": "language_id",
    "op9_mixing": "mixing",
    "op10_html": "html_text",
}


def queries() -> dict:
    """Name to ``(spark, sf_dir) -> DataFrame``."""
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"{__package__}.{place}"), name) for name, place in _PLACES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    """DuckDB SQL of the queries that it can express."""
    from . import exact_dedup, mixing

    return {"op4_exact_dedup": exact_dedup.ORACLE, "op9_mixing": mixing.ORACLE}
