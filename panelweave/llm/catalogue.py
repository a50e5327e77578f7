"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: operator number -> module with NAME, query(spark, sf_dir) and SQL (None where SQL cannot express it)
MODULES = ("q_exact_dedup", "q_token_counts", "q_url_filter", "q_simhash", "q_mixing", "q_embedding_dedup", "q_warc", "q_language_id", "q_license_scan", "q_bpe")


def _modules():
    return [importlib.import_module(f"panelweave.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {m.NAME: m.SQL for m in _modules() if m.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
