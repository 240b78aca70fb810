"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from votegrid.llm import exact_dedup, html_text, langid, mixing, packing, quality, secrets, simhash, sketch, warc

#: SQL where DuckDB can express the operator; the others are held against
#: brute-force versions in tests/llm.
_QUERIES = {
    "op1_exact_dedup": (exact_dedup.query, exact_dedup.SQL),
    "op2_language_id": (langid.query, None),
    "op3_html_text": (html_text.query, None),
    "op4_simhash_near_dedup": (simhash.query, None),
    "op5_mixing": (mixing.query, None),
    "op6_warc": (warc.query, warc.SQL),
    "op7_secret_scan": (secrets.query, None),
    "op8_quality": (quality.query, None),
    "op9_packing": (packing.query, None),
    "op10_fingerprints": (sketch.query, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
