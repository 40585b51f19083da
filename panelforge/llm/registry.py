"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_mix_sources": "mixing",
    "op2_quality": "quality",
    "op3_media_tiles": "media",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_toxicity": "toxicity",
    "op6_ann": "ann",
    "op7_url_filter": "url_filter",
    "op8_packing": "packing",
    "op9_simhash": "simhash",
    "op10_ngram_trie": "ngram_trie",
    "op11_collocations": "collocations",
    "op12_periodic_runs": "periodic_runs",
    "op13_quality_rules": "quality_rules",
}


def _of(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"panelforge.llm.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    found = {name: _of(module, name) for name, module in _QUERIES.items()}
    found["pipeline"] = lambda spark, sf_dir: import_module("corpus_pipeline").run(spark, sf_dir)
    return found


def oracle_sql() -> dict:
    from panelforge.llm.collocations import OP11_SQL
    from panelforge.llm.url_filter import OP7_SQL

    return {"op7_url_filter": OP7_SQL, "op11_collocations": OP11_SQL}
