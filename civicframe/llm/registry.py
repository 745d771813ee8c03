"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from civicframe.llm import exact_dedup, html_extract, language_id, lexical_search, media, mixing, ngram_join, periodic_runs, substring_dedup, subword_sampling, toxicity, url_filters, warc

MODULES = (exact_dedup, html_extract, language_id, lexical_search, media, mixing, ngram_join, periodic_runs, substring_dedup, subword_sampling, toxicity, url_filters, warc)


def queries() -> dict:
    import corpus_pipeline

    own = {name: getattr(m, name) for m in MODULES for name in dir(m) if name.startswith("op") and name[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    own = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
