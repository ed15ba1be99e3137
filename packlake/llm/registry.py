"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from . import byte_bpe, decontaminate, html_text, licenses, ngram_lm, sharding, simhash, syncmers, token_counts, toxicity

MODULES = [sharding, licenses, toxicity, simhash, token_counts, decontaminate, syncmers, ngram_lm, html_text, byte_bpe]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES if hasattr(m, "oracles") for name, sql in m.oracles().items()}
