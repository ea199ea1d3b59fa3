"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat_format, decontamination, hard_negatives, jaccard_join, lexical_search, lm_scoring, packing, quality_rules, simhash_dedup, suffix_dedup, toxicity, url_filters, warc

MODULES = (toxicity, packing, url_filters, simhash_dedup, decontamination, warc, suffix_dedup, chat_format, quality_rules, lm_scoring, jaccard_join, lexical_search, hard_negatives)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
