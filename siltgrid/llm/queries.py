"""The subpackage's queries and their DuckDB SQL, by name."""

from __future__ import annotations

from . import ann, bpe, html, maxent, packing, phrases, quality, runs, simhash, suffix, topk, urls, warc

MODULES = (urls, quality, bpe, packing, warc, simhash, suffix, ann, maxent, html, runs, topk, phrases)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
