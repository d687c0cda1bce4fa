"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from docquarry.llm import alignment, dac, decontam, divergence, html_wrappers, license_scan, line_dedup, packing, quality, sharding, simhash, toxicity, warc

_MODULES = [decontam, simhash, license_scan, packing, quality, sharding, html_wrappers, toxicity, line_dedup, dac, warc, divergence, alignment]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
