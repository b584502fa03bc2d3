"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from tidemark.plans import evaluation, graph, ltr, mail, search, sources, topics, web

_PARTS = (search, evaluation, graph, web, mail, ltr, topics, sources)

FLAGSHIP = "bm25"
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
