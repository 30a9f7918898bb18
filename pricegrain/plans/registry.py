"""All registered queries: a callable (spark, sf_dir) and the SQL that gives the same rows."""

from __future__ import annotations

from pricegrain.plans import documents, pages, search, small, state, text, titles, tracking

_PARTS = [tracking.Q, search.Q, state.Q, text.Q, pages.Q, small.Q, titles.Q, documents.Q, documents.T]
QUERIES = {name: query for part in _PARTS for name, query in part.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.sql.items()}
