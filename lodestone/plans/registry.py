"""All registered queries and their SQL counterparts."""

from . import corpus, search

QUERIES: dict = corpus.QUERIES | search.QUERIES
ORACLE_SQL: dict[str, str] = corpus.ORACLE_SQL | search.ORACLE_SQL
FLAGSHIP = "search_bm25"
