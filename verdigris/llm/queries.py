"""The registered queries of this subpackage and their SQL."""

from verdigris.llm import duplicate_queries, language_queries, personal_queries, rank_queries, split_queries, token_queries, vector_queries

_MODULES = (duplicate_queries, language_queries, personal_queries, rank_queries, split_queries, token_queries, vector_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
