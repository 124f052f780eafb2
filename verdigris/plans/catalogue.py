"""Every registered query of the library proper; the optional training-data subpackage registers its own."""

from verdigris.plans import change_queries, ranking_queries, store_queries, studies, text_queries, version_queries

_MODULES = (ranking_queries, version_queries, store_queries, studies, text_queries, change_queries)


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
