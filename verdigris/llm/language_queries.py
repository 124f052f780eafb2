"""Queries of problem 1: languages of task statements and of their segments."""

from verdigris.llm.language_spark import fit_model, segment_languages, text_languages, unnamed_languages
from verdigris.runtime import read_table, spread


def _with(f):
    def query(spark, sf_dir):
        rows = spread(read_table(spark, sf_dir, "queries"))
        return f(rows, fit_model(rows))

    return query


QUERIES = {"p1_found": _with(unnamed_languages), "p1_languages": _with(text_languages), "p1_segments": _with(segment_languages)}
SQL = {}
