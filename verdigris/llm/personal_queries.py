"""Queries of problem 9: personal information in documents."""

from verdigris.llm.personal_spark import find_personal, fit_model, replace_personal
from verdigris.runtime import read_table, spread


def _model(spark, sf_dir):
    documents = spread(read_table(spark, sf_dir, "documents"))
    return documents, fit_model(documents, read_table(spark, sf_dir, "name_parts"))


def p9_found(spark, sf_dir):
    return find_personal(*_model(spark, sf_dir))


def p9_replaced(spark, sf_dir):
    return replace_personal(*_model(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_replaced": p9_replaced}
SQL = {}
