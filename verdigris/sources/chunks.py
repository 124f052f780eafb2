"""Python files cut into top-level functions and classes, the rest being one more piece."""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REST = "<module>"
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def chunk(path: str, source: str) -> list[tuple[str, str]]:
    """(uid, text) of the pieces of a file; a file that is no Python is one piece under its path.

    A piece takes its decorators along.  Of definitions with one name the last counts.  The rest is trimmed and ends in
    a line end; an empty rest is no piece.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            body = ast.parse(source).body
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [(path, source)]
    lines, pieces, left = _LINE.findall(source), {}, {}
    left = dict(enumerate(lines, start=1))
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min(n.lineno for n in (node, *node.decorator_list))
            span = range(first, node.end_lineno + 1)
            pieces[f"{path}::{node.name}"] = "".join(lines[n - 1] for n in span)
            for n in span:
                left.pop(n, None)
    rest = "".join(left.values()).strip()
    return [*pieces.items(), *([(f"{path}::{REST}", rest + "\n")] if rest else [])]


_PIECES = T.ArrayType(T.StructType([T.StructField("uid", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_PIECES)
def chunk_udf(path: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([[{"uid": u, "text": t} for u, t in chunk(p, s)] if p is not None and s is not None else [] for p, s in zip(path, source)])


def chunked(files: DataFrame, by: str = "file") -> DataFrame:
    """(uid, text) of (uid, text) files: as they are, or ``by`` function for those that end in .py."""
    if by == "file":
        return files.select("uid", "text")
    if by != "function":
        raise ValueError(by)
    python = F.col("uid").endswith(".py")
    pieces = files.where(python).select(F.explode(chunk_udf("uid", "text")).alias("p")).select("p.uid", "p.text")
    return pieces.unionByName(files.where(~python | F.col("uid").isNull()).select("uid", "text"))
