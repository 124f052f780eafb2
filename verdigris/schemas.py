"""Schemas and constants shared by the operators."""

from pyspark.sql import types as T

#: Outcome tiers of a verification, best first, and the evidence each adds to a score by default.
TIERS = ("pass_all", "pass_partial", "unverified", "wrong_answer", "error")
DEFAULT_PARAMS = {"temperature": 0.02, "llr": {"pass_all": 7.0, "pass_partial": 1.5, "unverified": 0.0, "wrong_answer": -2.0, "error": -3.0}}
#: Case statuses that say nothing about the program, and those that speak against it.
UNRUNNABLE = ("syntax_error", "import_error", "blocked")
BROKEN = ("runtime_error", "timeout", "crash")

EXAMPLE = T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType())])
CASE = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("stdout", T.StringType()), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("variant", T.StringType())]
)
#: ``any``: the program ends like that on any input.
EXECUTIONS = T.StructType([T.StructField("key", T.StringType()), T.StructField("cases", T.ArrayType(CASE)), T.StructField("any", T.BooleanType())])
SNIPPETS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("text", T.StringType())])
VERSIONS = T.StructType(
    [
        T.StructField("store", T.StringType()), T.StructField("version", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("parent", T.StringType()),
        T.StructField("created", T.TimestampType()), T.StructField("source", T.StringType()),
        T.StructField("diff", T.StructType([T.StructField(k, T.LongType()) for k in ("added", "removed", "modified", "unchanged")])),
    ]
)
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("store", "version", "uid", "sha")])
BLOBS = T.StructType([T.StructField("sha", T.StringType()), T.StructField("text", T.StringType())])
VECTORS = T.StructType([T.StructField("key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
