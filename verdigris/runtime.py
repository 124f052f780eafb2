"""Session building, shared-folder materialisation and size-checked broadcasts.

Nothing in here is specific to an operator.  Every operator that needs to cut its lineage goes through
:func:`materialise`, so that what it wrote survives the loss of any executor.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to hold at most this many rows, and wide rows only up to so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 << 20


def build_session(app: str = "verdigris", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.speculation": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable for the Python workers where their path does not reach it; once per application."""
    root = Path(__file__).resolve().parents[1]
    reached = {Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))}
    context = spark.sparkContext
    if root in reached or getattr(context, "_verdigris_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='verdigris-')}/package", "zip", root, "verdigris")
    context.addPyFile(archive)
    context._verdigris_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where it is unset and all run on one machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="verdigris-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage is cut, columns stay prunable.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdigris/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def release(*written: DataFrame) -> None:
    """Remove tables of :func:`materialise` that nothing reads any more, as loops do with those of past rounds."""
    for df in written:
        path = getattr(df, "_written", None)
        if path:
            hadoop_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (then it is a shuffle join).

    The count stops at ``rows + 1`` rows, so it never walks a large side.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least a partition per core, for maps that cost far more than moving their rows.

    Only a scan of fewer slices than cores is moved; a large table has more slices and stays where it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
