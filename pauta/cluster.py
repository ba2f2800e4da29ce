"""Settings that concern where a job may keep intermediate results."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (a test
    in local mode) a temporary folder is taken. Checkpoint files survive lost executors.
    The shuffle files of the query that wrote them are removed when it has ended.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting is read where a query is made
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pauta-checkpoint-")


def bounded_rows(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; it looks at no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def share_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they start.

    The package goes once a context as a small zip file through Spark's own file
    distribution; it is written to the shared folder, whatever file system that is on.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pauta_shared", False):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"pauta/{f.relative_to(here)}")
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/pauta-{sc.applicationId}.zip")
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(target, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(str(files.makeQualified(target).toString()))
    sc._pauta_shared = True
