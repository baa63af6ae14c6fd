"""Tables that a plan reads more than once, written to the shared folder: lineage is cut there, and a lost executor costs no earlier stage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session of one machine, as in tests, gets a temporary one if it names none."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


atexit.register(_remove_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing else has; what is written there goes with the interpreter, or by remove() before."""
    path = f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
