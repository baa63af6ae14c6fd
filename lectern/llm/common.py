"""What the operators of this subpackage share: scratch tables, safe columns, and bounded Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Rows of an Arrow batch that goes to Python at most.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
#: Bytes of text after which an Arrow batch that a Python function returns is closed.
BATCH_BYTES = 8 << 20

_made: list[tuple[SparkSession, str]] = []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session of one machine, as in tests, gets a temporary one if it names none."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


atexit.register(_remove_all)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by stored() that no later plan reads."""
    if path := getattr(df, "_lectern_path", None):
        remove(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def fresh(name: str, df: DataFrame) -> str:
    """The name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(rows: Iterator[tuple], schema: pa.Schema, weight=None, limit: int = BATCH_BYTES, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size. weight: bytes of a row, apart from its fixed part."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 64
        if size >= limit or len(held) >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def sliced(parts: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few of their texts are Python objects at a time."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def whole_groups(parts: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that no group of rows of equal first columns (as many as keys) is divided."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        one = pa.concat_batches(held)
        last = np.ones(one.num_rows, bool)
        for k in range(keys):
            last &= pc.equal(one.column(k), one.column(k)[-1]).to_numpy(zero_copy_only=False)
        begin = one.num_rows - int(last.sum())  # groups are runs, so those of the last one's keys are at the end
        if begin:
            yield one.slice(0, begin)
        held = [one.slice(begin)]
    yield from held


def tidy(made: Iterator) -> Iterator:
    """What a task puts out; at its end Arrow and the C library give back the memory they keep for later, since workers live on."""
    try:
        yield from made
    finally:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


#: glibc's malloc_trim; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with those an operator makes.

    Texts go to Python in batches of at most BATCH_ROWS rows: an executor holds several batches of every task, in both worlds.
    """
    conf = docs.sparkSession.conf
    if int(conf.get(BATCH_SETTING)) > BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return docs.select(*(F.col(f"`{c}`") for c in columns))
