"""Rows as they come to Python: batches of bounded size, and runs of rows of one key in place of a data frame per key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch that goes to Python, and of those that are Python objects at a time.
ROWS, SLICE = 512, 64
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of ROWS at most: a setting of the session that stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(SETTING)) <= ROWS:
        conf.set(SETTING, str(ROWS))
    return df


def runs(parts: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of sorted batches, those of equal first columns (as many as keys) together, across batches too."""
    held: list[tuple] = []
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def runs_of_batches(parts: Iterable[pa.RecordBatch], keys: int, least: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Sorted batches joined to about `least` rows and cut so that no rows of equal first columns (as many as keys) are divided."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(p.num_rows for p in held) < least:
            continue
        one = pa.concat_batches(held)
        last = tuple(one.column(k)[-1].as_py() for k in range(keys))
        at = one.num_rows
        while at and tuple(one.column(k)[at - 1].as_py() for k in range(keys)) == last:
            at -= 1
        if at:
            yield one.slice(0, at)
        held = [one.slice(at)]
    if sum(p.num_rows for p in held):
        yield pa.concat_batches(held)


def by_key(df: DataFrame, keys: list[str], order: str, run: Callable[[list[tuple]], Iterable[tuple]], made: pa.Schema, ddl: str, most: int = 2048) -> DataFrame:
    """What run() makes of all rows of a key (df's first columns), in order; one shuffle by key. Only the rows of one key and of one batch are held."""

    def of_part(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        close = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)
        for rows in runs(parts, len(keys)):
            out += run(rows)
            if len(out) >= most:
                yield close()
                out = []
        if out:
            yield close()

    return bounded(df).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(of_part, ddl)
