"""Row generators in Arrow batches: a function from a row's values to rows, with the other columns repeated beside them.

For what expressions can't do in linear time within a row: running offsets, many patterns at once, counts by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are held before they are handed on, and most bytes of an Arrow batch.
FLUSH, BATCH_BYTES = 50_000, 4 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of the session at BATCH_BYTES at most: a batch of long texts else holds tens of megabytes, several times over, in the JVM and in each worker."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES_KEY))
    if int(now) > BATCH_BYTES:
        spark.conf.set(_BYTES_KEY, str(BATCH_BYTES))


def generated(rows: DataFrame, keep: Sequence[str], inputs: Sequence[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """The columns in keep, then those of schema, for each tuple that make()(*inputs of a row) yields.

    make is called once a task, so that what it builds is built once. A row without tuples has no result rows.
    """
    bounded_batches(rows.sparkSession)
    out = T.StructType.fromDDL(schema)
    names, types = [f.name for f in out], [to_arrow_type(f.dataType) for f in out]
    whole = T.StructType([*[rows.schema[c] for c in keep], *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for i, values in enumerate(zip(*(batch.column(len(keep) + k).to_pylist() for k in range(len(inputs))), strict=True)):
                before = len(found)
                found.extend(find(*values))
                at += [i] * (len(found) - before)
                if len(found) >= FLUSH:
                    yield _batch(batch, keep, at, found, names, types)
                    at, found = [], []
            if found:
                yield _batch(batch, keep, at, found, names, types)

    return rows.select(*keep, *inputs).mapInArrow(run, whole)


def _batch(batch: pa.RecordBatch, keep: Sequence[str], at: list[int], found: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    index = pa.array(at, pa.int32())
    columns = [batch.column(k).take(index) for k in range(len(keep))]
    made = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *made], [*keep, *names])
