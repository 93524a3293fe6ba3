"""Python code over rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of a batch that goes back.
ROWS = 20_000


#: Bytes that a task of a scan reads, about, and tasks per core below which slow work on rows is spread out.
SPLIT_BYTES, TASKS_A_CORE = 128 << 20, 4


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where a scan would give so few tasks that the slowest decide.

    For CPU-bound work on texts over a table of a few files.  The table's size is the optimiser's estimate, nothing is run;
    large tables have tasks enough and aren't moved.
    """
    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size // SPLIT_BYTES >= tasks else df.repartition(tasks)


def rows_mapped(df: DataFrame, each: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """The rows that `each` makes of every row, in batches; columns it doesn't name are null."""
    names = [f.name for f in _parse_datatype_string(schema).fields]
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                for made in each(row):
                    out.append(made)
                    if len(out) >= ROWS:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)
