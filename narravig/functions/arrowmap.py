"""One-to-many functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def flat_map(
    df: DataFrame,
    columns: Sequence,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    flush_rows: int = 4096,
    flush_chars: int = 8_000_000,
) -> DataFrame:
    """Rows that the function from ``make()`` yields for each row's ``columns``.

    ``make`` runs once per task, so that it can build tables there; if what it gives has an attribute ``ahead``, that is called
    with the rows of each batch before they are worked on. Output leaves in batches of at most
    ``flush_rows`` rows or about ``flush_chars`` characters, so that long texts don't pile up in a worker.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    names = [f.name for f in kind.fields]
    texts = [i for i, f in enumerate(kind.fields) if f.dataType.simpleString() == "string"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, type=arrow.field(i).type) for i, values in enumerate(zip(*rows))], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        rows: list[tuple] = []
        size = 0
        for b in batches:
            given = list(zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
            if hasattr(each, "ahead"):
                each.ahead(given)
            for values in given:
                for row in each(*values):
                    rows.append(row)
                    size += sum(len(row[i]) for i in texts if row[i] is not None)
                    if len(rows) >= flush_rows or size >= flush_chars:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    assert names
    return df.select(*columns).mapInArrow(run, schema)
