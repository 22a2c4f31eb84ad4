"""What the operators share: reading tables, cutting lineage, Arrow helpers."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seasonwise.session import cut_lineage, written

__all__ = ["read", "cut_lineage", "written", "map_rows", "map_columns", "tokenizer_path"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def map_rows(df: DataFrame, function: Callable[[Iterator[list]], Iterable[tuple]],
             schema: str, batch_rows: int = 4096, read_rows: int | None = None) -> DataFrame:
    """``df`` through a generator over its rows, in Arrow batches.

    ``function`` gets an iterator over the rows of a partition, each batch as a list of
    columns (Python lists), and yields output rows as tuples. With ``read_rows`` at most so many
    rows of a batch are Python objects at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rows = []
        source = ([column.to_pylist() for column in part.columns] for batch in batches
                  for part in _parts(batch, read_rows))
        for row in function(source):
            rows.append(row)
            if len(rows) >= batch_rows:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, function: Callable[[Iterator[list]], Iterable[list]],
                schema: str, read_rows: int | None = None) -> DataFrame:
    """As ``map_rows``, but ``function`` yields batches: a list of values for every column."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in function([column.to_pylist() for column in part.columns]
                                for batch in batches for part in _parts(batch, read_rows)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=field.type) for values, field in zip(columns, arrow)],
                schema=arrow)

    return df.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int | None) -> Iterator[pa.RecordBatch]:
    step = rows or max(1, batch.num_rows)
    return (batch.slice(at, step) for at in range(0, max(1, batch.num_rows), step))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema)],
        schema=schema)
