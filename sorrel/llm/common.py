"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, as (_id, _text): other columns can never clash."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> Iterator[str | None]:
    """The texts of a batch one at a time, so a batch of long texts is never held twice."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


def signed(values):
    """Unsigned 64-bit numbers as the longs that Spark stores."""
    return values.astype("uint64").view("int64")


#: Rows of a slice: what a worker builds for its output at once.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that results of long texts do not pile up in a worker."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)
