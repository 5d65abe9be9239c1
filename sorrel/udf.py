"""Seams for user models: batching, input deduplication, join-back and output checks.

The function is the caller's; it gets plain lists and returns a matrix or a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Items that an embedding function gets at once: long texts become Python strings only so many at a time.
EMBED_ROWS = 256


def embed_items(df: DataFrame, ident: str, item: str, fn: Callable[[list], np.ndarray], dim: int, out: str = "vec") -> DataFrame:
    """(ident, unit vector) from ``fn`` over batches of items; another dimension than ``dim`` is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(lo, EMBED_ROWS)
                m = np.asarray(fn(part.column(item).to_pandas().tolist()), dtype=float)
                if m.ndim != 2 or m.shape != (len(part), dim):
                    raise ValueError(f"expected {(len(part), dim)}, got {m.shape}")
                size = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(size > 0, size, 1.0)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim), pa.int32()), pa.array(m.ravel()))
                yield pa.record_batch([part.column(ident), vectors], [ident, out])

    schema = T.StructType([df.schema[ident], T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select(*dict.fromkeys([ident, item])).mapInArrow(run, schema)


def map_distinct(df: DataFrame, inputs: Sequence[str], fn: Callable[..., list], out: str, kind: T.DataType) -> DataFrame:
    """Add ``out`` from ``fn(*input columns)``, called once per distinct input row of the whole table."""
    inputs = list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = list(fn(*[batch[c].tolist() for c in inputs]))
            if len(values) != len(batch):
                raise ValueError("the function must return one value per input")
            yield batch.assign(**{out: values})

    unique = df.select(*inputs).distinct()
    schema = T.StructType([*unique.schema.fields, T.StructField(out, kind)])
    answers = unique.mapInPandas(run, schema)
    # NULL inputs must meet their answer too
    left, right = df.alias("l"), answers.alias("r")
    cond = None
    for c in inputs:
        eq = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, "left").select("l.*", f"r.{out}")


def read_attributes(df: DataFrame, path: str, fn: Callable[[list], list], out: str = "reply") -> DataFrame:
    """Reply text per item, each path read once."""
    return map_distinct(df, [path], fn, out, T.StringType())


def judge_equivalence(df: DataFrame, fn: Callable[[list, list, list], list], x: str = "x", y: str = "y", slot: str = "slot", out: str = "match") -> DataFrame:
    """Verdict per (x, y, slot), each triple asked once."""
    return map_distinct(df, [x, y, slot], fn, out, T.BooleanType())


def score_pairs(df: DataFrame, left: str, right: str, fn: Callable[[list, list], list], out: str = "score") -> DataFrame:
    """Score per (left, right) pair, each distinct pair scored once."""
    return map_distinct(df, [left, right], fn, out, T.DoubleType())
