"""Registry of runnable queries over the given tables, each beside its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in the item role: id, concept, family, part, vec."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("concept"),
        (F.col("label") % 5).cast("long").alias("family"), (F.col("vec_id") % 4).cast("long").alias("part"),
        F.col("embedding").cast("array<double>").alias("vec"))


ITEMS = """items AS (SELECT vec_id::BIGINT AS id, label::BIGINT AS concept, (label % 5)::BIGINT AS family,
 (vec_id % 4)::BIGINT AS part, embedding::DOUBLE[] AS vec FROM embeddings)"""


def queries_side(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "query_id")


def pool_side(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "doc_id")


def r(col, digits: int = 6):
    """Rounded double with no negative zero, for comparable output."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def big(col):
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint")


def literal_rows(spark: SparkSession, columns: str, *rows: tuple) -> DataFrame:
    """A few constant rows as a local relation (no Python workers involved)."""
    names = columns.split()
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(structs).alias("_r")).select("_r.*")
