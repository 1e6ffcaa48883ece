"""How data becomes fields, and how a plan is looked at."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opweave.expr import LONGEST_ROW, Field, Operator, Whole


def field(df: DataFrame, index: str | Column, value: str | Column, keys=(), n: int | None = None) -> Field:
    """The vector(s) that a table holds: an index column, a value column and the columns that tell vectors apart."""
    i, v = (F.col(c) if isinstance(c, str) else c for c in (index, value))
    return Field(df.select(*keys, i.cast("long").alias("i"), v.alias("v")), n, tuple(keys))


def rows(df: DataFrame, array: str, key: str, n: int | None = None) -> Field:
    """One vector a row, from an array column; the key names one row. With a length n, vectors stay rows for the
    operators that take them so."""

    def long(t: DataFrame) -> DataFrame:
        return t.select(key, F.posexplode(array).alias("i", "v")).select(key, F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))

    f = Field(long(df), n, (key,))
    if n is None or not 0 < n <= LONGEST_ROW:
        return f
    c = F.col(array)
    full = F.coalesce((F.size(c) == n) & ~F.exists(c, F.isnull), F.lit(False))
    table = df.where(full).select(key, c.cast("array<double>").alias("x"))
    return replace(f, whole=Whole(f.df, table, Field(long(df.where(~full)), n, (key,))))


def explain(op: Operator, f: Field) -> str:
    """The operator after rewriting, and Spark's plan for applying it."""
    df = op(f).df
    return f"{op!r}\n{df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"
