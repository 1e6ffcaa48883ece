"""Element-wise operators on streams: they are projections, and work on a streaming DataFrame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.expr import Operator


def apply_to_stream(op: Operator, df: DataFrame, value: str, out: str = "v") -> DataFrame:
    if not op.separable:
        raise ValueError(f"{op} is not element-wise; a stream has no whole vectors")
    return df.withColumn(out, op.on_column(F.col(value)))
