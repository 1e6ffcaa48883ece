"""Reductions along the vector axis."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from opweave.expr import Field, Operator
from opweave.operators.axes import Axial
from opweave.values import total


def nan_min(c):
    """The minimum, NaN if any value is (Spark's own skips NaN when there are others)."""
    return F.when(F.bool_or(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c))


#: NumPy reductions by name, as aggregates.
AGGREGATES = {"add": F.sum, "multiply": F.product, "maximum": F.max, "minimum": nan_min, "logical_and": F.bool_and, "logical_or": F.bool_or, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "nansum": lambda c: F.sum(F.nanvl(c, F.lit(0.0)))}


def _grouped(func):
    """A NumPy function with ``axis`` as an aggregate over Arrow batches, for functions that Spark has no own one for."""
    import pandas as pd

    def whole(s):
        return float(func(s.to_numpy(), axis=0))

    whole.__annotations__ = {"s": pd.Series, "return": float}
    return F.pandas_udf(whole, "double")


class ReductionOperator(Axial, Operator):
    """A binary ufunc, a NumPy function with ``axis``, or a name of AGGREGATES; ``aggregate`` may give the Spark
    side (else a function without one runs as a grouped-aggregate pandas UDF). ``skipna`` leaves NaN out; ``dtype``
    is that of the result. With ``shape`` and ``axis``, along an axis of arrays; without an axis, of all elements."""

    def __init__(self, func, aggregate=None, n: int | None = None, dtype=None, skipna: bool = False):
        if isinstance(func, np.ufunc) and func.nin != 2:
            raise TypeError("a reduction needs a function of two arguments")
        name = func if isinstance(func, str) else getattr(func, "__name__", str(func))
        super().__init__(shapein=n, shapeout=1, name=f"reduce[{name}]", linear=name in ("add", "mean") and not skipna)
        self.func = getattr(np, func, None) if isinstance(func, str) else func
        self.dtype, self.skipna = dtype and np.dtype(dtype), skipna
        self.aggregate = aggregate or AGGREGATES.get(name)

    def on_array(self, x):
        x = np.asarray(x)
        f = self.func.reduce if isinstance(self.func, np.ufunc) else self.func
        if not self.skipna:
            out = np.asarray(f(x, axis=-1))
        elif isinstance(self.func, np.ufunc):
            start = {"maximum": -np.inf, "minimum": np.inf}.get(self.func.__name__, self.func.identity)
            out = np.where(np.isnan(x).all(axis=-1) & (self.func.identity is None), np.nan, f(x, axis=-1, where=~np.isnan(x), initial=start))
        else:
            out = np.asarray(getattr(np, f"nan{self.func.__name__}")(x, axis=-1))
        return (out if self.dtype is None else out.astype(self.dtype))[..., None]

    def on_field(self, f: Field) -> Field:
        if f.is_complex:
            if self.aggregate is not AGGREGATES["add"] or self.skipna:
                raise TypeError(f"{self.name} takes real fields")
            v = total(F.col("v"), True)
        else:
            f = f.densified()
            c = F.col("v")
            v = (self.aggregate or _grouped(self.func))(F.when(~F.isnan(c), c) if self.skipna else c)
            if self.skipna and self.aggregate is AGGREGATES["add"]:
                v = F.coalesce(v, F.lit(0.0))
            if self.dtype is not None:
                v = v.cast({"f4": "float", "f8": "double", "i8": "long", "i4": "int", "b1": "boolean"}[self.dtype.str[1:]])
        df = f.df.groupBy(*f.keys).agg(v.alias("v"))
        return replace(f, df=df.withColumn("i", F.lit(0).cast("long")), n=1)


class ProductOperator(ReductionOperator):
    def __init__(self, n=None, dtype=None, skipna=False):
        super().__init__(np.multiply, n=n, dtype=dtype, skipna=skipna)


class MaxOperator(ReductionOperator):
    def __init__(self, n=None, dtype=None, skipna=False):
        super().__init__(np.maximum, n=n, dtype=dtype, skipna=skipna)


class MinOperator(ReductionOperator):
    def __init__(self, n=None, dtype=None, skipna=False):
        super().__init__(np.minimum, n=n, dtype=dtype, skipna=skipna)


class MinMaxOperator(Axial, Operator):
    """[minimum, maximum] of a vector, at indices 0 and 1; with ``new_axis``, each a vector of length 1 under a key
    of that name (arrays: on an axis of their own before the last)."""

    def __init__(self, n=None, dtype=None, new_axis: str | None = None):
        super().__init__(shapein=n, shapeout=1 if new_axis else 2, name="MinMax")
        self.new_axis, self.dtype = new_axis, dtype

    def on_array(self, x):
        out = np.stack([np.min(x, axis=-1), np.max(x, axis=-1)], axis=-1)
        out = out if self.dtype is None else out.astype(self.dtype)
        return out[..., None] if self.new_axis else out

    def on_field(self, f):
        f = f.densified()
        df = f.df.groupBy(*f.keys).agg(nan_min(F.col("v")).alias("low"), F.max("v").alias("high"))
        out = df.select(*f.keys, F.posexplode(F.array("low", "high")).alias("i", "v")).withColumn("i", F.col("i").cast("long"))
        if not self.new_axis:
            return replace(f, df=out, n=2)
        return replace(f, df=out.withColumnRenamed("i", self.new_axis).withColumn("i", F.lit(0).cast("long")), n=1, keys=(*f.keys, self.new_axis))
