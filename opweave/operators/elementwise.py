"""Nonlinear and scalar-function operators, all as column expressions with NumPy's treatment of NaN."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from opweave.expr import Field, Operator
from opweave.operators.diagonal import at_index
from opweave.values import reciprocal


class ElementwiseOperator(Operator):
    def __init__(self, name=None, **flags):
        super().__init__(square=True, separable=True, name=name or type(self).__name__.removesuffix("Operator"), **flags)


def _bound(v, index) -> Column:
    return at_index(np.asarray(v, float), index)


def _nan_safe(c: Column, out: Column) -> Column:
    """NaN stays NaN (Spark orders it above all numbers)."""
    return F.when(F.isnan(c), c).otherwise(out)


class ClipOperator(ElementwiseOperator):
    def __init__(self, vmin, vmax):
        super().__init__(idempotent=False)
        self.vmin, self.vmax = np.asarray(vmin, float), np.asarray(vmax, float)

    def on_array(self, x):
        return np.clip(x, self.vmin, self.vmax)

    def on_column(self, c, index=None):
        return _nan_safe(c, F.least(F.greatest(c, _bound(self.vmin, index)), _bound(self.vmax, index)))


class MaximumOperator(ElementwiseOperator):
    def __init__(self, value):
        super().__init__()
        self.value = np.asarray(value, float)

    def on_array(self, x):
        return np.maximum(x, self.value)

    def on_column(self, c, index=None):
        return _nan_safe(c, F.greatest(c, _bound(self.value, index)))


class MinimumOperator(MaximumOperator):
    def on_array(self, x):
        return np.minimum(x, self.value)

    def on_column(self, c, index=None):
        return _nan_safe(c, F.least(c, _bound(self.value, index)))


class PowerOperator(ElementwiseOperator):
    def __new__(cls, n=None):
        if cls is PowerOperator:
            from opweave.operators.diagonal import ConstantOperator, IdentityOperator

            simple = {-1: ReciprocalOperator, 0: lambda: ConstantOperator(1.0), 0.5: SqrtOperator, 1: IdentityOperator, 2: SquareOperator}
            if n in simple:
                return simple[n]()
        return super().__new__(cls)

    def __init__(self, n=None):
        self._init(n)

    def _init(self, n):
        super().__init__(name=f"x**{n:g}")
        self.n = n

    def on_array(self, x):
        return np.asarray(x, float) ** self.n

    def on_column(self, c, index=None):
        return F.pow(c, F.lit(float(self.n)))

    def inverse_(self):
        return PowerOperator(1 / self.n)


class ReciprocalOperator(PowerOperator):
    def __init__(self, n=None):
        self._init(-1)
        self.flags["involutary"] = True

    def on_array(self, x):
        with np.errstate(divide="ignore"):
            return 1 / np.asarray(x, float)

    def on_column(self, c, index=None):
        return reciprocal(c)


class SqrtOperator(PowerOperator):
    def __init__(self, n=None):
        self._init(0.5)

    def on_array(self, x):
        with np.errstate(invalid="ignore"):
            return np.sqrt(x)

    def on_column(self, c, index=None):
        return F.sqrt(c)


class SquareOperator(PowerOperator):
    def __init__(self, n=None):
        self._init(2)

    def on_column(self, c, index=None):
        return c * c


def _log(of, least: float = 0.0):
    """A logarithm with NumPy's values where Spark gives null: -inf at ``least`` and NaN below."""
    return lambda c: F.when(c == least, F.lit(float("-inf"))).when(c < least, F.lit(float("nan"))).otherwise(of(c))


#: NumPy names of functions of one argument, as Spark's.
UFUNCS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "expm1": F.expm1, "log": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10), "log1p": _log(F.log1p, -1.0), "sqrt": F.sqrt, "cbrt": F.cbrt, "absolute": F.abs, "fabs": F.abs, "negative": F.negative, "sign": F.signum, "rint": F.rint, "degrees": F.degrees, "radians": F.radians, "square": lambda c: c * c, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double")}


class UfuncOperator(ElementwiseOperator):
    """A NumPy function of one argument, by name."""

    def __init__(self, name: str):
        super().__init__(name=name, linear=name == "negative")
        self.f = name

    def on_array(self, x):
        return getattr(np, self.f)(x)

    def on_column(self, c, index=None):
        return UFUNCS[self.f](c)


class DegreesOperator(ElementwiseOperator):
    def __init__(self):
        super().__init__(linear=True, symmetric=True)

    def on_array(self, x):
        return np.degrees(x)

    def on_column(self, c, index=None):
        return F.degrees(c)

    def inverse_(self):
        return RadiansOperator()


class RadiansOperator(ElementwiseOperator):
    def __init__(self):
        super().__init__(linear=True, symmetric=True)

    def on_array(self, x):
        return np.radians(x)

    def on_column(self, c, index=None):
        return F.radians(c)

    def inverse_(self):
        return DegreesOperator()


class RoundOperator(ElementwiseOperator):
    """rtz towards zero, rtmi down, rtpi up, rhtmi / rhtpi / rhte nearest with halves down / up / to even."""

    METHODS = {
        "rtz": (np.trunc, lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")),
        "rtmi": (np.floor, lambda c: F.floor(c).cast("double")),
        "rtpi": (np.ceil, lambda c: F.ceil(c).cast("double")),
        "rhtmi": (lambda x: np.ceil(x - 0.5), lambda c: F.ceil(c - 0.5).cast("double")),
        "rhtpi": (lambda x: np.floor(x + 0.5), lambda c: F.floor(c + 0.5).cast("double")),
        "rhte": (np.rint, F.rint),
    }

    def __init__(self, method: str = "rhte"):
        if method not in self.METHODS:
            raise ValueError(f"no rounding {method!r}; there are {', '.join(self.METHODS)}")
        super().__init__(name=f"round[{method}]")
        self.method = method

    def on_array(self, x):
        return self.METHODS[self.method][0](x)

    def on_column(self, c, index=None):
        return self.METHODS[self.method][1](c)


class HardThresholdingOperator(ElementwiseOperator):
    def __new__(cls, a):
        from opweave.operators.diagonal import IdentityOperator

        if (np.asarray(a) < 0).any():
            raise ValueError("a threshold is not negative")
        return IdentityOperator() if cls is HardThresholdingOperator and not np.any(a) else super().__new__(cls)

    def __init__(self, a):
        super().__init__(name="hard")
        self.a = np.asarray(a, float)

    def on_array(self, x):
        return np.where(np.abs(x) > self.a, x, 0)

    def on_column(self, c, index=None):
        return F.when(F.abs(c) > _bound(self.a, index), c).otherwise(F.lit(0.0))


class SoftThresholdingOperator(ElementwiseOperator):
    def __init__(self, a):
        if (np.asarray(a) < 0).any():
            raise ValueError("a threshold is not negative")
        super().__init__(name="soft")
        self.a = np.asarray(a, float)

    def on_array(self, x):
        return np.sign(x) * np.maximum(np.abs(x) - self.a, 0)

    def on_column(self, c, index=None):
        return F.signum(c) * F.greatest(F.abs(c) - _bound(self.a, index), F.lit(0.0)) + F.lit(0.0)


#: Names that an expression string may use besides ``input`` and columns passed with it.
NAMES = frozenset("input sin cos tan asin acos atan atan2 sinh cosh tanh exp expm1 ln log log10 log1p sqrt abs floor ceil power pow greatest least signum case when then else end and or not".split())


def checked(expr: str, extra=()) -> str:
    """The expression, if it uses no other names than those allowed."""
    bad = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"\d[\d.]*([eE][-+]?\d+)?", " ", expr))) - NAMES - set(extra)
    if bad or re.search(r"[;`\"'\\]", expr):
        raise ValueError(f"not allowed in an expression: {sorted(bad) or expr}")
    return expr


class NumexprOperator(ElementwiseOperator):
    """An expression string of the variable ``input``."""

    def __init__(self, expr: str):
        super().__init__(name=f"expr({expr})")
        self.expr = checked(expr)

    def on_array(self, x):
        env = {n: getattr(np, {"asin": "arcsin", "acos": "arccos", "atan": "arctan", "ln": "log", "pow": "power"}.get(n, n), None) for n in NAMES}
        return eval(self.expr, {"__builtins__": {}}, env | {"input": np.asarray(x)})  # noqa: S307  names are checked

    def on_field(self, f: Field) -> Field:
        f = f.densified()
        return f.values(F.expr(re.sub(r"\binput\b", "v", self.expr)))

    def on_column(self, c, index=None):
        return _substitute(self.expr, c)


def _substitute(expr: str, c: Column) -> Column:
    return F.expr(re.sub(r"\binput\b", f"({c._jc.toString()})", expr))


class NormalizeOperator(Operator):
    """x / |x| along the vector; on an array column, or on a field."""

    def __init__(self):
        super().__init__(square=True, name="Normalize")

    def on_array(self, x):
        return x / np.sqrt((np.asarray(x, float) ** 2).sum(axis=-1, keepdims=True))

    def on_column(self, c, index=None):
        d = F.transform(c, lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(d, lambda x: x / norm)

    def on_field(self, f):
        keys = list(f.keys)
        norm = f.df.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        df = f.df.join(norm, keys) if keys else f.df.join(F.broadcast(norm))  # one row without keys
        return Field(df.withColumn("v", F.col("v") / F.col("norm")).drop("norm"), f.n, f.keys, f.dense)


class To1dOperator(Operator):
    """Index tuples to flat indices, in C or F order: an array column, or a NumPy array whose last axis is the tuple."""

    def __init__(self, shape, order: str = "C"):
        if len(shape) < 2:
            raise NotImplementedError("one-dimensional shapes have nothing to convert")
        super().__init__(name="To1d")
        steps = np.cumprod([1, *shape[:0:-1]])[::-1] if order == "C" else np.cumprod([1, *shape[:-1]])
        self.dims, self.order, self.steps = tuple(shape), order, [int(s) for s in steps]

    def on_array(self, x):
        return (np.asarray(x) * self.steps).sum(axis=-1)

    def on_column(self, c, index=None):
        out = F.get(c, F.lit(0)) * self.steps[0]
        for k, s in enumerate(self.steps[1:], 1):
            out = out + F.get(c, F.lit(k)) * s
        return out

    def inverse_(self):
        return ToNdOperator(self.dims, self.order)


class ToNdOperator(Operator):
    def __init__(self, shape, order: str = "C"):
        super().__init__(name="ToNd")
        one = To1dOperator(shape, order)
        self.dims, self.order, self.steps = one.dims, order, one.steps

    def on_array(self, x):
        return np.stack([np.asarray(x) // s % n for s, n in zip(self.steps, self.dims)], axis=-1)

    def on_column(self, c, index=None):
        return F.array(*[F.pmod(F.floor(c / s), F.lit(n)).cast("long") for s, n in zip(self.steps, self.dims)])

    def inverse_(self):
        return To1dOperator(self.dims, self.order)
