"""Values of fields: a double, or for complex ones ``struct<re: double, im: double>``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def conjugate(c: Column) -> Column:
    return complex_(c["re"], -c["im"])


def multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def multiply_conjugate(a: Column, b: Column) -> Column:
    return multiply(a, conjugate(b))


def abs2(c: Column) -> Column:
    return c["re"] * c["re"] + c["im"] * c["im"]


def is_complex(df: DataFrame, name: str = "v") -> bool:
    return isinstance(df.schema[name].dataType, StructType)


def lifted(c: Column, already: bool) -> Column:
    """A value as a complex one."""
    return c if already else complex_(c, F.lit(0.0))


def literal(x, as_complex: bool = False) -> Column:
    return complex_(F.lit(float(np.real(x))), F.lit(float(np.imag(x)))) if as_complex else F.lit(float(x))


def literals(x: np.ndarray, at: Column) -> Column:
    """x[at], with the elements in the expression."""
    x = np.ravel(x)
    part = lambda a: F.get(F.lit(a.astype(float).tolist()), at.cast("int"))
    return complex_(part(x.real), part(x.imag)) if np.iscomplexobj(x) else part(x)


def times(a: Column, b: Column, a_complex: bool, b_complex: bool) -> Column:
    if a_complex and b_complex:
        return multiply(a, b)
    if a_complex or b_complex:
        c, r = (a, b) if a_complex else (b, a)
        return complex_(c["re"] * r, c["im"] * r)
    return a * b


def plus(a: Column, b: Column, a_complex: bool, b_complex: bool) -> Column:
    if not (a_complex or b_complex):
        return a + b
    a, b = lifted(a, a_complex), lifted(b, b_complex)
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def reciprocal(c: Column) -> Column:
    """1 / c by a division, whose last digit a power doesn't always share; zeros give infinities."""
    return F.when(c == 0, F.pow(c, F.lit(-1.0))).otherwise(F.lit(1.0) / c)


def divided(a: Column, b: Column, a_complex: bool = False) -> Column:
    """a / b for a real b, as NumPy has it: zeros give infinities or NaN."""
    if a_complex:
        return complex_(divided(a["re"], b), divided(a["im"], b))
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def rounded(c: Column | str, digits: int) -> Column:
    """Doubles rounded as DuckDB does: c times 10**digits to the nearest whole number, halves away from zero. Spark's
    ``round`` takes the shortest decimal that names c, which differs where few digits are left."""
    c, k = F.col(c) if isinstance(c, str) else c, F.lit(10.0**digits)
    out = F.round(c * k, 0) / k
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), c).otherwise(out)


def total(c: Column, as_complex: bool) -> Column:
    """The sum, as an aggregate."""
    return F.struct(F.sum(c["re"]).alias("re"), F.sum(c["im"]).alias("im")) if as_complex else F.sum(c)


def row_values(x) -> tuple:
    """An array's element for ``createDataFrame``."""
    return (float(x.real), float(x.imag)) if isinstance(x, complex | np.complexfloating) else float(x)


def ddl(x: np.ndarray) -> str:
    return "struct<re: double, im: double>" if np.iscomplexobj(x) else "double"
