"""Helpers on shapes, types and complex columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from opweave.operators.block import split  # noqa: F401
from opweave.operators.diagonal import special_values as inspect_special_values  # noqa: F401
from opweave.values import abs2, complex_, conjugate, multiply, multiply_conjugate  # noqa: F401


def broadcast_shapes(*shapes: tuple) -> tuple:
    return np.broadcast_shapes(*shapes)


def tointtuple(x) -> tuple[int, ...] | None:
    return None if x is None else tuple(int(i) for i in np.atleast_1d(x))


def merge_none(a, b):
    """One tuple from two, None standing for what is not known."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) != len(b) or any(None not in (x, y) and x != y for x, y in zip(a, b)):
        raise ValueError(f"{a} and {b} don't agree")
    return tuple(y if x is None else x for x, y in zip(a, b))


def product(a) -> int:
    return int(np.prod(tuple(a), dtype=np.int64))


def strshape(shape) -> str:
    return str(shape[0]) if len(shape) == 1 else "(" + ",".join(map(str, shape)) + ")"


def strenum(choices, last: str = "or") -> str:
    words = [f"'{c}'" for c in choices]
    return words[0] if len(words) == 1 else f"{', '.join(words[:-1])} {last} {words[-1]}"


def strplural(n: int, name: str) -> str:
    return f"{n or 'no'} {name}{'s' if n > 1 or not n else ''}"


def strnbytes(n: int) -> str:
    for unit in ("bytes", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:g} {unit}"
        n = n / 1024
    return f"{n:g} TiB"


def least_greater_multiple(a: int, factors) -> int:
    """The least number, not below a, whose prime factors are among these."""
    n = a
    while True:
        m = n
        for f in factors:
            while m % f == 0:
                m //= f
        if m == 1:
            return n
        n += 1


def float_dtype(d) -> np.dtype:
    return np.result_type(np.dtype(d), np.float64 if np.dtype(d).kind in "iub" else d)


def complex_dtype(d) -> np.dtype:
    return np.result_type(np.dtype(d), np.complex64 if np.dtype(d).itemsize < 8 and np.dtype(d).kind == "f" else np.complex128)


def masking(c: Column, mask: Column) -> Column:
    return F.when(mask, F.lit(0.0)).otherwise(c)
