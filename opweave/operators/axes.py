"""Operators along one axis of arrays that are held as flat vectors in C order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from opweave.expr import Field, Operator


class AxisOperator(Operator):
    """``op``, an operator of vectors, along an axis of arrays of one shape; the axis may change its length."""

    def __init__(self, op: Operator, shape: tuple[int, ...], axis: int):
        shape, axis = tuple(shape), axis % len(shape)
        n = shape[axis]
        if op.shapein is not None and op.shapein != n:
            raise ValueError(f"{op.name} takes length {op.shapein}, axis {axis} of {shape} has {n}")
        self.op, self.axis, self.shape_in = op, axis, shape
        self.length = op.shapeout if op.shapeout is not None else n
        self.shape_out = (*shape[:axis], self.length, *shape[axis + 1 :])
        kept = ("linear", "real", "square", "symmetric", "hermitian", "orthogonal", "unitary", "idempotent", "involutary")
        super().__init__(shapein=int(np.prod(shape)), shapeout=int(np.prod(self.shape_out)), name=f"{op.name}[axis {axis}]", **{k: op.flags[k] for k in kept})

    def on_array(self, x):
        x = np.asarray(x)
        y = np.moveaxis(x.reshape(*x.shape[:-1], *self.shape_in), x.ndim - 1 + self.axis, -1)
        y = np.moveaxis(self.op(y), -1, x.ndim - 1 + self.axis)
        return y.reshape(*x.shape[:-1], -1)

    def takes_rows(self, n):
        return n == self.shapein and self.op.takes_rows(self.shape_in[self.axis])

    def on_field(self, f: Field) -> Field:
        n, inner = self.shape_in[self.axis], int(np.prod(self.shape_in[self.axis + 1 :]))
        whole = lambda c, k: F.floor(c / F.lit(k)).cast("long")
        i = F.col("i")
        rest = whole(i, n * inner) * inner + F.pmod(i, F.lit(inner))  # the index without this axis
        x = f.df.select(*f.keys, rest.cast("long").alias("_rest"), F.pmod(whole(i, inner), F.lit(n)).cast("long").alias("i"), "v")
        y = self.op(Field(x, n, (*f.keys, "_rest"), f.dense))
        r = F.col("_rest")
        back = (whole(r, inner) * self.length + i) * inner + F.pmod(r, F.lit(inner))
        return Field(y.df.select(*f.keys, back.cast("long").alias("i"), "v"), self.shapeout, f.keys, y.dense)

    def conjugate_(self):
        return self if self.real else AxisOperator(self.op.C, self.shape_in, self.axis)

    def transpose_(self):
        return AxisOperator(self.op.T, self.shape_out, self.axis) if self.linear else None

    def inverse_(self):
        return AxisOperator(self.op.I, self.shape_out, self.axis)


class Axial:
    """Base of operators of vectors that can also be built for an axis of arrays: ``Cls(shape=..., axis=...)``.
    Without an axis the flat vector is taken as a whole."""

    def __new__(cls, *args, shape=None, axis=None, **kw):
        if shape is not None:
            op = cls(*args, n=int(np.prod(shape)) if axis is None else shape[axis], **kw)
            return op if axis is None else AxisOperator(op, shape, axis)
        return super().__new__(cls)

    def __init_subclass__(cls, **kw):
        """__init__ isn't run again on what __new__ made for a shape."""
        super().__init_subclass__(**kw)
        if "__init__" in cls.__dict__:
            init = cls.__dict__["__init__"]

            def once(self, *args, shape=None, axis=None, _init=init, **k):
                if shape is None:
                    _init(self, *args, **k)

            cls.__init__ = once
