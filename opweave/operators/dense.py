"""Dense matrices, batches of them, and rotations."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from opweave.expr import Field, Operator
from opweave.operators.sparse import MatrixOperator
from opweave.values import ddl, row_values, times, total


class DenseOperator(MatrixOperator):
    def __init__(self, data, **flags):
        data = np.asarray(data)
        data = data.astype(float) if data.dtype.kind in "iub" else data
        super().__init__(*data.shape, real=not np.iscomplexobj(data), **({"name": "Dense", "square": data.shape[0] == data.shape[1]} | flags))
        self.data = data

    def matrix(self):
        return self.data

    def entries(self):
        i, j = np.indices(self.data.shape)
        return i.ravel(), j.ravel(), self.data.ravel()

    def on_array(self, x):
        return np.asarray(x) @ self.data.T

    def takes_rows(self, n):
        return n == self.shapein

    def on_column(self, c: Column, index=None) -> Column:
        """An array column: one dot product for each row of the matrix."""
        x = F.transform(c, lambda e: e.cast("double"))
        return F.array(*[F.aggregate(F.zip_with(x, F.lit(row.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) for row in self.data])

    def conjugate_(self):
        return self if self.real else DenseOperator(self.data.conj())

    def transpose_(self):
        return DenseOperator(self.data.T)

    def inverse_(self):
        return DenseOperator(np.linalg.inv(self.data)) if self.shapein == self.shapeout else None


class DenseBlockDiagonalOperator(Operator):
    """A batch of matrices, data[..., m, n], each applied to its own vector x[..., n]; block axes broadcast.

    On a field the block's number is the key ``block``; a field without that key is used by every block."""

    def __init__(self, data, **flags):
        self.data = np.asarray(data)
        super().__init__(shapein=self.data.shape[-1], shapeout=self.data.shape[-2], linear=True, real=not np.iscomplexobj(self.data), name="DenseBlocks", **flags)

    def on_array(self, x):
        return np.einsum("...mn,...n->...m", self.data, x)

    def on_field(self, f):
        flat = self.data.reshape(-1, *self.data.shape[-2:])
        rows = [(b, i, j, row_values(flat[b, i, j])) for b, i, j in product(*map(range, flat.shape))]
        m = f.df.sparkSession.createDataFrame(rows, f"block long, r long, j long, a {ddl(flat)}")
        on = ["block", "j"] if "block" in f.keys else ["j"]
        x = f.df.withColumnRenamed("i", "j")
        keys = tuple(dict.fromkeys([*f.keys, "block"]))
        out = x.join(m, on).groupBy(*keys, F.col("r").alias("i")).agg(total(times(F.col("a"), F.col("v"), not self.real, f.is_complex), not self.real or f.is_complex).alias("v"))
        return Field(out, self.shapeout, keys, f.dense)

    def conjugate_(self):
        return self if self.real else DenseBlockDiagonalOperator(self.data.conj())

    def transpose_(self):
        return DenseBlockDiagonalOperator(np.swapaxes(self.data, -1, -2))

    def inverse_(self):
        return DenseBlockDiagonalOperator(np.linalg.inv(self.data)) if self.shapein == self.shapeout else None


def dense(data, naxes: int = 1, naxesin: int | None = None, naxesout: int | None = None, naxesextra: int = 0, broadcast: str = "leftward") -> Operator:
    """The operator of an array whose axes are extra ones (a batch), then the output's, then the input's; the
    latter two are flattened in C order. A number alone is a homothety. ``rightward`` takes the batch's axes last."""
    from opweave.operators.diagonal import HomothetyOperator

    a = np.asarray(data)
    if a.ndim == 0:
        return HomothetyOperator(a[()])
    if broadcast not in ("leftward", "rightward", "disabled"):
        raise ValueError(f"no broadcast {broadcast!r} for a dense operator")
    nin = naxesin if naxesin is not None else a.ndim - naxesextra - naxesout if naxesout is not None else naxes
    nout = naxesout if naxesout is not None else a.ndim - naxesextra - nin
    if nin < 1 or nout < 1 or nin + nout + naxesextra != a.ndim:
        raise ValueError(f"{a.ndim} axes aren't {naxesextra} extra, {nout} output and {nin} input axes")
    if broadcast == "rightward" and naxesextra:
        a = np.moveaxis(a, range(a.ndim - naxesextra, a.ndim), range(naxesextra))
    extra = a.shape[:naxesextra]
    a = a.reshape(*extra, int(np.prod(a.shape[naxesextra : naxesextra + nout])), -1)
    return DenseBlockDiagonalOperator(a) if naxesextra else DenseOperator(a)


def _angle(a, degrees: bool):
    return np.radians(a) if degrees else np.asarray(a, float)


class Rotation2dOperator(DenseBlockDiagonalOperator):
    def __init__(self, angle, degrees: bool = False):
        a = _angle(angle, degrees)
        c, s = np.cos(a), np.sin(a)
        super().__init__(np.moveaxis(np.array([[c, -s], [s, c]]), (0, 1), (-2, -1)), orthogonal=True)
        self.name = "Rotation2d"

    def on_columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Two coordinates as columns, for one angle."""
        (a, b), (c, d) = self.data.tolist()
        return F.lit(a) * x + F.lit(b) * y, F.lit(c) * x + F.lit(d) * y


def _axis(axis: str, a):
    c, s, one, zero = np.cos(a), np.sin(a), np.ones_like(a), np.zeros_like(a)
    m = {"X": [[one, zero, zero], [zero, c, -s], [zero, s, c]], "Y": [[c, zero, s], [zero, one, zero], [-s, zero, c]], "Z": [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]
    return np.moveaxis(np.array(m), (0, 1), (-2, -1))


class Rotation3dOperator(DenseBlockDiagonalOperator):
    """A convention names one to three axes; primes make it intrinsic (R_1 R_2 R_3), else it is extrinsic (R_3 R_2 R_1)."""

    def __init__(self, convention: str, *angles, degrees: bool = False):
        axes = convention.replace("'", "")
        if len(axes) != len(angles) or not 1 <= len(axes) <= 3 or set(axes) - set("XYZ") or any(a == b for a, b in zip(axes, axes[1:])):
            raise ValueError(f"{convention!r} with {len(angles)} angles is no rotation convention")
        ms = [_axis(x, _angle(a, degrees)) for x, a in zip(axes, np.broadcast_arrays(*map(np.asarray, angles)))]
        out = np.eye(3)
        for m in ms if "'" in convention else ms[::-1]:
            out = out @ m
        super().__init__(out, orthogonal=True)
        self.name = f"Rotation3d[{convention}]"

    def on_columns(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        return tuple(F.lit(a) * x + F.lit(b) * y + F.lit(c) * z for a, b, c in self.data.tolist())
