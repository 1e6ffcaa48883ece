"""Operators given by matrix entries: sparse, banded, Toeplitz; difference, sums and integration.

On fields a product is a join on the column index and a sum over rows; entries from the driver are a
small frame, which Spark broadcasts by its own size limit, entries in a DataFrame of any size are not.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opweave.expr import Field, Operator
from opweave.operators.axes import Axial
from opweave.values import complex_, ddl, is_complex, literal, row_values, times, total


#: Entries of a DataFrame that the array side will gather on the driver; fields have no such bound.
MOST_GATHERED = 10_000_000


class MatrixOperator(Operator):
    """Base: subclasses give ``entries()``, arrays (i, j, a), or a DataFrame (i, j, a) as ``frame``."""

    frame: DataFrame | None = None

    def __init__(self, m: int | None, n: int | None, real: bool = True, **flags):
        super().__init__(shapein=n, shapeout=m, linear=True, real=real, **flags)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.frame is None:
            raise NotImplementedError
        re, im = (F.col("a")["re"], F.col("a")["im"]) if is_complex(self.frame, "a") else (F.col("a"), F.lit(0.0))
        rows = self.frame.select("i", "j", re.alias("re"), im.alias("im")).limit(MOST_GATHERED + 1).toPandas()
        if len(rows) > MOST_GATHERED:
            raise ValueError(f"more than {MOST_GATHERED} entries; apply the operator to a field")
        return rows.i.to_numpy(), rows.j.to_numpy(), rows.re.to_numpy() if self.real else rows.re.to_numpy() + 1j * rows.im.to_numpy()

    def matrix(self) -> np.ndarray:
        i, j, a = self.entries()
        out = np.zeros((self.shapeout, self.shapein), np.result_type(a, float))
        np.add.at(out, (i, j), a)
        return out

    def on_array(self, x):
        i, j, a = self.entries()
        x = np.asarray(x)
        out = np.zeros((*x.shape[:-1], self.shapeout), np.result_type(a, x))
        np.add.at(np.moveaxis(out, -1, 0), i, np.moveaxis(a * x[..., j], -1, 0))
        return out

    def takes_rows(self, n):
        return self.frame is None and self.shapeout is not None and n == self.shapein and len(self.entries()[0]) <= 64 * n

    def to_frame(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        i, j, a = self.entries()
        return spark.createDataFrame([(int(p), int(q), row_values(r)) for p, q, r in zip(i, j, a)], f"i long, j long, a {ddl(a)}")

    def on_field(self, f: Field) -> Field:
        m = self.to_frame(f.df.sparkSession).select("i", "j", "a")
        x = f.df.select(*f.keys, F.col("i").alias("j"), "v")
        ac, vc = is_complex(m, "a"), f.is_complex
        out = x.join(m, "j").groupBy(*f.keys, "i").agg(total(times(F.col("a"), F.col("v"), ac, vc), ac or vc).alias("v"))
        return Field(out, self.shapeout, f.keys, dense=False)

    def transpose_(self):
        return TransposedMatrix(self)


class TransposedMatrix(MatrixOperator):
    def __init__(self, of: MatrixOperator):
        super().__init__(of.shapein, of.shapeout, of.real, name=f"{of.name}.T")
        self.of = of
        if of.frame is not None:
            self.frame = of.frame.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")

    def entries(self):
        i, j, a = self.of.entries()
        return j, i, a

    def transpose_(self):
        return self.of


class SparseOperator(MatrixOperator):
    """From entries (i, j, a) with a shape, a dense array, or a DataFrame (i, j, a) with a shape or without."""

    def __init__(self, matrix, shape: tuple[int | None, int | None] | None = None):
        if isinstance(matrix, DataFrame):
            super().__init__(*(shape or (None, None)), real=not is_complex(matrix, "a"), name="Sparse")
            self.frame = matrix
            return
        if hasattr(matrix, "tocoo"):  # any format of a sparse matrix library
            m = matrix.tocoo()
            matrix, shape = (m.row, m.col, m.data), m.shape
        if isinstance(matrix, tuple) and len(matrix) == 3:
            if shape is None:
                raise ValueError("entries need a shape")
            self.coo = tuple(np.asarray(x) for x in matrix)
        else:
            a = np.asarray(matrix)
            if a.ndim != 2:
                raise TypeError("a sparse operator needs entries, a matrix or a DataFrame")
            self.coo, shape = (*np.nonzero(a), a[np.nonzero(a)]), a.shape
        super().__init__(*shape, real=not np.iscomplexobj(self.coo[2]), name="Sparse")

    def entries(self):
        return self.coo if self.frame is None else super().entries()

    def conjugate_(self):
        if self.real:
            return self
        if self.frame is not None:
            return SparseOperator(self.frame.withColumn("a", complex_(F.col("a")["re"], -F.col("a")["im"])), (self.shapeout, self.shapein))
        return SparseOperator((self.coo[0], self.coo[1], self.coo[2].conj()), (self.shapeout, self.shapein))

    def scaled(self, a):
        if self.frame is not None:
            by = times(literal(a, isinstance(a, complex)), F.col("a"), isinstance(a, complex), not self.real)
            return SparseOperator(self.frame.withColumn("a", by), (self.shapeout, self.shapein))
        return SparseOperator((self.coo[0], self.coo[1], self.coo[2] * a), (self.shapeout, self.shapein))


def shifted(f: Field, offsets: dict[int, complex]) -> DataFrame:
    """sum over offsets k of w * x[i + k], by re-keying: no window over a whole vector is needed."""
    wc, vc = any(map(np.iscomplexobj, offsets.values())), f.is_complex
    moves = F.array(*[F.struct(F.lit(k).alias("k"), literal(w, wc).alias("w")) for k, w in offsets.items()])
    x = f.df.select(*f.keys, "i", "v", F.explode(moves).alias("m"))
    return x.groupBy(*f.keys, (F.col("i") - F.col("m.k")).alias("i")).agg(total(times(F.col("m.w"), F.col("v"), wc, vc), wc or vc).alias("v"))


class StencilOperator(MatrixOperator):
    """The same weights around every index of a vector of length n: rows 0 to m - 1."""

    def __init__(self, weights: dict[int, float], n: int | None, m: int | None = None, **flags):
        super().__init__(m if m is not None else n, n, **({"real": not any(map(np.iscomplexobj, weights.values()))} | flags))
        self.weights = weights

    def entries(self):
        rows = np.arange(self.shapeout)
        out = [(rows, rows + k, np.full(len(rows), w)) for k, w in self.weights.items()]
        i, j, a = (np.concatenate(x) for x in zip(*out))
        ok = (j >= 0) & (j < self.shapein)
        return i[ok], j[ok], a[ok]

    def on_field(self, f):
        df = shifted(f, self.weights).where(F.col("i") >= 0)
        if self.shapeout is not None:
            df = df.where(F.col("i") < self.shapeout)
        return Field(df, self.shapeout, f.keys, f.dense and self.covers())

    def covers(self) -> bool:
        """Whether every row has a weight inside the vector; unknown lengths are taken to."""
        if self.shapein is None or self.shapeout is None:
            return True
        reach = 0
        for k in sorted(self.weights, reverse=True):
            if -k <= reach:
                reach = max(reach, self.shapein - k)
        return reach >= self.shapeout

    def transpose_(self):
        """A stencil as well: its entries are never made for a field."""
        if self.shapein is None and self.shapeout is not None:
            return super().transpose_()
        return StencilOperator({-k: w for k, w in self.weights.items()}, self.shapeout, self.shapein, name=f"{self.name}.T")


class DifferenceOperator(Axial, StencilOperator):
    """x[i + 1] - x[i]; one shorter. With ``shape`` and ``axis``, along an axis of arrays."""

    def __init__(self, n: int):
        super().__init__({0: -1.0, 1: 1.0}, n, n - 1, name="Difference")


class TridiagonalOperator(MatrixOperator):
    """diagonal, sub- and superdiagonal; the latter is the former's conjugate by default."""

    def __init__(self, diagonal, subdiagonal, superdiagonal=None):
        d, lo = np.asarray(diagonal), np.asarray(subdiagonal)
        up = lo.conj() if superdiagonal is None else np.asarray(superdiagonal)
        if len(lo) != len(d) - 1 or len(up) != len(d) - 1:
            raise ValueError("sub- and superdiagonal are one shorter than the diagonal")
        real = not any(map(np.iscomplexobj, (d, lo, up)))
        super().__init__(len(d), len(d), real, square=True, symmetric=bool(np.allclose(lo, up)), hermitian=bool(np.allclose(lo, up.conj()) and np.allclose(d.imag, 0)), name="Tridiagonal")
        self.d, self.lo, self.up = d, lo, up

    def entries(self):
        n = np.arange(len(self.d))
        return np.r_[n, n[1:], n[:-1]], np.r_[n, n[:-1], n[1:]], np.r_[self.d, self.lo, self.up]

    def conjugate_(self):
        return self if self.real else TridiagonalOperator(self.d.conj(), self.lo.conj(), self.up.conj())

    def transpose_(self):
        return TridiagonalOperator(self.d, self.up, self.lo)


class BandOperator(MatrixOperator):
    """LAPACK band storage: ab[ku + i - j, j] = a[i, j]."""

    def __init__(self, ab, kl: int, ku: int, **flags):
        ab = np.atleast_2d(ab)
        if len(ab) != kl + ku + 1:
            raise ValueError("band storage has kl + ku + 1 rows")
        super().__init__(ab.shape[1], ab.shape[1], not np.iscomplexobj(ab), square=True, **({"name": "Band"} | flags))
        self.ab, self.kl, self.ku = ab, kl, ku

    def entries(self):
        r, j = np.indices(self.ab.shape)
        i = r - self.ku + j
        ok = (i >= 0) & (i < self.shapein)
        return i[ok], j[ok], self.ab[ok]


class LowerTriangularOperator(BandOperator):
    def __init__(self, ab, **flags):
        super().__init__(ab, len(np.atleast_2d(ab)) - 1, 0, name="LowerTriangular", **flags)


class UpperTriangularOperator(BandOperator):
    def __init__(self, ab, **flags):
        super().__init__(ab, 0, len(np.atleast_2d(ab)) - 1, name="UpperTriangular", **flags)


class SymmetricBandOperator(MatrixOperator):
    """One half of the bands, lower (ab[k, j] = a[j + k, j]) or upper (LAPACK storage)."""

    def __init__(self, ab, lower: bool = True):
        ab = np.atleast_2d(ab)
        super().__init__(ab.shape[1], ab.shape[1], square=True, symmetric=True, name="SymmetricBand")
        self.half = LowerTriangularOperator(ab) if lower else UpperTriangularOperator(ab)

    def entries(self):
        i, j, a = self.half.entries()
        off = i != j
        return np.r_[i, j[off]], np.r_[j, i[off]], np.r_[a, a[off]]

    def eigen(self):
        w, v = np.linalg.eigh(self.matrix())
        return EigendecompositionOperator(w=w, v=v)

    def cholesky(self):
        """Lower factor, as a band operator."""
        low = np.linalg.cholesky(self.matrix())
        k = len(self.half.ab)
        return LowerTriangularOperator(np.array([np.r_[np.diagonal(low, -d), np.zeros(d)] for d in range(k)]))


def _toeplitz(x, n: int, rows: np.ndarray) -> np.ndarray:
    """Symmetric Toeplitz products by FFT; rows' leading axes broadcast against x's."""
    k = rows.shape[-1]
    size = 1 << int(np.ceil(np.log2(n + k)))
    kernel = np.zeros((*rows.shape[:-1], size))
    kernel[..., :k] = rows
    kernel[..., size - k + 1 :] = rows[..., :0:-1]
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(kernel), size)[..., :n]


class SymmetricBandToeplitzOperator(StencilOperator):
    """Toeplitz with the given first row; on arrays by FFT, on fields as a stencil. Several first rows make a
    batch (``SymmetricBandToeplitzBatch``)."""

    def __new__(cls, n, firstrow):
        from opweave.operators.diagonal import DiagonalOperator

        row = np.atleast_1d(firstrow)
        if row.ndim > 1:
            return SymmetricBandToeplitzBatch(n, row)
        return DiagonalOperator(np.full(n, row[0])) if row.size == 1 else super().__new__(cls)

    def __init__(self, n: int, firstrow):
        row = np.asarray(firstrow, float)
        super().__init__({0: row[0]} | {s * k: w for k, w in enumerate(row[1:], 1) for s in (1, -1)}, n, square=True, symmetric=True, name="Toeplitz")
        self.row = row

    def on_array(self, x):
        return _toeplitz(x, self.shapein, self.row)


class SymmetricBandToeplitzBatch(Operator):
    """One Toeplitz operator for each first row; vectors x[..., row, :]. On a field the row's number is the key
    ``block``; a field without that key is used by every row."""

    def __init__(self, n: int, firstrows):
        super().__init__(shapein=n, shapeout=n, linear=True, square=True, symmetric=True, name="Toeplitzes")
        self.rows = np.asarray(firstrows, float)

    def on_array(self, x):
        return _toeplitz(x, self.shapein, self.rows)

    def on_field(self, f):
        if "block" in f.keys:
            keys, df = f.keys, f.df
        else:
            keys, df = (*f.keys, "block"), f.df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(self.rows) - 1).cast("long"))))
        k = self.rows.shape[-1]
        flat = F.lit(self.rows.ravel().tolist())
        x = df.select(*keys, "i", "v", F.explode(F.sequence(F.lit(1 - k), F.lit(k - 1))).alias("o"))
        w = F.get(flat, (F.col("block") * k + F.abs("o")).cast("int"))
        at = F.col("i") + F.col("o")
        out = x.where((at >= 0) & (at < self.shapein)).groupBy(*keys, at.alias("i")).agg(total(times(w, F.col("v"), False, f.is_complex), f.is_complex).alias("v"))
        return Field(out, self.shapein, keys, f.dense)


class EigendecompositionOperator(Operator):
    """V diag(w) V.T, from a symmetric matrix or from w and v."""

    def __init__(self, a=None, w=None, v=None):
        if a is not None:
            w, v = np.linalg.eigh(a.matrix() if isinstance(a, MatrixOperator) else a.todense() if isinstance(a, Operator) else np.asarray(a))
        self.eigenvalues, self.eigenvectors = np.asarray(w), np.asarray(v)
        super().__init__(linear=True, square=True, symmetric=True, shapein=len(self.eigenvectors), name="Eigen")

    def on_array(self, x):
        return ((x @ self.eigenvectors) * self.eigenvalues) @ self.eigenvectors.T

    def takes_rows(self, n):
        return n == self.shapein

    def on_field(self, f):
        from opweave.operators.dense import DenseOperator

        return DenseOperator((self.eigenvectors * self.eigenvalues) @ self.eigenvectors.T).on_field(f)

    def det(self):
        return float(np.prod(self.eigenvalues))

    def logdet(self):
        return float(np.log(self.eigenvalues).sum())

    def trace(self):
        return float(self.eigenvalues.sum())

    def cond(self):
        w = np.abs(self.eigenvalues[self.eigenvalues != 0])
        return float(w.max() / w.min())

    def __pow__(self, n):
        return EigendecompositionOperator(w=self.eigenvalues**n, v=self.eigenvectors)

    def inverse_(self):
        return self**-1


class IntegrationTrapezeOperator(MatrixOperator):
    """The integral of samples at abscissae x (two or more, monotone), one number."""

    def __init__(self, x):
        x = np.asarray(x, float)
        d = np.diff(x)
        if len(x) < 2 or not ((d >= 0).all() or (d <= 0).all()):
            raise ValueError("two or more monotone abscissae are needed")
        super().__init__(1, len(x), name="Trapeze")
        self.w = (np.r_[d, 0] + np.r_[0, d]) / 2

    def entries(self):
        n = np.arange(len(self.w))
        return np.zeros_like(n), n, self.w


def trapeze(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys..., v): integrals of y over x, for each key, of samples in any number."""
    w = Window.partitionBy(*keys).orderBy(x)
    after = df.select(*keys, x, y, F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2")).where("x2 is not null")
    return after.groupBy(*keys).agg(F.sum((F.col("x2") - F.col(x)) * (F.col(y) + F.col("y2")) * 0.5).alias("v"))


class SumOperator(Axial, MatrixOperator):
    """The sum of a vector; transposed, it repeats a number n times. With ``shape`` and ``axis``, along an axis of arrays."""

    def __init__(self, n: int | None = None):
        super().__init__(1, n, name="Sum")

    def entries(self):
        n = np.arange(self.shapein)
        return np.zeros_like(n), n, np.ones(len(n))

    def on_array(self, x):
        return np.asarray(x).sum(axis=-1, keepdims=True)

    def on_field(self, f):
        return replace(f, df=f.df.groupBy(*f.keys).agg(total(F.col("v"), f.is_complex).alias("v")).withColumn("i", F.lit(0).cast("long")), n=1)
