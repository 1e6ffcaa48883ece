"""Circular convolution, Fourier and wavelet transforms."""

from __future__ import annotations

from dataclasses import replace
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opweave.expr import Field, Operator, compose
from opweave.operators.sparse import MatrixOperator
from opweave.values import complex_, literal, times, total


def scaling_filter(wavelet: str) -> np.ndarray:
    """Scaling filter of ``haar`` or ``dbN``, N from 1 to 20 vanishing moments.

    By spectral factorisation: the half-band polynomial's roots inside the unit circle, and N roots at -1.
    """
    order = wavelet.removeprefix("db")
    n = 1 if wavelet == "haar" else int(order) if order != wavelet and order.isdecimal() else 0
    if not 1 <= n <= 20:
        raise ValueError("wavelets are haar and db1 to db20")
    y = np.roots([comb(n - 1 + k, k) for k in reversed(range(n))])
    half = 1 - 2 * y
    z = half + np.sqrt(half * half - 1 + 0j)
    z = np.where(np.abs(z) > 1, 1 / z, z)
    h = np.poly(np.r_[z, -np.ones(n)]).real
    return h * np.sqrt(2) / h.sum()


#: Taps beyond which a keyed field's convolution is done by FFT for each vector instead of as a stencil; rows of
#: one index count as their sum either way.
MOST_TAPS = 64
#: Elements beyond which a vector's transform is done in two steps of about the root's length each.
MOST_AT_ONCE = 1 << 16


class ConvolutionOperator(MatrixOperator):
    """Circular, of the input's length n; the kernel's origin is its index (k - 1) // 2."""

    def __init__(self, kernel, n: int):
        kernel = np.asarray(kernel)
        if kernel.ndim != 1 or len(kernel) > n:
            raise ValueError("the kernel has one axis and is no longer than the vector")
        super().__init__(n, n, not np.iscomplexobj(kernel), square=True, name="Convolution")
        self.kernel = kernel
        self.offsets = np.arange(len(kernel)) - (len(kernel) - 1) // 2

    @classmethod
    def of_spectrum(cls, response: np.ndarray, n: int) -> ConvolutionOperator:
        """From a whole response with its origin at index 0."""
        return cls(np.roll(response, (n - 1) // 2), n)

    def response(self) -> np.ndarray:
        out = np.zeros(self.shapein, np.result_type(self.kernel, float))
        np.add.at(out, self.offsets % self.shapein, self.kernel)
        return out

    def entries(self):
        j = np.arange(self.shapein)
        i = (j[:, None] + self.offsets) % self.shapein
        return i.ravel(), np.repeat(j, len(self.kernel)), np.tile(self.kernel, self.shapein)

    def on_array(self, x):
        out = np.fft.ifft(np.fft.fft(x) * np.fft.fft(self.response()))
        return out.real if self.real and not np.iscomplexobj(x) else out

    def takes_rows(self, n):
        return n == self.shapein

    def on_field(self, f):
        if len(self.kernel) > MOST_TAPS and f.keys:
            return per_vector(f, self.shapein, self.on_array, not self.real)
        n, wc, vc = self.shapein, not self.real, f.is_complex
        moves = F.array(*[F.struct(F.lit(int(o)).alias("o"), literal(w, wc).alias("w")) for o, w in zip(self.offsets, self.kernel)])
        x = f.df.select(*f.keys, "i", "v", F.explode(moves).alias("m"))
        i = F.pmod(F.col("i") + F.col("m.o"), F.lit(n)).cast("long")
        return Field(x.groupBy(*f.keys, i.alias("i")).agg(total(times(F.col("m.w"), F.col("v"), wc, vc), wc or vc).alias("v")), n, f.keys, f.dense)

    def conjugate_(self):
        return self if self.real else ConvolutionOperator(self.kernel.conj(), self.shapein)

    def transpose_(self):
        return ConvolutionOperator.of_spectrum(np.roll(self.response()[::-1], 1), self.shapein)


def per_vector(f: Field, n: int, work, as_complex: bool = False, length: int | None = None) -> Field:
    """A NumPy function of whole vectors, one group of rows for each; rows of one index are added up."""
    keys, as_complex = list(f.keys), as_complex or f.is_complex
    fields = [x for x in f.df.schema.fields if x.name in keys]
    given = f.is_complex

    def group(t: pa.Table) -> pa.Table:
        i, v = t["i"].to_numpy(), t["v"].combine_chunks()
        v = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False) if given else v.to_numpy(zero_copy_only=False)
        x = np.zeros(n, complex if given else float)
        np.add.at(x, i, v)
        out = np.asarray(work(x, {k: t[k][0].as_py() for k in keys}) if length else work(x))
        cols = {k: pa.array([t[k][0].as_py()] * len(out), t[k].type) for k in keys}
        value = pa.StructArray.from_arrays([pa.array(out.real.astype(float)), pa.array(out.imag.astype(float))], ["re", "im"]) if as_complex else pa.array(out.astype(float))
        return pa.table(cols | {"i": pa.array(np.arange(len(out))), "v": value})

    kind = "struct<re: double, im: double>" if as_complex else "double"
    schema = ", ".join([*(f"{x.name} {x.dataType.simpleString()}" for x in fields), "i long", f"v {kind}"])
    return Field(f.df.groupBy(*keys).applyInArrow(group, schema), length or n, f.keys)


def halves(n: int) -> tuple[int, int]:
    """Two factors of n, as near to its root as they can be, the smaller first."""
    a = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return a, n // a


def transformed(f: Field, n: int, backward: bool) -> Field:
    """The discrete Fourier transform, not normalised, of each vector of length n.

    A vector of at most MOST_AT_ONCE elements with a key is one group's. Others go in two steps: with n = a b,
    the b vectors of every b-th element are transformed, turned, and the a vectors across them transformed. So
    no task holds more than the larger factor, and a length whose factors are too unequal is lengthened first
    (Bluestein's chirp, a convolution of a power of two's length)."""
    sign = 1 if backward else -1
    whole = (lambda x: np.fft.ifft(x) * len(x)) if backward else np.fft.fft
    if n <= MOST_AT_ONCE and f.keys:
        return per_vector(f, n, whole, True)
    a, b = halves(n)
    if b > MOST_AT_ONCE and b > 4 * a * a:
        return _chirped(f, n, sign)
    i = F.col("i")
    split_ = f.df.select(*f.keys, F.pmod(i, F.lit(b)).cast("long").alias("_b"), F.floor(i / F.lit(b)).cast("long").alias("i"), "v")

    def turned(x, at):
        return whole(x) * np.exp(sign * 2j * np.pi / n * (at["_b"] * np.arange(a) % n))

    first = per_vector(Field(split_, a, (*f.keys, "_b")), a, turned, True, a)
    across = Field(first.df.select(*f.keys, i.alias("_a"), F.col("_b").alias("i"), "v"), b, (*f.keys, "_a"))
    second = per_vector(across, b, whole, True)
    return Field(second.df.select(*f.keys, (F.col("_a") + i * a).alias("i"), "v"), n, f.keys, dense=False)


def _chirped(f: Field, n: int, sign: int) -> Field:
    """X[k] = w[k] sum_i (x[i] w[i]) conj(w[i - k]), with w[i] = exp(sign pi 1j i² / n); the sum is a convolution."""
    m = 1 << (2 * n - 1).bit_length()
    square = lambda c: (c.cast("decimal(19,0)") * c.cast("decimal(19,0)") % F.lit(2 * n)).cast("double") * F.lit(sign * np.pi / n)
    w = lambda c, s: complex_(F.cos(square(c)), F.lit(float(s)) * F.sin(square(c)))
    i = F.col("i")
    x = Field(f.df.withColumn("v", times(w(i, 1), F.col("v"), True, f.is_complex)), m, f.keys, dense=False)
    reach = f.df.sparkSession.range(-(n - 1), n).select(F.pmod("id", F.lit(m)).alias("i"), w(F.col("id"), -1).alias("v"))
    response = transformed(Field(reach, m, dense=False), m, False).df.select("i", F.col("v").alias("r"))
    y = transformed(x, m, False)
    y = replace(y, df=y.df.join(response, "i").withColumn("v", times(F.col("r"), F.col("v"), True, True)).drop("r"))
    z = transformed(y, m, True).df.where(i < n)
    out = times(w(i, 1), F.col("v"), True, True)
    return Field(z.withColumn("v", complex_(out["re"] / m, out["im"] / m)), n, f.keys, dense=False)


class FFTOperator(Operator):
    """The forward transform, not normalised; on fields the values are complex."""

    backward = False

    def __init__(self, n: int):
        super().__init__(shapein=n, shapeout=n, linear=True, square=True, real=False, name="FFT")

    def on_array(self, x):
        return np.fft.fft(x)

    def conjugate_(self):
        return InverseFFT(self.shapein)

    def transpose_(self):
        return self

    @property
    def H(self):
        return InverseFFT(self.shapein)

    def inverse_(self):
        from opweave.operators.diagonal import HomothetyOperator

        return compose(HomothetyOperator(1 / self.shapein), InverseFFT(self.shapein))

    def takes_rows(self, n):
        return n == self.shapein

    def on_field(self, f):
        return transformed(f, self.shapein, self.backward)


class InverseFFT(FFTOperator):
    """The backward transform, not normalised either: backward(forward(x)) = n x."""

    backward = True

    def __init__(self, n: int):
        super().__init__(n)
        self.name = "FFT.H"

    def on_array(self, x):
        return np.fft.ifft(x) * self.shapein

    def conjugate_(self):
        return FFTOperator(self.shapein)

    @property
    def H(self):
        return FFTOperator(self.shapein)

    def inverse_(self):
        from opweave.operators.diagonal import HomothetyOperator

        return compose(HomothetyOperator(1 / self.shapein), FFTOperator(self.shapein))


class ConvolutionNdOperator(MatrixOperator):
    """Circular, of arrays of one shape, held as vectors of their elements in C order; the kernel has as many
    axes, none longer than the array's, and its origin is the index (k - 1) // 2 on each."""

    def __init__(self, kernel, shape: tuple[int, ...]):
        kernel = np.asarray(kernel)
        if kernel.ndim != len(shape) or any(k > n for k, n in zip(kernel.shape, shape)):
            raise ValueError("the kernel has the array's axes, none of them longer")
        n = int(np.prod(shape))
        super().__init__(n, n, not np.iscomplexobj(kernel), square=True, name="ConvolutionNd")
        self.kernel, self.array_shape = kernel, tuple(shape)

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets on each axis and weights of the kernel's elements that aren't zero."""
        at = np.argwhere(self.kernel != 0)
        return at - [(k - 1) // 2 for k in self.kernel.shape], self.kernel[tuple(at.T)]

    def response(self) -> np.ndarray:
        offsets, weights = self.moves()
        out = np.zeros(self.array_shape, np.result_type(self.kernel, float))
        np.add.at(out, tuple((offsets % self.array_shape).T), weights)
        return out

    def entries(self):
        offsets, weights = self.moves()
        j = np.arange(self.shapein)
        to = (np.array(np.unravel_index(j, self.array_shape)).T[:, None] + offsets) % self.array_shape
        i = np.ravel_multi_index(tuple(np.moveaxis(to, -1, 0)), self.array_shape)
        return i.ravel(), np.repeat(j, len(weights)), np.tile(weights, len(j))

    def on_array(self, x):
        x = np.asarray(x)
        axes = tuple(range(-len(self.array_shape), 0))
        y = np.fft.fftn(x.reshape(*x.shape[:-1], *self.array_shape), axes=axes) * np.fft.fftn(self.response())
        y = np.fft.ifftn(y, axes=axes).reshape(x.shape)
        return y.real if self.real and not np.iscomplexobj(x) else y

    def takes_rows(self, n):
        return n == self.shapein

    def on_field(self, f):
        offsets, weights = self.moves()
        if len(weights) > MOST_TAPS and f.keys:
            return per_vector(f, self.shapein, self.on_array, not self.real)
        wc, vc = not self.real, f.is_complex
        rank = range(len(self.array_shape))
        names = [f"o{k}" for k in rank]
        moves = F.array(*[F.struct(*[F.lit(int(v)).alias(c) for c, v in zip(names, o)], literal(w, wc).alias("w")) for o, w in zip(offsets, weights)])
        x = f.df.select(*f.keys, "i", "v", F.explode(moves).alias("m"))
        i, below = F.lit(0).cast("long"), self.shapein
        for k, n in enumerate(self.array_shape):
            below //= n
            i = i + F.pmod(F.floor(F.col("i") / F.lit(below)) + F.col(f"m.o{k}"), F.lit(n)) * F.lit(below)
        out = x.groupBy(*f.keys, i.cast("long").alias("i")).agg(total(times(F.col("m.w"), F.col("v"), wc, vc), wc or vc).alias("v"))
        return Field(out, self.shapein, f.keys, f.dense)

    def conjugate_(self):
        return self if self.real else ConvolutionNdOperator(self.kernel.conj(), self.array_shape)

    def transpose_(self):
        back = np.roll(np.flip(self.response()), tuple((n + 1) // 2 for n in self.array_shape), tuple(range(len(self.array_shape))))
        return ConvolutionNdOperator(back, self.array_shape)


class FFTNdOperator(Operator):
    """The forward transform, not normalised, of arrays of one shape, held as vectors in C order; ``H`` is the
    backward one, so that H(forward(x)) = n x."""

    def __init__(self, shape: tuple[int, ...], backward: bool = False):
        n = int(np.prod(shape))
        super().__init__(shapein=n, shapeout=n, linear=True, square=True, real=False, name="FFTNd.H" if backward else "FFTNd")
        self.array_shape, self.backward = tuple(shape), backward

    def on_array(self, x):
        x = np.asarray(x)
        y, axes = x.reshape(*x.shape[:-1], *self.array_shape), tuple(range(-len(self.array_shape), 0))
        return (np.fft.ifftn(y, axes=axes) * self.shapein if self.backward else np.fft.fftn(y, axes=axes)).reshape(x.shape)

    def takes_rows(self, n):
        return n == self.shapein

    def on_field(self, f):
        """One axis after the other: the index without the axis is a key of its vectors."""
        f = f.lifted()
        for axis, n in enumerate(self.array_shape):
            inner = int(np.prod(self.array_shape[axis + 1 :]))
            i, r = F.col("i"), F.col("_rest")
            rest = F.floor(i / F.lit(n * inner)) * inner + F.pmod(i, F.lit(inner))
            x = f.df.select(*f.keys, rest.cast("long").alias("_rest"), F.pmod(F.floor(i / F.lit(inner)), F.lit(n)).cast("long").alias("i"), "v")
            y = transformed(Field(x, n, (*f.keys, "_rest")), n, self.backward).df
            back = (F.floor(r / F.lit(inner)) * n + i) * inner + F.pmod(r, F.lit(inner))
            f = Field(y.select(*f.keys, back.cast("long").alias("i"), "v"), self.shapein, f.keys, dense=False)
        return f

    def conjugate_(self):
        return FFTNdOperator(self.array_shape, not self.backward)

    def transpose_(self):
        return self

    @property
    def H(self):
        return self.conjugate_()

    def inverse_(self):
        from opweave.operators.diagonal import HomothetyOperator

        return compose(HomothetyOperator(1 / self.shapein), self.conjugate_())


class WaveletOperator(Operator):
    """Periodic multilevel transform: coefficients [approximation, coarsest detail, ..., finest detail]; orthogonal.
    A level is a stencil of stride 2 on what the level before left; its matrix is never made."""

    def __init__(self, wavelet: str, n: int, level: int = 1, back: bool = False):
        if n % (1 << level):
            raise ValueError("the length must be a multiple of 2**level")
        super().__init__(shapein=n, shapeout=n, linear=True, orthogonal=True, name=f"Wavelet[{wavelet}]{'.T' if back else ''}")
        self.wavelet, self.level, self.back = wavelet, level, back
        self.low = scaling_filter(wavelet)
        self.high = self.low[::-1] * (-1.0) ** np.arange(len(self.low))

    def on_array(self, x):
        out = np.array(x, np.result_type(x, float))
        sizes = [self.shapein >> k for k in range(self.level)]
        for size in reversed(sizes) if self.back else sizes:
            half = size // 2
            at = (2 * np.arange(half)[:, None] + np.arange(len(self.low))) % size
            if self.back:
                a, d = out[..., :half].copy(), out[..., half:size].copy()
                new = np.zeros_like(out[..., :size])
                for t in range(len(self.low)):
                    np.add.at(np.moveaxis(new, -1, 0), at[:, t], np.moveaxis(a * self.low[t] + d * self.high[t], -1, 0))
                out[..., :size] = new
            else:
                y = out[..., :size][..., at]
                out[..., :size] = np.concatenate([y @ self.low, y @ self.high], axis=-1)
        return out

    def _taps(self):
        return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for t, (a, b) in enumerate(zip(self.low, self.high))])

    def takes_rows(self, n):
        return n == self.shapein

    def on_field(self, f):
        return self._up(f) if self.back else self._down(f)

    def _down(self, f: Field) -> Field:
        c, i = f.is_complex, F.col("i")
        now, done = f.df.select(*f.keys, "i", "v"), None
        for size in (self.shapein >> k for k in range(self.level)):
            x = now.select(*f.keys, "i", "v", F.explode(self._taps()).alias("m")).where(F.pmod(i - F.col("m.t"), F.lit(2)) == 0)
            to = F.floor(F.pmod(i - F.col("m.t"), F.lit(size)) / 2).cast("long")
            sums = [total(times(F.col(f"m.{k}"), F.col("v"), False, c), c).alias(k) for k in ("low", "high")]
            both = x.groupBy(*f.keys, to.alias("i")).agg(*sums)
            detail = both.select(*f.keys, (i + size // 2).alias("i"), F.col("high").alias("v"))
            done = detail if done is None else done.unionByName(detail)
            now = both.select(*f.keys, "i", F.col("low").alias("v"))
        return Field(now if done is None else now.unionByName(done), self.shapein, f.keys, dense=False)

    def _up(self, f: Field) -> Field:
        c, i = f.is_complex, F.col("i")
        rows = f.df.select(*f.keys, "i", "v")
        now = rows.where(i < self.shapein >> self.level)
        for size in (self.shapein >> k for k in reversed(range(self.level))):
            half = size // 2
            both = now.unionByName(rows.where((i >= half) & (i < size))).withColumn("m", F.explode(self._taps()))
            w = F.when(i < half, F.col("m.low")).otherwise(F.col("m.high"))
            to = F.pmod(2 * F.pmod(i, F.lit(half)) + F.col("m.t"), F.lit(size)).cast("long")
            now = both.select(*f.keys, to.alias("to"), times(w, F.col("v"), False, c).alias("v")).groupBy(*f.keys, F.col("to").alias("i")).agg(total(F.col("v"), c).alias("v"))
        return Field(now, self.shapein, f.keys, dense=False)

    def transpose_(self):
        return WaveletOperator(self.wavelet, self.shapein, self.level, not self.back)

    def inverse_(self):
        return self.transpose_()


class Wavelet2dOperator(Operator):
    """The transform along both axes: of an array's last two, or of a field whose index is row * columns + column."""

    flat = False  # arrays come with two axes

    def __init__(self, wavelet: str, shape: tuple[int, int], level: int = 1):
        super().__init__(linear=True, orthogonal=True, name=f"Wavelet2d[{wavelet}]")
        self.wavelet, self.level = wavelet, level
        self.array_shape, self.rows, self.cols = shape, WaveletOperator(wavelet, shape[0], level), WaveletOperator(wavelet, shape[1], level)

    def on_array(self, x):
        y = self.cols.on_array(x)
        return np.swapaxes(self.rows.on_array(np.swapaxes(y, -1, -2)), -1, -2)

    def takes_rows(self, n):
        return n == int(np.prod(self.array_shape))

    def on_rows(self, x):
        return self.on_array(x.reshape(-1, *self.array_shape)).reshape(len(x), -1)

    def on_field(self, f):
        m, n = self.array_shape
        row = F.floor(F.col("i") / F.lit(n)).cast("long")
        x = f.df.select(*f.keys, row.alias("_row"), F.pmod("i", F.lit(n)).cast("long").alias("i"), "v")
        y = self.cols.on_field(Field(x, n, (*f.keys, "_row"), f.dense)).df
        y = y.select(*f.keys, F.col("i").alias("_col"), F.col("_row").alias("i"), "v")
        z = self.rows.on_field(Field(y, m, (*f.keys, "_col"), f.dense)).df
        return Field(z.select(*f.keys, (F.col("i") * n + F.col("_col")).alias("i"), "v"), m * n, f.keys, dense=False)

    def transpose_(self):
        out = Wavelet2dOperator(self.wavelet, self.array_shape, self.level)
        out.rows, out.cols, out.name = self.rows.T, self.cols.T, f"{self.name}.T"
        return out
