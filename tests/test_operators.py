from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from opweave import I, O, X
from opweave.expr import Addition, Composition, DeletedOperator, Field, Group, Operator, Variable, _batches, asoperator, asoperator1d, multiply
from opweave.operators.axes import AxisOperator
from opweave.operators.block import BlockColumnOperator, BlockDiagonalOperator, BlockRowOperator, BlockSliceOperator, proxy_group, split
from opweave.operators.coords import CONVENTIONS, Cartesian2SphericalOperator, Spherical2CartesianOperator
from opweave.operators.dense import DenseBlockDiagonalOperator, DenseOperator, Rotation2dOperator, Rotation3dOperator, dense
from opweave.operators.diagonal import ConstantOperator, DiagonalOperator, HomothetyOperator, IdentityOperator, MaskOperator, PackOperator, UnpackOperator, ZeroOperator
from opweave.operators.elementwise import ClipOperator, HardThresholdingOperator, NumexprOperator, PowerOperator, ReciprocalOperator, RoundOperator, SoftThresholdingOperator, SqrtOperator, SquareOperator, To1dOperator, ToNdOperator
from opweave.operators.reduce import MaxOperator, MinMaxOperator, MinOperator, ProductOperator, ReductionOperator
from opweave.operators.sparse import BandOperator, DifferenceOperator, EigendecompositionOperator, IntegrationTrapezeOperator, LowerTriangularOperator, SparseOperator, StencilOperator, SumOperator, SymmetricBandOperator, SymmetricBandToeplitzOperator, TridiagonalOperator
from opweave.operators.transform import ConvolutionNdOperator, ConvolutionOperator, FFTNdOperator, FFTOperator, InverseFFT, Wavelet2dOperator, WaveletOperator, scaling_filter
from opweave.plans import rows
from opweave.rules import rule_manager
from opweave.solvers.cg import LanczosAlgorithm, pcg
from opweave.solvers.core import IterativeAlgorithm, error_within, steps_done
from opweave.solvers.criteria import Huber, Norm2, acg, bfgs, conjugate_gradient_field, double_loop, double_loop_field, hacg, minimise, quadratic_criterion

MATRICES = [
    SparseOperator([[0, 7, 0, 0], [2, 0, 0, -1], [0, 0, 0, 0], [0, 3, 5, 0], [8, 0, 0, 4]]),
    DenseOperator(np.arange(12).reshape(3, 4)),
    DifferenceOperator(5),
    TridiagonalOperator([1, 2, 3], [4, 5], [6, 7]),
    BandOperator(np.arange(12).reshape(3, 4), 1, 1),
    LowerTriangularOperator(np.arange(8).reshape(2, 4)),
    SymmetricBandOperator([[4, 4, 4, 4], [1, 1, 1, 0]]),
    SymmetricBandToeplitzOperator(5, [2, 1]),
    ConvolutionOperator([1, 2, 0.5], 6),
    WaveletOperator("db2", 8, 2),
    WaveletOperator("db4", 16),
    ConvolutionNdOperator([[1, 2, 0.5]], (3, 4)),
    ConvolutionNdOperator(np.arange(1.0, 13).reshape(2, 2, 3), (2, 3, 4)),
    IntegrationTrapezeOperator([0.5, 1, 2, 4]),
    SumOperator(4),
    BlockDiagonalOperator([DenseOperator(np.ones((2, 3))), IdentityOperator(2)]),
    BlockColumnOperator([IdentityOperator(3), DenseOperator(np.arange(6).reshape(2, 3))]),
    BlockRowOperator([IdentityOperator(2), DenseOperator(np.arange(6).reshape(2, 3))]),
    UnpackOperator([True, False, True]),
    DiagonalOperator([1.0, 2, 3]),
]


def to_field(spark, x):
    return Field(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double"), len(x))


def to_array(f, n):
    out = np.zeros(n)
    for i, v in f.df.select("i", "v").collect():
        out[i] += v
    return out


@pytest.mark.parametrize("op", MATRICES, ids=repr)
def test_transposes_and_fields(spark, op):
    dense = op.todense()
    np.testing.assert_allclose(op.T.todense(op.shapeout), dense.T, atol=1e-12)
    x = np.arange(1.0, op.shapein + 1)
    np.testing.assert_allclose(to_array(op(to_field(spark, x)), op.shapeout), dense @ x, atol=1e-9)


@pytest.mark.parametrize("op", [ClipOperator(-1, 2), HardThresholdingOperator(0.2), SoftThresholdingOperator(0.2), PowerOperator(3), SquareOperator(), ReciprocalOperator(), MaskOperator([True, False] * 4), NumexprOperator("2 * input + 1"), asoperator(np.exp) + 1.0, BlockSliceOperator([HomothetyOperator(3)], [slice(1, 7, 2)]), *(RoundOperator(m) for m in RoundOperator.METHODS)], ids=repr)
def test_elementwise(spark, op):
    x = np.array([-3.5, -2.5, -0.2, 0.1, 0.5, 1.5, 2.4, 3.0])
    np.testing.assert_allclose(to_array(op(to_field(spark, x)), 8), op(x), atol=1e-12)


def test_rounding():
    x = np.array([-7.5, -1.75, -1.25, -0.5, 0.25, 2.5, 6.0, 9.9])
    assert RoundOperator("rhtmi")(x).tolist() == [-8, -2, -1, -1, 0, 2, 6, 10]
    assert RoundOperator("rhtpi")(x).tolist() == [-7, -2, -1, 0, 0, 3, 6, 10]
    assert RoundOperator("rhte")(x).tolist() == [-8, -2, -1, 0, 0, 2, 6, 10]
    with pytest.raises(ValueError):
        RoundOperator("rhs")


def test_morphing():
    assert isinstance(DiagonalOperator([0, 0]), ZeroOperator)
    assert isinstance(DiagonalOperator([1, 1]), IdentityOperator)
    assert isinstance(DiagonalOperator([3, 3]), HomothetyOperator)
    assert isinstance(DiagonalOperator([0, 1]), MaskOperator)
    assert DiagonalOperator([1, -1]).involutary
    assert isinstance(PackOperator([True, True]), IdentityOperator)
    assert isinstance(HardThresholdingOperator(0), IdentityOperator)


def test_rules():
    two = 2 * IdentityOperator() + DiagonalOperator([0, 1, 2])
    assert two.data.tolist() == [2, 3, 4]
    assert (HomothetyOperator(2) * HomothetyOperator(3)).value == 6
    p = PackOperator([True, False, True])
    assert isinstance(p * p.T, IdentityOperator) and isinstance(p.T * p, MaskOperator)
    w = WaveletOperator("haar", 4)
    assert isinstance(w.T * w, IdentityOperator)
    f = FFTOperator(4)
    assert (f.H * f).value == 4
    assert PowerOperator(2)(PowerOperator(3)).n == 6
    assert isinstance(SqrtOperator()(SquareOperator()), Composition)  # |x|, not x
    assert HardThresholdingOperator(1)(HardThresholdingOperator(2)).a == 2
    c = ConvolutionOperator([1, 2, 3], 6)
    assert isinstance(c * c, ConvolutionOperator) and np.allclose((c * c).todense(), c.matrix() @ c.matrix())
    with rule_manager(none=True):
        off = HomothetyOperator(2) * DenseOperator(np.eye(2)) + IdentityOperator(2)
        assert isinstance(off, Addition)
    assert np.allclose(off.todense(2), (HomothetyOperator(2) * DenseOperator(np.eye(2)) + IdentityOperator(2)).todense(2))
    row, col = BlockRowOperator([IdentityOperator(2), 2 * IdentityOperator(2)]), BlockColumnOperator([IdentityOperator(2), 2 * IdentityOperator(2)], n=2)
    assert (row * col).value == 5
    o = Operator(lambda x: x, linear=True)
    o.set_rule((Operator, "left"), lambda a, b: [IdentityOperator()])
    assert isinstance(o * asoperator(2.0), IdentityOperator)


def test_algebra_and_associates():
    d = DenseOperator([[1, 2], [3, 4]])
    assert np.allclose((d**2).todense(), [[7, 10], [15, 22]])
    assert np.allclose((d**-1).todense(), np.linalg.inv(d.data))
    assert np.allclose(d * np.array([1, 1]), [3, 7])
    c = DenseOperator(np.array([[1, 1j], [2, 2]]))
    assert np.allclose(c.H.todense(), c.data.conj().T) and np.allclose(c.C.todense(), c.data.conj())
    assert np.allclose((asoperator(np.sin) * asoperator(np.cos))(np.array([1.0])), np.sin(1) * np.cos(1))
    assert np.allclose((asoperator(np.square) / 2.0)(np.array([4.0])), 8)
    assert (5.0 + asoperator(np.square))(np.array([2.0])) == 9
    m = Operator(lambda x: x, linear=True)
    with pytest.raises(NotImplementedError):
        m.T(np.ones(2))
    assert m.T.T is m
    with pytest.raises(ValueError):
        d(np.ones(3))
    with pytest.raises(ValueError):
        DenseOperator(np.ones((2, 3))) * DenseOperator(np.ones((2, 3)))
    with pytest.raises(ValueError):
        NumexprOperator("__import__")


def test_coordinates_and_rotations():
    v = np.array([[0.6, 0, 0.8], [0, -0.6, 0.8]])
    for c in CONVENTIONS:
        for deg in (False, True):
            a = Cartesian2SphericalOperator(c, deg)
            assert np.allclose(a.I(a(v)), v)
            assert isinstance(a.I(a), IdentityOperator)
    r = {k: Rotation3dOperator(k, t).data for k, t in (("X", 0.1), ("Y", 0.2), ("Z", 0.3))}
    assert np.allclose(Rotation3dOperator("XY'Z''", 0.1, 0.2, 0.3).data, r["X"] @ r["Y"] @ r["Z"])
    assert np.allclose(Rotation3dOperator("XYZ", 0.1, 0.2, 0.3).data, r["Z"] @ r["Y"] @ r["X"])
    assert np.allclose(Rotation2dOperator(90, degrees=True)(np.array([1, 0])), [0, 1])
    assert isinstance(Spherical2CartesianOperator()(Cartesian2SphericalOperator()), IdentityOperator)
    t = ToNdOperator((3, 4), "F")
    assert np.array_equal(t.I(t(np.arange(12))), np.arange(12))
    assert To1dOperator((3, 4))(np.array([2, 1])) == 9


@pytest.mark.parametrize("n", range(1, 21))
def test_scaling_filters(n):
    """Orthonormal to its even shifts, and with n vanishing moments of the wavelet."""
    h = scaling_filter(f"db{n}")
    assert len(h) == 2 * n
    tol = 1e-9 if n <= 10 else 1e-4
    for k in range(n):
        assert abs(h[2 * k :] @ h[: len(h) - 2 * k] - (k == 0)) < tol
    if n <= 6:
        high = h[::-1] * (-1.0) ** np.arange(2 * n)
        assert all(abs((np.arange(2 * n, dtype=float) ** k) @ high) < 1e-4 for k in range(n))


def test_scaling_filter_names():
    assert np.allclose(scaling_filter("haar"), np.sqrt([0.5, 0.5]))
    assert np.allclose(scaling_filter("db2") * 4 * np.sqrt(2), [1 + np.sqrt(3), 3 + np.sqrt(3), 3 - np.sqrt(3), 1 - np.sqrt(3)])
    for name in ("db0", "db21", "sym4", "", "db"):
        with pytest.raises(ValueError):
            scaling_filter(name)


@pytest.mark.parametrize("shape", [(6,), (4, 5), (2, 3, 4)])
def test_transforms_of_arrays(shape):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(2, *shape))
    f, n = FFTNdOperator(shape), int(np.prod(shape))
    flat = x.reshape(2, n)
    assert np.allclose(f(flat).reshape(x.shape), np.fft.fftn(x, axes=range(1, x.ndim)))
    assert np.allclose(f.H(f(flat)), n * flat) and np.allclose(f.I(f(flat)), flat)
    delta = np.zeros(shape)
    delta[tuple(k // 2 for k in shape)] = 1
    kernel = rnd.normal(size=[min(3, k) for k in shape])
    got = ConvolutionNdOperator(kernel, shape)(delta.ravel()).reshape(shape)
    want = np.zeros(shape)
    for at in np.ndindex(kernel.shape):
        want[tuple((k // 2 + i - (m - 1) // 2) % k for k, i, m in zip(shape, at, kernel.shape))] += kernel[at]
    assert np.allclose(got, want)
    z = ConvolutionNdOperator(kernel + 1j, shape)
    assert np.allclose(z.H.todense(), z.matrix().conj().T)
    with pytest.raises(ValueError):
        ConvolutionNdOperator(np.ones([k + 1 for k in shape]), shape)


def test_wavelet_2d(spark):
    x = np.random.default_rng(3).normal(size=(4, 8))
    w = Wavelet2dOperator("db2", (4, 8))
    y = w(x)
    assert np.allclose(w.T(y), x) and np.isclose((y**2).sum(), (x**2).sum())
    f = w(to_field(spark, x.ravel()))
    np.testing.assert_allclose(to_array(f, 32), y.ravel(), atol=1e-9)
    np.testing.assert_allclose(to_array(w.T(f), 32), x.ravel(), atol=1e-9)


def test_keyed_fields(spark):
    df = spark.createDataFrame([(k, i, float(k + i)) for k in range(3) for i in range(8)], "k long, i long, v double")
    f = Field(df, 8, ("k",))
    x = np.array([[k + i for i in range(8)] for k in range(3)], float)
    got = {(k, i): complex(a, b) for k, i, a, b in FFTOperator(8)(f).df.select("k", "i", "v.re", "v.im").collect()}
    assert np.allclose([[got[k, i] for i in range(8)] for k in range(3)], np.fft.fft(x))
    blocks = DenseBlockDiagonalOperator(np.arange(16).reshape(2, 1, 8))
    got = {(k, b): v for k, b, v in blocks(f).df.select("k", "block", "v").collect()}
    assert got[1, 1] == x[1] @ np.arange(8, 16)
    assert {r["k"]: r["v"] for r in ProductOperator()(f).df.collect()} == {k: float(np.prod(x[k])) for k in range(3)}
    assert sorted((r["k"], r["i"], r["v"]) for r in MinMaxOperator()(f).df.collect())[:2] == [(0, 0, 0.0), (0, 1, 7.0)]
    nan = Field(spark.createDataFrame([(0, 1.0), (1, float("nan"))], "i long, v double"), 2)
    assert np.isnan(MinOperator()(nan).df.first()["v"])
    assert np.isnan([r["v"] for r in ClipOperator(0, 1)(nan).df.orderBy("i").collect()][1])


def test_pack_field_and_large_diagonal(spark):
    mask = np.arange(10) % 3 == 0
    y = PackOperator(mask)(to_field(spark, np.arange(10)))
    assert to_array(y, 4).tolist() == [0, 3, 6, 9]
    w = spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 2.0).alias("w"))
    assert to_array(DiagonalOperator(w)(to_field(spark, np.ones(10))), 10).tolist() == [2.0 * i for i in range(10)]
    assert to_array((SumOperator(3).T)(to_field(spark, [2])), 3).tolist() == [2, 2, 2]


def test_solvers(spark):
    a = TridiagonalOperator(np.arange(2, 18) * 2.0, np.ones(15))
    x = np.arange(1.0, 17)
    got = pcg(a, a(x), tol=1e-10)
    assert got["success"] and np.allclose(got["x"], x)
    assert pcg(a, a(x), x0=x)["nit"] == 0
    assert np.allclose(pcg(a, np.zeros(16))["x"], 0)
    y = pcg(a, to_field(spark, a(x)), tol=1e-8)
    assert y["success"] and np.allclose(to_array(y["x"], 16), x, atol=1e-5)
    assert np.allclose(sorted(LanczosAlgorithm(a, v0=1 / x).run().eigenvalues), np.linalg.eigvalsh(a.todense()), atol=1e-4)
    e = EigendecompositionOperator(a)
    assert np.allclose(e.I(a(x)), x) and np.isclose(e.logdet(), np.linalg.slogdet(a.todense())[1])
    with pytest.raises(TypeError):
        pcg(a, x * 1j)
    m = DenseOperator(np.vstack([np.eye(4), np.ones((1, 4))]))
    d = m(np.arange(4.0))
    assert np.allclose(acg(m, d), np.arange(4), atol=1e-4) and np.allclose(hacg(m, d, maxiter=2000), np.arange(4), atol=1e-2)
    assert np.allclose(bfgs(quadratic_criterion(m, d), np.zeros(4)), np.arange(4), atol=1e-5)
    assert np.allclose(double_loop(m, d, IdentityOperator(4), sigma=0.1, tau=1e-3), np.arange(4), atol=0.05)
    assert Norm2()([1, 2]) == 5 and Huber(1)([0.5, 3]) == 0.25 + 5


def test_recursion():
    class Padovan(IterativeAlgorithm):
        """Three steps back: x = x_old2 + x_old3."""

        def iteration(self):
            self.x = self.x_old2 + self.x_old3

    p = Padovan(limit=steps_done(12), x_old3=1, x_old2=1, x_old=1)
    assert [p.next().x for _ in range(7)] == [2, 2, 3, 4, 5, 7, 9]
    assert p.cont(2) == 16 and not p.ended
    p.cont()
    assert p.ended and not p.success and p.niterations == 12 and "12" in p.message
    with pytest.raises(RuntimeError):
        p.run()
    assert p.restart(1) == 2
    either = error_within(1e-3) | steps_done(4)
    assert "0.001" in repr(either) and "4" in repr(either)


def test_proxies_and_split():
    calls = []
    ops = proxy_group(3, lambda i: calls.append(i) or DenseOperator(np.eye(2) * (i + 1)))
    for o in ops:
        (o.T * o)(np.ones(2))
    assert calls == [0, 1, 2]
    assert [s.stop - s.start for s in split(7, 3)] == [3, 2, 2]
    assert ConstantOperator([2, 2]).data.ndim == 0


def test_double_loop_beyond_30_unknowns():
    """Against the same loops with dense solves and exact variances."""
    rng = np.random.default_rng(3)
    a, n = rng.normal(size=(40, 50)), 50
    d = a @ np.where(np.arange(n) % 7 == 0, 3.0, 0.0)
    x, z = np.zeros(n), np.full(n, 0.05)
    for _ in range(5):
        for _ in range(500):
            h = a.T @ a + np.diag(1 / np.sqrt(x**2 + z))
            x = np.linalg.solve(h, a.T @ d)
        z = np.diag(np.linalg.inv(h))
    assert np.allclose(double_loop(DenseOperator(a), d, IdentityOperator(n)), x, atol=1e-3)


def complex_array(f, n):
    out = np.zeros(n, complex)
    for i, re, im in f.df.select("i", "v.re", "v.im").collect():
        out[i] += complex(re, im)
    return out


COMPLEX = [
    DenseOperator(np.array([[1, 1j, 0], [2, 2 - 1j, 3]])),
    SparseOperator(np.array([[0, 1j, 0], [2, 0, 3 - 2j]])),
    TridiagonalOperator([1, 2j, 3], [4j, 5]),
    BandOperator(np.arange(9).reshape(3, 3) * (1 + 1j), 1, 1),
    HomothetyOperator(2 - 1j),
    DiagonalOperator(np.array([1, 1j, 2 - 1j])),
    DiagonalOperator(np.array([1, 1j, 2 - 1j])) + IdentityOperator(3),
    multiply(DiagonalOperator(np.array([1, 1j, 2 - 1j])), IdentityOperator(3)),
    ConvolutionOperator([1j, 2, 1 - 1j], 3),
    ConvolutionNdOperator(np.array([[1j, 2, 1 - 1j]]), (1, 3)),
    BlockDiagonalOperator([HomothetyOperator(1j, 2), IdentityOperator(1)]),
    BlockColumnOperator([HomothetyOperator(1j), IdentityOperator()], n=3),
    BlockSliceOperator([HomothetyOperator(1j)], [slice(-2, None)]),
    FFTOperator(3),
    FFTNdOperator((3, 1), backward=True),
    WaveletOperator("haar", 2) * DenseOperator(np.array([[1, 1j, 0], [2, 2 - 1j, 3]])),
]


@pytest.mark.parametrize("op", COMPLEX, ids=repr)
def test_complex_fields(spark, op):
    """Real and complex vectors through complex operators, as on arrays; and the adjoint."""
    x = np.array([1.0, -2, 3])
    n = op.shapeout or len(op(x))
    np.testing.assert_allclose(complex_array(op(to_field(spark, x)).lifted(), n), op(x), atol=1e-9)
    z = x + 1j * np.array([0.5, 0, -1])
    f = Field(spark.createDataFrame([(i, (v.real, v.imag)) for i, v in enumerate(z.tolist())], "i long, v struct<re: double, im: double>"), 3)
    np.testing.assert_allclose(complex_array(op(f), n), op(z), atol=1e-9)
    if op.linear and op.shapein is not None:
        np.testing.assert_allclose(op.H.todense(n), op.todense(3).conj().T, atol=1e-9)


def test_complex_fields_are_refused(spark):
    f = Field(spark.createDataFrame([(0, (1.0, 2.0))], "i long, v struct<re: double, im: double>"), 1)
    for op in (ClipOperator(0, 1), MinOperator(), SqrtOperator()):
        with pytest.raises(TypeError):
            op(f)


@pytest.mark.parametrize("n", [12, 97, 64])
def test_long_transforms(spark, monkeypatch, n):
    """In two steps, and by a chirp where the length's factors are too unequal."""
    monkeypatch.setattr("opweave.operators.transform.MOST_AT_ONCE", 8)
    x = np.random.default_rng(n).normal(size=n)
    y = FFTOperator(n)(to_field(spark, x))
    np.testing.assert_allclose(complex_array(y, n), np.fft.fft(x), atol=1e-8)
    np.testing.assert_allclose(complex_array(InverseFFT(n)(y), n), n * x, atol=1e-7)


@pytest.mark.parametrize("taps", [64, 65])
def test_convolution_of_repeated_rows(spark, taps):
    """Rows of one index count as their sum, however many taps there are."""
    f = Field(spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 5, 1.0)], "k string, i long, v double"), 80, ("k",))
    got = to_array(ConvolutionOperator(np.arange(1.0, taps + 1), 80)(f), 80)
    x = np.zeros(80)
    x[0], x[5] = 3, 1
    np.testing.assert_allclose(got, ConvolutionOperator(np.arange(1.0, taps + 1), 80)(x), atol=1e-9)


def test_slices(spark):
    x = np.arange(1.0, 7)
    for s in (slice(-2, None), slice(None, None, -2), slice(5, 0, -3), slice(1, -1, 2), slice(4, 2), slice(0, 100)):
        op = BlockSliceOperator([HomothetyOperator(3.0)], [s])
        np.testing.assert_allclose(to_array(op(to_field(spark, x)), 6), op(x))
    unknown = Field(to_field(spark, x).df)
    with pytest.raises(ValueError):
        BlockSliceOperator([HomothetyOperator(3.0)], [slice(-2, None)])(unknown)


AXES = [
    DifferenceOperator(shape=(3, 4), axis=0),
    SumOperator(shape=(3, 4), axis=-1),
    SumOperator(shape=(3, 4)),
    WaveletOperator("db2", 4),
    AxisOperator(ConvolutionOperator([1, 2.0], 3), (3, 4), 0),
    AxisOperator(FFTOperator(2), (3, 2, 2), 1).H * AxisOperator(FFTOperator(2), (3, 2, 2), 1),
]


@pytest.mark.parametrize("op", [o for o in AXES if o.real], ids=repr)
def test_axes(spark, op):
    x = np.random.default_rng(1).normal(size=op.shapein)
    np.testing.assert_allclose(to_array(op(to_field(spark, x)), op.shapeout), op(x), atol=1e-9)
    np.testing.assert_allclose(op.T.todense(op.shapeout), op.todense().T, atol=1e-12)


def test_reductions_along_axes(spark):
    x = np.random.default_rng(2).normal(size=(3, 4))
    for op, want in ((MaxOperator(shape=(3, 4), axis=0), x.max(0)), (ProductOperator(shape=(3, 4), axis=1), x.prod(1)), (MinOperator(shape=(3, 4)), [x.min()]), (ReductionOperator(np.ptp, shape=(3, 4), axis=0), np.ptp(x, axis=0))):
        assert np.allclose(op(x.ravel()), want) and np.allclose(to_array(op(to_field(spark, x.ravel())), len(want)), want)
    nan = np.where(x < 0, np.nan, x)
    f = Field(spark.createDataFrame([(i, float(v)) for i, v in enumerate(nan.ravel())], "i long, v double"), 12)
    for op, want in ((ReductionOperator(np.add, skipna=True), np.nansum(nan)), (MaxOperator(skipna=True), np.nanmax(nan)), (ProductOperator(skipna=True), np.nanprod(nan))):
        assert np.isclose(op(nan.ravel())[0], want) and np.isclose(to_array(op(f), 1)[0], want)
    assert np.isnan(MaxOperator()(nan.ravel())[0])
    assert ReductionOperator(np.add, dtype="int64")(np.array([1.0, 2])).dtype == np.int64
    with pytest.raises(TypeError):
        ReductionOperator(np.sin)


def test_broadcasts(spark):
    x = np.arange(6.0)
    for op, want in ((DiagonalOperator([1.0, 2, 3], broadcast="leftward"), x * [1, 2, 3, 1, 2, 3]), (DiagonalOperator([1.0, 2, 3], broadcast="rightward"), x * [1, 1, 2, 2, 3, 3]), (ConstantOperator([4.0, 5], broadcast="rightward"), [4, 4, 4, 5, 5, 5]), (2.0 * DiagonalOperator([1.0, 2, 3], broadcast="rightward"), x * [2, 2, 4, 4, 6, 6])):
        assert np.allclose(op(x), want) and np.allclose(to_array(op(to_field(spark, x)), 6), want)
    assert np.allclose(PackOperator([True, False], 6, "leftward")(x), [0, 2, 4])
    with pytest.raises(ValueError):
        DiagonalOperator([1.0, 2, 3, 4], broadcast="leftward")(x)
    with pytest.raises(ValueError):
        DiagonalOperator([1.0, 2], broadcast="upward")


def test_new_axes():
    a, b = DenseOperator(np.arange(6.0).reshape(2, 3)), DenseOperator(np.ones((2, 3)))
    x = np.arange(3.0)
    col = BlockColumnOperator([a, b], new_axis="k")
    assert np.allclose(col(x), [a(x), b(x)])
    assert np.allclose(col.T(col(x)), a.T(a(x)) + b.T(b(x)))
    assert np.allclose(BlockDiagonalOperator([a, b], new_axis="k")(np.stack([x, x])), col(x))
    assert np.allclose(BlockRowOperator([a, b], new_axis="k", operation="minimum")(np.stack([x, x])), np.minimum(a(x), b(x)))
    assert MinMaxOperator(new_axis="k")(x).tolist() == [[0], [2]]


def test_dense_axes():
    data = np.arange(24.0).reshape(2, 3, 4)
    x = np.arange(12.0)
    assert np.allclose(dense(data, naxesin=2)(x), np.tensordot(data, x.reshape(3, 4), 2))
    assert np.allclose(dense(data, naxesextra=1)(np.arange(4.0)), data @ np.arange(4.0))
    assert np.allclose(dense(data, naxesextra=1, broadcast="rightward")(np.arange(3.0)), np.einsum("mnb,n->bm", data, np.arange(3.0)))
    assert isinstance(dense(3.0), HomothetyOperator)
    with pytest.raises(ValueError):
        dense(data, naxesin=2, naxesout=2)


def test_coercions_and_leftovers(spark):
    class Coo:
        row, col, data, shape = [0, 1], [1, 0], [2.0, 3], (2, 2)

        def tocoo(self):
            return self

    class Duck:
        shape = (2, 2)

        def matvec(self, x):
            return 2 * x

        rmatvec = matvec

    assert asoperator(Coo())(np.array([1.0, 2])).tolist() == [4, 3]
    assert asoperator(Duck())(np.ones((3, 2))).tolist() == [[2, 2]] * 3 and asoperator(Duck()).T(np.ones(2)).tolist() == [2, 2]
    f = to_field(spark, [3.0, 4])
    assert np.allclose(to_array(asoperator(lambda v: np.hypot(v, 1))(f), 2), np.hypot([3, 4], 1))
    assert to_array(asoperator(lambda v: v * 2 + 1)(f), 2).tolist() == [7, 9]
    assert SquareOperator()(np.array([2.0]), out=np.array([1.0]), operation="subtract").tolist() == [-3]
    assert repr(2 * Variable("y") + X) == "((2 * y) + X)" and repr(X.T) == "X.T"
    assert isinstance(I, IdentityOperator) and isinstance(O, ZeroOperator)
    d = DenseOperator(np.eye(2))
    e = d.copy()
    d.delete()
    assert isinstance(d, DeletedOperator) and e(np.ones(2)).tolist() == [1, 1]
    with pytest.raises(RuntimeError):
        d(np.ones(2))
    w = asoperator1d(Wavelet2dOperator("haar", (2, 2)))
    assert np.allclose(w.T(w(np.arange(4.0))), np.arange(4))
    c = Operator(lambda x: 1j * x, linear=True, real=False)
    assert c.C(np.array([2.0]))[0] == -2j


def test_unpack_by_condition(spark):
    df = spark.createDataFrame([(k, i, float(10 * k + i), (i + k) % 3) for k in range(2) for i in range(5)], "k long, i long, v double, m int")
    packed = PackOperator("m = 0")(Field(df, 5, ("k",)))
    back = UnpackOperator("m = 0", 5, df)(Field(packed.df.select("k", "i", "v"), None, ("k",))).df
    assert sorted(map(tuple, back.select("k", "i", "v").collect())) == sorted((r.k, r.i, r.v) for r in df.where("m = 0").collect())
    with pytest.raises(ValueError):
        UnpackOperator("m = 0")(packed)


def test_minimisers(spark):
    m = DenseOperator(np.vstack([np.diag([1.0, 2, 3, 4]), np.ones((1, 4))]))
    d = m(np.array([1.0, -1, 0.5, 2]))
    c = quadratic_criterion(m, d)
    for method in ("bfgs", "cg", "newton-cg", "powell", "bounded"):
        assert np.allclose(minimise(c, np.zeros(4), method), [1, -1, 0.5, 2], atol=1e-4), method
    low = minimise(c, np.zeros(4), "bounded", low=0.0)
    assert low.min() == 0 and c(low) <= c(np.maximum([1, -1, 0.5, 2], 0)) + 1e-9
    tied = minimise(c, np.zeros(4), "constrained", equal=(lambda x: x[0] - x[1],), tol=1e-6)
    assert abs(tied[0] - tied[1]) < 1e-5
    with pytest.raises(ValueError):
        minimise(c, np.zeros(4), "guess")
    x = conjugate_gradient_field(quadratic_criterion(m, to_field(spark, d)), to_field(spark, np.zeros(4)), tol=1e-9)
    assert np.allclose(to_array(x, 4), [1, -1, 0.5, 2], atol=1e-5)


def test_double_loop_on_fields(spark):
    a = np.random.default_rng(8).normal(size=(6, 4))
    d = a @ np.array([0, 3.0, 0, 1])
    want = double_loop(DenseOperator(a), d, IdentityOperator(4), outer=2, inner=2)
    got = double_loop_field(DenseOperator(a), to_field(spark, d), IdentityOperator(4), 4, outer=2, inner=2)
    assert np.allclose(to_array(got, 4), want, atol=1e-4)


def test_transposed_stencil_makes_no_entries(spark, monkeypatch):
    """The gradient of a smoothness criterion needs D.T of a table's length: none of its entries are the driver's."""
    x = np.arange(6.0) ** 2
    c = quadratic_criterion(IdentityOperator(6), np.zeros(6), (2.0,), (DifferenceOperator(6),))
    wide = StencilOperator({-2: 1.0, 1: 3.0}, 6)
    expected, spread = c.gradient(x), wide.T(x)
    with monkeypatch.context() as m:
        m.setattr(StencilOperator, "entries", lambda self: pytest.fail("entries on the driver"))
        f = to_field(spark, x)
        got = quadratic_criterion(IdentityOperator(6), f.values(F.lit(0.0)), (2.0,), (DifferenceOperator(6),)).gradient(f)
        np.testing.assert_allclose(to_array(got, 6), expected)
        np.testing.assert_allclose(to_array(wide.T(f), 6), spread)
    assert not StencilOperator({4: 1.0}, 6).covers() and DifferenceOperator(6).T.covers()


@pytest.mark.parametrize("op", [SumOperator(shape=(2, 4), axis=0).T * SumOperator(shape=(2, 4), axis=0), SymmetricBandToeplitzOperator(8, [2, 1]), Group([DenseOperator(np.stack([np.arange(8) + 1j, np.arange(8.0)])).H, DenseOperator(np.stack([np.arange(8) + 1j, np.arange(8.0)]))]), WaveletOperator("db2", 8, 2), Group([WaveletOperator("db2", 8, 2).T, WaveletOperator("db2", 8, 2)]), Wavelet2dOperator("db2", (2, 4), 1), FFTNdOperator((2, 4)), FFTOperator(8), ConvolutionOperator([1, 2, 0.5], 8)], ids=repr)
def test_vectors_stay_rows(spark, op):
    """Nothing is shuffled or joined for whole vectors, and rows of another length or with nulls come out as before."""
    x = np.random.default_rng(5).normal(size=(5, 8))
    odd = [(5, [1.0, 2.0]), (6, [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), (7, None)]
    df = spark.createDataFrame([*((k, r.tolist()) for k, r in enumerate(x)), *odd], "k long, a array<double>")
    f = rows(df, "a", "k", 8)
    y, plain = op(f), op(replace(f, whole=None))
    assert y.whole is not None and plain.whole is None
    only = y.whole.table.where("k < 5").mapInArrow(_batches(y.whole.steps, ("k",), y.is_complex), y.df.schema)
    assert "Exchange" not in only._jdf.queryExecution().executedPlan().toString()

    def values(g):
        v = F.col("v") if not g.is_complex else F.col("v.re")
        w = F.lit(0.0) if not g.is_complex else F.col("v.im")
        return {(k, i): (a, b) for k, i, a, b in g.df.select("k", "i", v, w).collect() if (a, b) != (0, 0)}

    got, before = values(y), values(plain)
    assert len(got) == y.df.select("k", "i").where("k < 5").count() + sum(k > 4 for k, _ in before)
    assert {c: repr(v) for c, v in got.items() if c[0] > 4} == {c: repr(v) for c, v in before.items() if c[0] > 4}
    expected = op.on_rows(x)
    for (k, i), (a, b) in got.items():
        if k < 5:
            np.testing.assert_allclose([a, b], [expected[k, i].real, expected[k, i].imag], atol=1e-9)
