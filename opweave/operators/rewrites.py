"""The rules. They keep answers: a square root of a square is not rewritten, as signs and NaN would change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from opweave.expr import Missing, Operator, compose
from opweave.operators.block import BlockColumnOperator, BlockDiagonalOperator, BlockRowOperator
from opweave.operators.coords import Cartesian2SphericalOperator, Spherical2CartesianOperator
from opweave.operators.dense import DenseBlockDiagonalOperator, DenseOperator
from opweave.operators.diagonal import ConstantOperator, DiagonalOperator, HomothetyOperator, IdentityOperator, MaskOperator, PackOperator, ReshapeOperator, UnpackOperator, ZeroOperator
from opweave.operators.elementwise import HardThresholdingOperator, PowerOperator, ReciprocalOperator, To1dOperator, ToNdOperator
from opweave.operators.sparse import SparseOperator
from opweave.operators.transform import ConvolutionOperator, FFTOperator, InverseFFT
from opweave.rules import binary


def _known(op) -> bool:
    """A diagonal whose data are an array of the vector's own length."""
    return not isinstance(op.data, DataFrame) and op.broadcast in ("disabled", "scalar")


def _whole(op: ConstantOperator) -> bool:
    return op.data.ndim == 0 or op.broadcast in ("disabled", "scalar")


@binary("compose", Operator, Operator)
def associates(a, b):
    """A⁻¹A, orthogonal Aᵀ A, involutary A A are I; idempotent A A is A."""
    if isinstance(a, Missing) and a.kind == "I" and a.of is b or isinstance(b, Missing) and b.kind == "I" and b.of is a:
        return [IdentityOperator(b.shapein)]
    if a == b and a.idempotent:
        return [a]
    if a == b and a.involutary:
        return [IdentityOperator(b.shapein)]
    if b.orthogonal and not b.symmetric and b.shapein == b.shapeout and type(a) is type(b.T) and a == b.T:
        return [IdentityOperator(b.shapein)]
    return None


@binary("compose", IdentityOperator, Operator)
def identity_left(a, b):
    return [_sized(b, a.shapein)]


def _sized(o, n):
    """A scalar takes over the length that an identity knew."""
    return HomothetyOperator(o.value, n) if isinstance(o, HomothetyOperator) and o.shapein is None and n is not None else IdentityOperator(n) if isinstance(o, IdentityOperator) and o.shapein is None else o


@binary("compose", Operator, IdentityOperator)
def identity_right(a, b):
    return [_sized(a, b.shapein)]


@binary("compose", HomothetyOperator, HomothetyOperator)
def scalars(a, b):
    return [_scaled(a.value * b.value, b.shapein or a.shapein)]


def _scaled(value, n=None):
    return ZeroOperator(n, n) if value == 0 and n is not None else IdentityOperator(n) if value == 1 else HomothetyOperator(value, n)


@binary("compose", Operator, HomothetyOperator)
def scalar_forward(a, b):
    """Scalars move to the front of linear runs, or into an operator that can hold them."""
    if not a.linear:
        return None
    if isinstance(a, DiagonalOperator) and _known(a):
        return [DiagonalOperator(a.data * b.value)]
    if isinstance(a, DenseOperator):
        return [DenseOperator(a.data * b.value)]
    if isinstance(a, SparseOperator):
        return [a.scaled(b.value)]
    if isinstance(a, ConvolutionOperator):
        return [ConvolutionOperator(a.kernel * b.value, a.shapein)]
    return None if isinstance(a, HomothetyOperator) else [b, a]


@binary("compose", HomothetyOperator, DiagonalOperator)
def scalar_diagonal(a, b):
    return [DiagonalOperator(b.data * a.value)] if _known(b) else None


@binary("compose", HomothetyOperator, DenseOperator)
def scalar_dense(a, b):
    return [DenseOperator(b.data * a.value)]


@binary("compose", HomothetyOperator, SparseOperator)
def scalar_sparse(a, b):
    return [b.scaled(a.value)]


@binary("compose", ZeroOperator, Operator)
def zero_left(a, b):
    return [ZeroOperator(b.shapein, a.shapeout)]


@binary("compose", Operator, ZeroOperator)
def zero_right(a, b):
    return [ZeroOperator(b.shapein, a.shapeout)] if a.linear else None


@binary("compose", ConstantOperator, Operator)
def constant_left(a, b):
    return [a] if a.data.ndim and _whole(a) else None


@binary("compose", Operator, ConstantOperator)
def constant_right(a, b):
    """Constant folding: the operator is applied to the constant."""
    if isinstance(a, Missing) or not (a.separable or b.data.ndim) or not _whole(b):
        return None
    try:
        return [ConstantOperator(a.on_array(b.data))]
    except (NotImplementedError, AttributeError, TypeError):
        return None


@binary("compose", DiagonalOperator, DiagonalOperator)
def diagonals(a, b):
    return [DiagonalOperator(a.data * b.data)] if _known(a) and _known(b) else None


@binary("compose", MaskOperator, MaskOperator)
def masks(a, b):
    if isinstance(a.mask, np.ndarray) and isinstance(b.mask, np.ndarray):
        return [MaskOperator(a.mask | b.mask)]
    return None


@binary("compose", DenseOperator, DenseOperator)
def denses(a, b):
    return [DenseOperator(a.data @ b.data)]


@binary("compose", DenseBlockDiagonalOperator, DenseBlockDiagonalOperator)
def dense_blocks(a, b):
    return [DenseBlockDiagonalOperator(a.data @ b.data)]


@binary("compose", PackOperator, UnpackOperator)
def pack_unpack(a, b):
    return [IdentityOperator(b.shapein)] if isinstance(a.mask, np.ndarray) and np.array_equal(a.mask, b.mask) else None


@binary("compose", UnpackOperator, PackOperator)
def unpack_pack(a, b):
    return [MaskOperator(~a.mask)] if isinstance(a.mask, np.ndarray) and np.array_equal(a.mask, b.mask) else None


@binary("compose", PowerOperator, PowerOperator)
def powers(a, b):
    """(x**n)**m is x**(nm) where that holds for every x: whole powers, and two reciprocals."""
    if float(a.n).is_integer() and float(b.n).is_integer() and not isinstance(a, ReciprocalOperator) and not isinstance(b, ReciprocalOperator):
        return [PowerOperator(a.n * b.n)]
    if a.n > 0 and b.n > 0 and not float(b.n).is_integer():
        return [PowerOperator(a.n * b.n)] if not float(a.n * b.n).is_integer() else None
    return None


@binary("multiply", PowerOperator, PowerOperator)
def power_product(a, b):
    return [PowerOperator(a.n + b.n)] if a.n > 0 and b.n > 0 and (float(a.n).is_integer() or float(b.n).is_integer() or not float(a.n + b.n).is_integer()) else None


@binary("compose", HardThresholdingOperator, HardThresholdingOperator)
def thresholds(a, b):
    return [HardThresholdingOperator(np.maximum(a.a, b.a))]


@binary("compose", ReshapeOperator, ReshapeOperator)
def reshapes(a, b):
    return [ReshapeOperator(b.dims_in, a.dims_out)]


@binary("compose", Cartesian2SphericalOperator, Spherical2CartesianOperator)
def directions(a, b):
    return [IdentityOperator()] if a.same(b) else None


@binary("compose", Spherical2CartesianOperator, Cartesian2SphericalOperator)
def directions_back(a, b):
    return [IdentityOperator()] if a.same(b) else None


@binary("compose", To1dOperator, ToNdOperator)
def indices(a, b):
    return [IdentityOperator()] if (a.dims, a.order) == (b.dims, b.order) else None


@binary("compose", ToNdOperator, To1dOperator)
def indices_back(a, b):
    return [IdentityOperator()] if (a.dims, a.order) == (b.dims, b.order) else None


@binary("compose", ConvolutionOperator, ConvolutionOperator)
def convolutions(a, b):
    r = np.fft.ifft(np.fft.fft(a.response()) * np.fft.fft(b.response()))
    return [ConvolutionOperator.of_spectrum(r.real if a.real and b.real else r, a.shapein)]


@binary("add", ConvolutionOperator, ConvolutionOperator)
def convolution_sum(a, b):
    return [ConvolutionOperator.of_spectrum(a.response() + b.response(), a.shapein)]


@binary("compose", FFTOperator, FFTOperator)
def transforms(a, b):
    return [HomothetyOperator(float(a.shapein), a.shapein)] if isinstance(a, InverseFFT) != isinstance(b, InverseFFT) else None


@binary("compose", FFTOperator, ConvolutionOperator)
def spectrum(a, b):
    return [DiagonalOperator(np.fft.fft(b.response())), a] if not isinstance(a, InverseFFT) else None


@binary("add", HomothetyOperator, HomothetyOperator)
def scalar_sum(a, b):
    return [_scaled(a.value + b.value, a.shapein or b.shapein)]


@binary("add", IdentityOperator, HomothetyOperator)
def identity_scalar(a, b):
    return [_scaled(1 + b.value, a.shapein or b.shapein)]


@binary("add", IdentityOperator, IdentityOperator)
def identities(a, b):
    return [HomothetyOperator(2.0, a.shapein or b.shapein)]


@binary("add", ZeroOperator, Operator)
def zero_sum(a, b):
    return [b]


@binary("add", ConstantOperator, ConstantOperator)
def constant_sum(a, b):
    return [ConstantOperator(a.data + b.data)] if _whole(a) and _whole(b) else None


@binary("multiply", ConstantOperator, ConstantOperator)
def constant_product(a, b):
    return [ConstantOperator(a.data * b.data)] if _whole(a) and _whole(b) else None


@binary("multiply", ConstantOperator, Operator)
def constant_linear(a, b):
    return [compose(DiagonalOperator(a.data, broadcast=a.broadcast) if a.data.ndim else HomothetyOperator(a.data[()]), b)] if b.linear else None


@binary("add", DiagonalOperator, DiagonalOperator)
def diagonal_sum(a, b):
    return [DiagonalOperator(a.data + b.data)] if _known(a) and _known(b) else None


@binary("add", HomothetyOperator, DiagonalOperator)
def scalar_plus_diagonal(a, b):
    return [DiagonalOperator(a.value + b.data)] if _known(b) else None


@binary("add", IdentityOperator, DiagonalOperator)
def identity_plus_diagonal(a, b):
    return [DiagonalOperator(1 + b.data)] if _known(b) else None


@binary("compose", BlockDiagonalOperator, BlockDiagonalOperator)
def block_block(a, b):
    return [BlockDiagonalOperator([compose(x, y) for x, y in zip(a.operands, b.operands)], b.partitionin)] if a.partitionin == b.partitionout else None


@binary("add", BlockDiagonalOperator, BlockDiagonalOperator)
def block_sum(a, b):
    return [BlockDiagonalOperator([x + y for x, y in zip(a.operands, b.operands)], a.partitionin)] if (a.partitionin, a.partitionout) == (b.partitionin, b.partitionout) else None


@binary("compose", BlockRowOperator, BlockColumnOperator)
def row_column(a, b):
    if a.operation != "add" or a.partitionin != b.partitionout:
        return None
    out = compose(a.operands[0], b.operands[0])
    for x, y in zip(a.operands[1:], b.operands[1:]):
        out = out + compose(x, y)
    return [out]


@binary("compose", DiagonalOperator, BlockDiagonalOperator)
def diagonal_block(a, b):
    if not _known(a):
        return None
    cuts = np.cumsum([0, *b.partitionout])
    return [BlockDiagonalOperator([compose(DiagonalOperator(a.data[i:j]), o) for o, i, j in zip(b.operands, cuts, cuts[1:])], b.partitionin)]
