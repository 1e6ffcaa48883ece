"""More queries: matrices of every kind, complex fields, axes, broadcasts, transforms and solvers.

Embeddings are vectors of 64 elements, or arrays of 8 by 8; inexact doubles are rounded, and ``+ 0.0`` removes
negative zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from opweave.expr import Field, Group, Operator, asoperator, compose
from opweave.operators.block import BlockColumnOperator, BlockDiagonalOperator, BlockRowOperator, BlockSliceOperator, DistributionGlobalOperator, proxy_group, split
from opweave.operators.coords import Cartesian2SphericalOperator
from opweave.operators.dense import DenseBlockDiagonalOperator, DenseOperator, Rotation3dOperator, dense
from opweave.operators.diagonal import ConstantOperator, CopyOperator, DiagonalNumexprOperator, DiagonalOperator, HomothetyOperator, IdentityOperator, PackOperator, ReshapeOperator, UnpackOperator
from opweave.operators.elementwise import SquareOperator, To1dOperator
from opweave.operators.reduce import MaxOperator, MinMaxOperator, MinOperator, ProductOperator, ReductionOperator
from opweave.operators.sparse import BandOperator, DifferenceOperator, EigendecompositionOperator, IntegrationTrapezeOperator, LowerTriangularOperator, SparseOperator, StencilOperator, SumOperator, SymmetricBandOperator, SymmetricBandToeplitzOperator, TridiagonalOperator, UpperTriangularOperator
from opweave.operators.transform import ConvolutionNdOperator, ConvolutionOperator, FFTNdOperator, FFTOperator, Wavelet2dOperator, WaveletOperator
from opweave.plans import field, rows
from opweave.registry import query
from opweave.session import table
from opweave.solvers.cg import lanczos_field, pcg
from opweave.solvers.criteria import Huber, Normp, conjugate_gradient_field, huber_criterion, minimise, quadratic_criterion
from opweave.values import abs2, complex_, multiply_conjugate, rounded

#: The embeddings in long form, for SQL: vec_id, i from 0, v.
LONG = "x as (select vec_id, g.i, embedding[g.i+1]::double v from embeddings, generate_series(0,63) g(i))"


def _vectors(s, d) -> Field:
    return rows(table(s, d, "embeddings"), "embedding", "vec_id", 64)


def _vector(name: str, op: Operator, sql: str, digits: int = 5):
    """An operator on every embedding; sql gives vec_id, i and the result r, from x."""

    def run(s, d):
        y = op(_vectors(s, d))
        kept = [k for k in y.keys if k != "vec_id"]
        return y.df.select("vec_id", *kept, "i", (F.round("v", digits) + 0.0).alias("y"))

    query(name, f"with {LONG} select * replace (round(y,{digits})+0.0::double as y) from ({sql})")(run)


def _complex_vector(name: str, op: Operator, sql: str, digits: int = 5):
    def run(s, d):
        y = op(_vectors(s, d))
        return y.df.select("vec_id", "i", *((F.round(F.col("v")[k], digits) + 0.0).alias(k) for k in ("re", "im")))

    query(name, f"with {LONG} select vec_id, i, round(re,{digits})+0.0::double re, round(im,{digits})+0.0::double im from ({sql})")(run)


def _near(weights: str) -> str:
    """SQL for sums over neighbours: weights is an expression of the row a.i and the column b.i, null for none."""
    return f"select a.vec_id, a.i, sum(coalesce({weights},0)*b.v) y from x a join x b using (vec_id) group by 1, 2"


n64 = np.arange(64.0)
_vector("tridiagonal", TridiagonalOperator(n64 + 1, -n64[1:] / 8, n64[:-1] / 4), _near("case b.i-a.i when 0 then a.i+1 when -1 then -a.i/8 when 1 then a.i/4 end"))
_vector("band", BandOperator(np.stack([n64, n64 / 2, 1 - n64, np.ones(64)]), 2, 1), _near("case b.i-a.i when 1 then b.i when 0 then b.i/2 when -1 then 1-b.i when -2 then 1 end"))
_vector("band_transposed", BandOperator(np.stack([n64, n64 / 2, 1 - n64, np.ones(64)]), 2, 1).T, _near("case a.i-b.i when 1 then a.i when 0 then a.i/2 when -1 then 1-a.i when -2 then 1 end"))
_vector("lower_triangular", LowerTriangularOperator(np.stack([n64, n64 + 2])), _near("case a.i-b.i when 0 then b.i when 1 then b.i+2 end"))
_vector("upper_triangular", UpperTriangularOperator(np.stack([n64 + 2, n64])), _near("case b.i-a.i when 0 then b.i when 1 then b.i+2 end"))
_vector("symmetric_band", SymmetricBandOperator(np.stack([n64 + 4, np.full(64, 1.5)])), _near("case abs(a.i-b.i) when 0 then a.i+4 when 1 then 1.5 end"))
_vector("symmetric_band_upper", SymmetricBandOperator(np.stack([np.full(64, 1.5), n64 + 4]), lower=False), _near("case abs(a.i-b.i) when 0 then a.i+4 when 1 then 1.5 end"))
_low = SymmetricBandOperator(np.stack([n64 + 4, np.full(64, 1.5)])).cholesky()
_vector("cholesky", compose(_low, _low.T), _near("case abs(a.i-b.i) when 0 then a.i+4 when 1 then 1.5 end"))
_vector("toeplitz", SymmetricBandToeplitzOperator(64, [3, -1, 0.5]), _near("case abs(a.i-b.i) when 0 then 3 when 1 then -1 when 2 then 0.5 end"))
_vector("toeplitz_batch", SymmetricBandToeplitzOperator(64, [[3, -1, 0.5], [1, 0, 2]]), "select a.vec_id, r.r::bigint block, a.i, sum(coalesce(case abs(a.i-b.i) when 0 then 3-2*r.r when 1 then r.r-1 when 2 then 0.5+1.5*r.r end,0)*b.v) y from x a join x b using (vec_id), (values (0),(1)) r(r) group by 1,2,3")
_vector("eigendecomposition", EigendecompositionOperator(TridiagonalOperator(np.full(64, 2.0), np.full(63, -1.0))) ** 2, _near("case abs(a.i-b.i) when 0 then case when a.i in (0,63) then 5 else 6 end when 1 then -4 when 2 then 1 end"))
_vector("integration_trapeze", IntegrationTrapezeOperator(n64**2 / 64), "select vec_id, 0::bigint i, sum(0.5*v*((least(i+1,63)*least(i+1,63)-greatest(i-1,0)*greatest(i-1,0))/64)) y from x group by 1")
_vector("matrix_power", TridiagonalOperator(np.full(64, 1.0), np.full(63, 0.5)) ** 3, "select * from (with a as (select vec_id,i, v + 0.5*coalesce(lag(v) over w,0) + 0.5*coalesce(lead(v) over w,0) v from x window w as (partition by vec_id order by i)), b as (select vec_id,i, v + 0.5*coalesce(lag(v) over w,0) + 0.5*coalesce(lead(v) over w,0) v from a window w as (partition by vec_id order by i)) select vec_id,i, v + 0.5*coalesce(lag(v) over w,0) + 0.5*coalesce(lead(v) over w,0) y from b window w as (partition by vec_id order by i))")
_vector("dense_inverse", compose(DenseOperator(np.diag(n64 + 1) + np.diag(np.ones(63), 1)).I, DenseOperator(np.diag(n64 + 1) + np.diag(np.ones(63), 1))), "select vec_id, i, v y from x")
_vector("dense_axes", dense(np.arange(2 * 8 * 8).reshape(2, 8, 8) / 10, naxesin=2), "select vec_id, r.r::bigint i, sum(v*(64*r.r+i)/10) y from x, (values (0),(1)) r(r) group by 1,2", 4)
_vector("dense_extra_axes", dense(np.arange(3 * 2 * 64).reshape(3, 2, 64) / 100, naxesin=1, naxesextra=1), "select vec_id, b.b::bigint block, r.r::bigint i, sum(v*(128*b.b+64*r.r+i)/100) y from x, (values (0),(1)) r(r), (values (0),(1),(2)) b(b) group by 1,2,3", 4)
_vector("copy", CopyOperator(), "select vec_id, i, v y from x")
_vector("group", Group([HomothetyOperator(3.0), DiagonalOperator(n64)]), "select vec_id, i, 3*i*v y from x")
_vector("reshape", compose(ReshapeOperator((8, 8), (64,)), ReshapeOperator((64,), (8, 8))), "select vec_id, i, v y from x")
_vector("diagonal_numexpr", DiagonalNumexprOperator("1 + sqrt(i) * 2"), "select vec_id, i, (1+sqrt(i)*2)*v y from x")
_vector("diagonal_leftward", DiagonalOperator(np.arange(1, 9), broadcast="leftward"), "select vec_id, i, (i%8+1)*v y from x")
_vector("diagonal_rightward", DiagonalOperator(np.arange(1, 9), broadcast="rightward"), "select vec_id, i, (i//8+1)*v y from x")
_vector("constant_leftward", ConstantOperator(np.arange(8.0), broadcast="leftward") + IdentityOperator(), "select vec_id, i, i%8+v y from x")
_vector("constant_rightward", ConstantOperator(np.arange(8.0), broadcast="rightward"), "select vec_id, i, (i//8)::double y from x")
_vector("pack_rightward", PackOperator([True, False, False, True], 64, "rightward"), "select vec_id, (case when i < 16 then i else i-32 end)::bigint i, v y from x where i//16 in (0,3)")
_vector("unpack_array", UnpackOperator(n64 % 2 == 0) * PackOperator(n64 % 2 == 0), "select vec_id, i, case when i%2=0 then v else 0 end y from x")
_vector("sum_axis_0", SumOperator(shape=(8, 8), axis=0), "select vec_id, (i%8)::bigint i, sum(v) y from x group by 1,2")
_vector("sum_axis_1", SumOperator(shape=(8, 8), axis=1), "select vec_id, (i//8)::bigint i, sum(v) y from x group by 1,2")
_vector("sum_transposed", SumOperator(shape=(8, 8), axis=0).T * SumOperator(shape=(8, 8), axis=0), "select a.vec_id, a.i, sum(b.v) y from x a join x b on a.vec_id=b.vec_id and a.i%8=b.i%8 group by 1,2")
_vector("difference_axis_0", DifferenceOperator(shape=(8, 8), axis=0), "select a.vec_id, a.i, b.v-a.v y from x a join x b on a.vec_id=b.vec_id and b.i=a.i+8")
_vector("difference_axis_1", DifferenceOperator(shape=(8, 8), axis=-1), "select a.vec_id, (a.i//8*7+a.i%8)::bigint i, b.v-a.v y from x a join x b on a.vec_id=b.vec_id and b.i=a.i+1 where a.i%8<7")
_vector("max_axis_0", MaxOperator(shape=(8, 8), axis=0), "select vec_id, (i%8)::bigint i, max(v) y from x group by 1,2")
_vector("min_all", MinOperator(shape=(8, 8)), "select vec_id, 0::bigint i, min(v) y from x group by 1")
_vector("product_axis_1", ProductOperator(shape=(8, 8), axis=1), "select vec_id, (i//8)::bigint i, product(v) y from x group by 1,2", 8)
_vector("minmax_new_axis", MinMaxOperator(new_axis="which"), "select vec_id, w.w::bigint which, 0::bigint i, case when w.w=0 then min(v) else max(v) end y from x, (values (0),(1)) w(w) group by 1, w.w")
_vector("reduction_function", ReductionOperator(np.ptp), "select vec_id, 0::bigint i, max(v)-min(v) y from x group by 1")
_vector("block_slice_negative", BlockSliceOperator([HomothetyOperator(3.0)], [slice(-2, None)]), "select vec_id, i, case when i>=62 then 3*v else v end y from x")
_vector("block_slice_dense", BlockSliceOperator([DenseOperator([[0, 1.0, 2], [1, 0, 0], [0, 0, 3]])], [slice(60, 54, -2)]), "select a.vec_id, a.i, case a.i when 60 then m.v58+2*m.v56 when 58 then m.v60 when 56 then 3*m.v56 else a.v end y from x a join (select vec_id, max(v) filter (i=60) v60, max(v) filter (i=58) v58, max(v) filter (i=56) v56 from x group by 1) m using (vec_id)")
_vector("block_column_new_axis", BlockColumnOperator([IdentityOperator(), HomothetyOperator(2.0)], new_axis="block"), "select vec_id, b.b::bigint block, i, (1+b.b)*v y from x, (values (0),(1)) b(b)")
_vector("block_row_new_axis", compose(BlockRowOperator([HomothetyOperator(3.0), IdentityOperator()], new_axis="block"), BlockColumnOperator([IdentityOperator(), DiagonalOperator(n64)], new_axis="block")), "select vec_id, i, (3+i)*v y from x")
_vector("block_diagonal_new_axis", compose(BlockDiagonalOperator([HomothetyOperator(3.0), DiagonalOperator(n64)], new_axis="block"), BlockColumnOperator([IdentityOperator(), IdentityOperator()], new_axis="block")), "select vec_id, b.b::bigint block, i, case when b.b=0 then 3*v else i*v end y from x, (values (0),(1)) b(b)")
_vector("block_row_maximum", BlockRowOperator([IdentityOperator(32), HomothetyOperator(-1.0, 32)], operation="maximum"), "select a.vec_id, a.i, greatest(a.v,-b.v) y from x a join x b on a.vec_id=b.vec_id and b.i=a.i+32")
_vector("proxies", sum((o.T * o for o in proxy_group(3, lambda k: DiagonalOperator(n64 + k))), start=0 * IdentityOperator()), "select vec_id, i, (i*i+(i+1)*(i+1)+(i+2)*(i+2))*v y from x")
_vector("wavelet_db2", WaveletOperator("db2", 64), "select a.vec_id, (a.i+32*p.p)::bigint i, (case p.p when 0 then (1+sqrt(3))*v0+(3+sqrt(3))*v1+(3-sqrt(3))*v2+(1-sqrt(3))*v3 else (1-sqrt(3))*v0-(3-sqrt(3))*v1+(3+sqrt(3))*v2-(1+sqrt(3))*v3 end)/(4*sqrt(2)) y from (select a.vec_id, a.i//2 i, a.v v0, (select b.v from x b where b.vec_id=a.vec_id and b.i=(a.i+1)%64) v1, (select b.v from x b where b.vec_id=a.vec_id and b.i=(a.i+2)%64) v2, (select b.v from x b where b.vec_id=a.vec_id and b.i=(a.i+3)%64) v3 from x a where a.i%2=0) a, (values (0),(1)) p(p)")
_vector("wavelet_levels", WaveletOperator("haar", 64, 3), "select vec_id, (i//8)::bigint i, sum(v)/sqrt(8) y from x group by 1,2 union all select vec_id, (8+i//8)::bigint, sum(case when i%8<4 then v else -v end)/sqrt(8) from x group by 1,2 union all select vec_id, (16+i//4)::bigint, sum(case when i%4<2 then v else -v end)/2 from x group by 1,2 union all select vec_id, (32+i//2)::bigint, sum(case when i%2=0 then v else -v end)/sqrt(2) from x group by 1,2")
_back = WaveletOperator("db4", 64, 2)
_vector("wavelet_inverse", Group([_back.T, _back]), "select vec_id, i, v y from x")
_back2d = Wavelet2dOperator("db2", (8, 8), 2)
_vector("wavelet_2d_inverse", Group([_back2d.T, _back2d]), "select vec_id, i, v y from x")
_vector("convolution_transposed", ConvolutionOperator([1, 2, 3.0, 4], 64).T, "select a.vec_id, a.i, sum(b.v*k.w) y from x a join (values (-1,1.0::double),(0,2.0::double),(1,3.0::double),(2,4.0::double)) k(o,w) on true join x b on a.vec_id=b.vec_id and b.i=(a.i+k.o)%64+case when (a.i+k.o)<0 then 64 else 0 end group by 1,2")
_vector("convolution_wide", ConvolutionNdOperator(np.ones((8, 8)), (8, 8)), "select a.vec_id, a.i, s.y from x a join (select vec_id, sum(v) y from x group by 1) s using (vec_id)")
_vector("rotation_extrinsic", Group([DenseBlockDiagonalOperator(Rotation3dOperator("XYZ", 0.1, 0.2, 0.3).data), PackOperator(n64 < 3)]), "select vec_id, 0::bigint block, r.r::bigint i, case r.r when 0 then cos(0.3)*x2-sin(0.3)*y1 when 1 then sin(0.3)*x2+cos(0.3)*y1 else -sin(0.2)*v0+cos(0.2)*z1 end y from (select *, cos(0.2)*v0+sin(0.2)*z1 x2 from (select vec_id, v0, cos(0.1)*v1-sin(0.1)*v2 y1, sin(0.1)*v1+cos(0.1)*v2 z1 from (select vec_id, max(v) filter (i=0) v0, max(v) filter (i=1) v1, max(v) filter (i=2) v2 from x group by 1))), (values (0),(1),(2)) r(r)")

j64 = np.array([1, 1j, -1, -1j])[np.arange(64) % 4]
_complex_vector("complex_homothety", HomothetyOperator(2 + 3j), "select vec_id, i, 2*v re, 3*v im from x")
_complex_vector("complex_diagonal", DiagonalOperator(j64), "select vec_id, i, case i%4 when 0 then v when 2 then -v else 0 end re, case i%4 when 1 then v when 3 then -v else 0 end im from x")
_complex_vector("complex_sum", DiagonalOperator(j64) + IdentityOperator(), "select vec_id, i, case i%4 when 0 then 2*v when 2 then 0 else v end re, case i%4 when 1 then v when 3 then -v else 0 end im from x")
_complex_vector("complex_inverse", Group([DiagonalOperator(j64 * 2).I, DiagonalOperator(j64 * 2)]), "select vec_id, i, v re, 0::double im from x")
_complex_vector("dense_complex", DenseOperator(np.stack([n64 + 1j, 1j * n64])), "select vec_id, r.r::bigint i, sum(case r.r when 0 then i*v else 0 end) re, sum(case r.r when 0 then v else i*v end) im from x, (values (0),(1)) r(r) group by 1,2")
_complex_vector("dense_adjoint", Group([DenseOperator(np.stack([n64 + 1j, 1j * n64])).H, DenseOperator(np.stack([n64 + 1j, 1j * n64]))]), "select b.vec_id, b.i, sum(a.v*(b.i*a.i + 1 + b.i*a.i)) re, sum(a.v*(b.i - a.i)) im from x a join x b using (vec_id) group by 1,2", 3)
_complex_vector("dense_conjugate", DenseOperator(np.stack([n64 + 1j, 1j * n64])).C, "select vec_id, r.r::bigint i, sum(case r.r when 0 then i*v else 0 end) re, sum(case r.r when 0 then -v else -i*v end) im from x, (values (0),(1)) r(r) group by 1,2")
_complex_vector("tridiagonal_complex", TridiagonalOperator(n64, 1j * np.ones(63)), "select a.vec_id, a.i, sum(case when a.i=b.i then a.i*b.v else 0 end) re, sum(case a.i-b.i when 1 then b.v when -1 then -b.v else 0 end) im from x a join x b using (vec_id) group by 1,2")
_complex_vector("convolution_complex", ConvolutionOperator([1j, 2, 1 - 1j], 64), "select a.vec_id, a.i, 2*a.v + max(b.v) filter (b.i=(a.i+63)%64) re, max(b.v) filter (b.i=(a.i+1)%64) - max(b.v) filter (b.i=(a.i+63)%64) im from x a join x b using (vec_id) group by 1,2,a.v")
_complex_vector("fft_inverse", Group([FFTOperator(64).I, FFTOperator(64)]), "select vec_id, i, v re, 0::double im from x")
_complex_vector("fft_2d", FFTNdOperator((8, 8)), "select vec_id, (8*p.p+q.q)::bigint i, sum(v*cos(2*pi()*((p.p*(i//8)+q.q*(i%8))%8)/8)) re, sum(-v*sin(2*pi()*((p.p*(i//8)+q.q*(i%8))%8)/8)) im from x, generate_series(0,7) p(p), generate_series(0,7) q(q) group by 1,2")


@query("fft_field", "with n as (select count(*) n from customer) select k.c_custkey i, round(sum(j.c_acctbal*cos(2*pi()*((k.c_custkey*j.c_custkey)%n.n)/n.n)),1)+0.0::double re, round(sum(-j.c_acctbal*sin(2*pi()*((k.c_custkey*j.c_custkey)%n.n)/n.n)),1)+0.0::double im from customer j, customer k, n group by 1")
def fft_field(s, d):
    """One vector without a key, all customers' balances: no task holds it whole."""
    t = table(s, d, "customer")
    n = t.count()
    y = FFTOperator(n)(field(t, "c_custkey", "c_acctbal", n=n)).df
    return y.select("i", *((F.round(F.col("v")[k], 1) + 0.0).alias(k) for k in ("re", "im")))


@query("sparse_complex", "select l_orderkey, round(sum(l_quantity*s_acctbal),2) re, round(sum(l_linenumber*s_acctbal),2) im from lineitem join supplier on l_suppkey=s_suppkey group by 1")
def sparse_complex(s, d):
    entries = table(s, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), complex_(F.col("l_quantity"), F.col("l_linenumber")).alias("a"))
    y = SparseOperator(entries)(field(table(s, d, "supplier"), "s_suppkey", "s_acctbal"))
    return y.df.select(F.col("i").alias("l_orderkey"), *(F.round(F.col("v")[k], 2).alias(k) for k in ("re", "im")))


def _pair(s, d):
    t = table(s, d, "lineitem")
    return t, complex_(F.col("l_quantity"), F.col("l_tax")), complex_(F.col("l_discount"), F.col("l_linenumber"))


@query("abs2", "select l_orderkey, l_linenumber, round(l_quantity*l_quantity+l_tax*l_tax,6) y from lineitem")
def abs2_(s, d):
    t, a, _ = _pair(s, d)
    return t.select("l_orderkey", "l_linenumber", F.round(abs2(a), 6).alias("y"))


@query("multiply_conjugate", "select l_orderkey, l_linenumber, round(l_quantity*l_discount+l_tax*l_linenumber,6) re, round(l_tax*l_discount-l_quantity*l_linenumber,6) im from lineitem")
def multiply_conjugate_(s, d):
    t, a, b = _pair(s, d)
    y = multiply_conjugate(a, b)
    return t.select("l_orderkey", "l_linenumber", F.round(y["re"], 6).alias("re"), F.round(y["im"], 6).alias("im"))


def _accumulate(operation: str, sql: str):
    @query(f"accumulate_{operation}", f"select event_id, round({sql},6) y from events")
    def run(s, d):
        x = field(table(s, d, "events"), "event_id", "value")
        out = x.values(F.col("v") + 1.0)
        return SquareOperator()(x, out=out, operation=operation).df.select(F.col("i").alias("event_id"), rounded("v", 6).alias("y"))


_accumulate("add", "value+1+value*value")
_accumulate("subtract", "value+1-value*value")
_accumulate("multiply", "(value+1)*value*value")
_accumulate("divide", "(value+1)/(value*value)")


@query("scalar_function", "select event_id, round(sqrt(value*value+1),6) y from events")
def scalar_function(s, d):
    """A function of arrays that Spark has no expression for goes over Arrow batches."""
    op = asoperator(lambda x: np.hypot(x, 1))
    return table(s, d, "events").select("event_id", rounded(op(F.col("value")), 6).alias("y"))


@query("negation", "select event_id, round(3 - value - 2*value,6) y from events")
def negation(s, d):
    op = 3.0 - asoperator(lambda x: x) - 2 * IdentityOperator()
    return table(s, d, "events").select("event_id", rounded(op.on_column(F.col("value")), 6).alias("y"))


@query("reduce_skipna", "select user_id, round(sum(value) filter (event_id%3<>0),4) y, max(value) filter (event_id%3<>0) mx from events group by 1 having count(*) filter (event_id%3<>0) > 0")
def reduce_skipna(s, d):
    """NaN, which every third event has here, is left out."""
    gone = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    x = field(table(s, d, "events"), "event_id", gone, ["user_id"])
    total, most = (op(x).df.select("user_id", F.col("v").alias(n)) for op, n in ((ReductionOperator(np.add, skipna=True), "y"), (MaxOperator(skipna=True), "mx")))
    return total.join(most.where("mx is not null"), "user_id").select("user_id", F.round("y", 4).alias("y"), "mx")


@query("reduce_dtype", "select user_id, sum(trunc(value))::bigint y from events group by 1")
def reduce_dtype(s, d):
    x = field(table(s, d, "events"), "event_id", F.floor("value").cast("double"), ["user_id"])
    return ReductionOperator(np.add, dtype="int64")(x).df.select("user_id", F.col("v").alias("y"))


@query("distribution_global", "select event_id, value y from events")
def distribution_global(s, d):
    t = table(s, d, "events")
    op = DistributionGlobalOperator(t.count(), 8)
    return op.T(op(field(t, "event_id", "value"))).df.select(F.col("i").alias("event_id"), F.col("v").alias("y"))


@query("split", "select event_id, (ntile(7) over (order by event_id)-1)::int part from events")
def split_(s, d):
    """Near-equal ranges of the index, the longer ones first."""
    t = table(s, d, "events")
    ends = F.lit([p.stop for p in split(t.count(), 7)])
    return t.select("event_id", F.size(F.filter(ends, lambda e: e <= F.col("event_id"))).alias("part"))


@query("to1d_f_order", "select event_id, user_id + 1000*(event_id%7) i from events")
def to1d_f_order(s, d):
    y = To1dOperator((1000, 7), "F").on_column(F.array(F.col("user_id"), F.col("event_id") % 7))
    return table(s, d, "events").select("event_id", y.alias("i"))


@query("cart2sph_degrees", "select event_id, round(degrees(atan2(sin(value/60), cos(value/60))) + case when sin(value/60) < 0 then 360 else 0 end,6) azimuth, round(90 - degrees(acos(cos(value/200))),6) elevation from events")
def cart2sph_degrees(s, d):
    v = F.col("value")
    a, b = Cartesian2SphericalOperator("azimuth,elevation", degrees=True).on_columns(F.cos(v / 60), F.sin(v / 60), F.cos(v / 200))
    return table(s, d, "events").select("event_id", F.round(a, 6).alias("azimuth"), F.round(b, 6).alias("elevation"))


@query("todense", "select r.r::bigint i, c.c::bigint j, (case c.c-r.r when 0 then -1 when 1 then 1 else 0 end)::double a from generate_series(0,23) r(r), generate_series(0,24) c(c)")
def todense(s, d):
    """The difference operator's matrix, for as many columns as there are nations."""
    m = DifferenceOperator(table(s, d, "nation").count()).todense()
    return s.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, a double")


@query("huber_gradient", "select event_id, round(case when abs(value-60)<50 then 2*(value-60) else 100*sign(value-60) end,6) y from events")
def huber_gradient(s, d):
    x = field(table(s, d, "events"), "event_id", F.col("value") - 60)
    return Huber(50).gradient(x).df.select(F.col("i").alias("event_id"), F.round("v", 6).alias("y"))


@query("normp_gradient", "select event_id, round(1.5*sign(value-60)*sqrt(abs(value-60)),6)+0.0::double y from events")
def normp_gradient(s, d):
    x = field(table(s, d, "events"), "event_id", F.col("value") - 60)
    return Normp(1.5).gradient(x).df.select(F.col("i").alias("event_id"), (F.round("v", 6) + 0.0).alias("y"))


def _smoothness(s, d):
    t = table(s, d, "events")
    n = t.count()
    x = field(t, "event_id", "value", n=n)
    return x, quadratic_criterion(IdentityOperator(n), x.values(F.lit(60.0)), (2.0,), (DifferenceOperator(n),))


@query("criterion", "select round(sum((value-60)*(value-60)) + 2*sum(coalesce(d*d,0)),1) y from (select value, lead(value) over (order by event_id)-value d from events)")
def criterion(s, d):
    """|x - 60|² + 2 |D x|² of the events' values."""
    x, c = _smoothness(s, d)
    return s.createDataFrame([(round(float(c(x)), 1),)], "y double")


@query("criterion_gradient", "select event_id, round(2*(value-60) + 4*(coalesce(value-lag(value) over w,0) - coalesce(lead(value) over w-value,0)),4)+0.0::double y from events window w as (order by event_id)")
def criterion_gradient(s, d):
    x, c = _smoothness(s, d)
    return c.gradient(x).df.select(F.col("i").alias("event_id"), (F.round("v", 4) + 0.0).alias("y"))


@query("nonlinear_cg", "select c_custkey i, round(c_acctbal/(1+0.25),2) y from customer")
def nonlinear_cg(s, d):
    """The minimum of |x - b|² + |x|²/4."""
    t = table(s, d, "customer")
    b = field(t, "c_custkey", F.round("c_acctbal", 2), n=t.count())
    one = IdentityOperator(b.n)
    x = conjugate_gradient_field(quadratic_criterion(one, b, (0.25,), (one,)), b.values(F.lit(0.0)), tol=1e-9)
    return x.df.select("i", F.round("v", 2).alias("y"))


@query("nonlinear_cg_huber", "select r_regionkey::bigint i, round(r_regionkey::double,3) y from region")
def nonlinear_cg_huber(s, d):
    """Halved steps instead of exact ones."""
    t = table(s, d, "region")
    b = field(t, "r_regionkey", F.col("r_regionkey").cast("double"), n=t.count())
    x = conjugate_gradient_field(huber_criterion(IdentityOperator(b.n), b, deltas=(100.0,)), b.values(F.lit(1.0)), tol=1e-7, exact=False)
    return x.df.select("i", (F.round("v", 3) + 0.0).alias("y"))


@query("minimisers", "select m.m as name, r_regionkey::bigint i, round(r_regionkey/1.25,3)+0.0::double y from region, (values ('bfgs'),('cg'),('newton-cg'),('powell')) m(m) union all select 'bounded', r_regionkey::bigint, round(least(r_regionkey/1.25, 2.0),3) from region union all select 'constrained', r_regionkey::bigint, round(r_regionkey/1.25 + (10 - sum(r_regionkey/1.25) over ())/5,3) from region")
def minimisers(s, d):
    """The minimum of |x - b|² + |x|²/4 by every method, for as many unknowns as there are regions: without
    bounds, with 2 as the largest value, and with 10 as the sum."""
    b = np.array([float(r[0]) for r in table(s, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()])
    c, x0 = quadratic_criterion(IdentityOperator(len(b)), b, (0.25,), (IdentityOperator(len(b)),)), np.ones(len(b))
    more = {"powell": {"tol": 1e-6}, "bounded": {"high": 2.0}, "constrained": {"equal": (lambda x: float(x.sum()) - 10,), "tol": 1e-6}}
    rows_ = [(m, i, round(float(v), 3) + 0.0) for m in ("bfgs", "cg", "newton-cg", "powell", "bounded", "constrained") for i, v in enumerate(minimise(c, x0, m, **more.get(m, {})))]
    return s.createDataFrame(rows_, "name string, i long, y double")


@query("pcg", "select s_suppkey i, round((round(s_acctbal,2) + sum(round(s_acctbal,2)) over w)/(1 + count(*) over w) + 0.000137,3) y from supplier window w as (partition by s_nationkey)")
def pcg_nation(s, d):
    """Solves (I + L) x = balances, L the Laplacian of the graph that joins suppliers of one nation: degrees less
    sums over nations, which are a product of two sparse operators and never pairs of suppliers. Solutions are
    multiples of 0.01 / (1 + a nation's suppliers); the small number keeps them off the middle between two roundings."""
    sup = table(s, d, "supplier")
    b = field(sup, "s_suppkey", F.round("s_acctbal", 2), n=sup.count())
    of = SparseOperator(sup.select(F.col("s_nationkey").cast("long").alias("i"), F.col("s_suppkey").alias("j"), F.lit(1.0).alias("a")))
    sizes = sup.groupBy("s_nationkey").agg((F.count("*") + 1.0).alias("w"))
    degrees = DiagonalOperator(sup.join(sizes, "s_nationkey").select(F.col("s_suppkey").alias("i"), "w"))
    x = pcg(degrees - of.T * of, b, tol=1e-9)["x"]
    return x.df.select("i", F.round(F.col("v") + 0.000137, 3).alias("y"))


@query("lanczos", "select k.k::bigint i, round(2 - 2*cos((k.k+1)*pi()/26),4) w from generate_series(0,24) k(k)")
def lanczos(s, d):
    """Eigenvalues of the second difference over as many points as there are nations, on frames."""
    n = table(s, d, "nation").count()
    v0 = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (1 / (1.0 + F.col("n_nationkey"))).alias("v"))
    values, _ = lanczos_field(StencilOperator({0: 2.0, -1: -1.0, 1: -1.0}, n, symmetric=True), Field(v0, n))
    return s.createDataFrame([(i, round(float(w), 4)) for i, w in enumerate(values)], "i long, w double")
