"""Named queries over the driver's tables and their SQL counterparts.

Each applies operators of the algebra to whole tables. Inexact doubles are rounded, and ``+ 0.0`` removes
negative zeros, so that both engines' values can be compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from opweave.expr import Field, Operator, asoperator, multiply
from opweave.operators.block import BlockColumnOperator, BlockDiagonalOperator, BlockRowOperator, BlockSliceOperator, DistributionIdentityOperator
from opweave.operators.coords import Cartesian2SphericalOperator, Spherical2CartesianOperator
from opweave.operators.dense import DenseBlockDiagonalOperator, DenseOperator, Rotation2dOperator, Rotation3dOperator
from opweave.operators.diagonal import ByColumnOperator, DiagonalOperator, HomothetyOperator, IdentityOperator, MaskOperator, PackOperator, UnpackOperator, ZeroOperator
from opweave.operators.elementwise import ClipOperator, DegreesOperator, HardThresholdingOperator, MaximumOperator, MinimumOperator, NormalizeOperator, NumexprOperator, PowerOperator, RadiansOperator, ReciprocalOperator, RoundOperator, SoftThresholdingOperator, SqrtOperator, To1dOperator, ToNdOperator, UfuncOperator
from opweave.operators.reduce import MaxOperator, MinMaxOperator, MinOperator, ProductOperator, ReductionOperator
from opweave.operators.sparse import DifferenceOperator, SparseOperator, StencilOperator, SumOperator, trapeze
from opweave.operators.transform import ConvolutionNdOperator, ConvolutionOperator, FFTOperator, Wavelet2dOperator, WaveletOperator
from opweave.plans import field, rows
from opweave.registry import ORACLES, QUERIES, query  # noqa: F401
from opweave.session import table
from opweave.solvers.criteria import Huber, Norm2, Normp
from opweave.values import rounded

LINE = ["l_orderkey", "l_linenumber"]


def _line(name: str, op: Operator, sql: str, value: str = "l_quantity", out: str = "y"):
    """An element-wise operator on a column of lineitem."""
    query(name, sql)(lambda s, d: table(s, d, "lineitem").select(*LINE, op.on_column(F.col(value)).alias(out)))


def _event(name: str, op: Operator, y: str, digits: int | None = 4, value="value"):
    """An element-wise operator on the values of events; y is its SQL."""

    def run(s, d):
        v = op.on_column(F.expr(value), F.col("event_id")) + F.lit(0.0)
        return table(s, d, "events").select("event_id", (rounded(v, digits) if digits is not None else v).alias("y"))

    query(name, f"select event_id, {f'round({y}, {digits})' if digits is not None else y} as y from events")(run)


def _events(s, d, n: bool = False) -> Field:
    t = table(s, d, "events")
    return field(t, "event_id", "value", n=t.count() if n else None)


_line("identity", IdentityOperator(), "select l_orderkey, l_linenumber, l_quantity from lineitem", out="l_quantity")
_line("homothety", HomothetyOperator(2) * HomothetyOperator(3), "select l_orderkey, l_linenumber, 6.0::double*l_quantity as y from lineitem")
_line("addition", 2 * IdentityOperator() + ByColumnOperator("l_linenumber"), "select l_orderkey, l_linenumber, 2*l_quantity + (l_linenumber*l_quantity) as y from lineitem")
_line("multiplication", multiply(IdentityOperator(), IdentityOperator()), "select l_orderkey, l_linenumber, l_quantity*l_quantity as y from lineitem")
_line("zero", ZeroOperator(), "select l_orderkey, l_linenumber, 0.0::double as y from lineitem")
_line("constant_sum", asoperator(np.square) + 5.0, "select l_orderkey, l_linenumber, l_quantity*l_quantity + 5.0::double as y from lineitem")
_line("mask", MaskOperator("l_returnflag = 'R'"), "select l_orderkey, l_linenumber, case when l_returnflag='R' then 0.0::double else l_quantity end as y from lineitem")
_event("clip", ClipOperator(10, 100), "least(greatest(value,10.0::double),100.0::double)", None)
_event("maximum", MaximumOperator(50), "greatest(value, 50.0::double)", None)
_event("minimum", MinimumOperator(50), "least(value, 50.0::double)", None)
_event("hard_threshold", HardThresholdingOperator(50)(HardThresholdingOperator(20)), "case when abs(value)>50 then value else 0.0::double end", None)
_event("soft_threshold", SoftThresholdingOperator(50), "sign(value-60)*greatest(abs(value-60)-50,0)+0.0::double", value="value - 60")
_event("round_rhte", RoundOperator("rhte"), "round_even(value,0)::double", None)
_event("round_rtz", RoundOperator("rtz"), "trunc(value-60) + 0.0::double", None, "value - 60")
_event("round_rtmi", RoundOperator("rtmi"), "floor(value-60)::double + 0.0::double", None, "value - 60")
_event("round_rtpi", RoundOperator("rtpi"), "ceil(value-60)::double + 0.0::double", None, "value - 60")
_event("round_rhtmi", RoundOperator("rhtmi"), "ceil(value*2 - 0.5)::double + 0.0::double", None, "value * 2")
_event("round_rhtpi", RoundOperator("rhtpi"), "floor(value*2 + 0.5)::double + 0.0::double", None, "value * 2")
_event("power_rules", PowerOperator(2.5), "pow(value,2.5::double)", 2)
_event("reciprocal", ReciprocalOperator(), "1/value", 6)
_event("sqrt", SqrtOperator(), "sqrt(value)", 6)
_event("degrees", DegreesOperator(), "degrees(value/1000)", 6, "value / 1000")
_event("radians_degrees", RadiansOperator() * DegreesOperator().I, "radians(radians(value))", 8)
_event("ufunc_log", UfuncOperator("log"), "ln(value)", 6)
_event("numexpr", NumexprOperator("3 * input * input + sin(input)"), "3*value*value + sin(value)", 3)
_event("block_slice", BlockSliceOperator([HomothetyOperator(3)], [slice(0, None, 2)]), "case when event_id%2=0 then 3*value else value end", None)


@query("division", "select event_id, round((value*value)/(value+1), 6) as y from events")
def division(s, d):
    op = asoperator(np.square) / (PowerOperator(1) + 1.0)
    return table(s, d, "events").select("event_id", rounded(op.on_column(F.col("value")), 6).alias("y"))


@query("diagonal_join", "select l_orderkey, l_linenumber, l_quantity*(1+s_nationkey) as y from lineitem join supplier on l_suppkey=s_suppkey")
def diagonal_join(s, d):
    weights = table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), (1.0 + F.col("s_nationkey")).alias("w"))
    x = field(table(s, d, "lineitem"), "l_suppkey", "l_quantity", LINE)
    return DiagonalOperator(weights)(x).df.select(*LINE, F.col("v").alias("y"))


@query("diagonal_numbers", "select event_id, round(value*(case when event_id < 3 then event_id + 1 else 1 end), 4) as y from events")
def diagonal_numbers(s, d):
    op = BlockSliceOperator([DiagonalOperator([1, 2, 3])], [slice(0, 3)])
    return op(_events(s, d)).df.select(F.col("i").alias("event_id"), F.round("v", 4).alias("y"))


@query("pack", "select (row_number() over (order by event_id)-1)::bigint as i, value from events where event_type='click'")
def pack(s, d):
    x = Field(table(s, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"), "event_type"))
    return PackOperator("event_type = 'click'")(x).df.select("i", F.col("v").alias("value"))


@query("unpack", "select event_id, case when event_type='click' then value else 0.0::double end as y from events")
def unpack(s, d):
    """What Pack kept goes back to its places; zero elsewhere."""
    t = table(s, d, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"), "event_type")
    n = t.count()
    packed = PackOperator("event_type = 'click'")(Field(t)).df.select("i", "v")
    return UnpackOperator("event_type = 'click'", n, t)(Field(packed)).densified().df.select(F.col("i").alias("event_id"), F.col("v").alias("y"))


@query("sum_axis", "select l_orderkey, sum(l_quantity) as y from lineitem group by 1")
def sum_axis(s, d):
    return SumOperator()(field(table(s, d, "lineitem"), "l_linenumber", "l_quantity", ["l_orderkey"])).df.select("l_orderkey", F.col("v").alias("y"))


@query("minmax_axis", "select l_suppkey, min(l_extendedprice) as mn, max(l_extendedprice) as mx from lineitem group by 1")
def minmax_axis(s, d):
    y = MinMaxOperator()(field(table(s, d, "lineitem"), "l_linenumber", "l_extendedprice", ["l_suppkey"])).df
    return y.groupBy("l_suppkey").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("mn"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("mx"))


def _axis(name: str, op: Operator, sql: str, value="l_extendedprice", digits: int | None = None):
    def run(s, d):
        y = op(field(table(s, d, "lineitem"), "l_linenumber", F.expr(value), ["l_orderkey"])).df
        return y.select("l_orderkey", (F.round("v", digits) if digits is not None else F.col("v")).alias("y"))

    query(name, f"select l_orderkey, {f'round({sql}, {digits})' if digits is not None else sql} as y from lineitem group by 1")(run)


_axis("product_axis", ProductOperator(), "product(1+l_discount)", "1 + l_discount", 6)
_axis("max_axis", MaxOperator(), "max(l_extendedprice)")
_axis("min_axis", MinOperator(), "min(l_extendedprice)")
_axis("mean_axis", ReductionOperator("mean"), "avg(l_extendedprice)", digits=7)


@query("difference", "select event_id, d as y from (select event_id, round(lead(value) over (order by event_id)-value,4) d from events) where d is not null")
def difference(s, d):
    x = _events(s, d, n=True)
    return DifferenceOperator(x.n)(x).df.select(F.col("i").alias("event_id"), F.round("v", 4).alias("y"))


@query("difference_transposed", "select event_id, round(coalesce(lag(value) over w, 0) - value, 4) as y from (select * from events where event_id < (select max(event_id) from events)) window w as (order by event_id) union all select event_id + 1, round(value, 4) from events where event_id = (select max(event_id) from events) - 1")
def difference_transposed(s, d):
    x = _events(s, d, n=True)
    y = StencilOperator({0: -1.0, -1: 1.0}, x.n)(Field(x.df.where(F.col("i") < x.n - 1), x.n, dense=False))
    return y.df.select(F.col("i").alias("event_id"), F.round("v", 4).alias("y"))


@query("trapeze_by_user", "select user_id, round(sum(0.5*(x2-event_id)*(value+v2)),4) as y from (select user_id,event_id,value,lead(event_id) over w x2,lead(value) over w v2 from events window w as (partition by user_id order by event_id)) where x2 is not null group by 1")
def trapeze_by_user(s, d):
    return trapeze(table(s, d, "events"), ["user_id"], "event_id", "value").select("user_id", F.round("v", 4).alias("y"))


@query("stencil", "select event_id, round(2*value - coalesce(lag(value) over w,0) - coalesce(lead(value) over w,0),4) as y from events window w as (order by event_id)")
def stencil(s, d):
    x = _events(s, d, n=True)
    return StencilOperator({0: 2.0, -1: -1.0, 1: -1.0}, x.n, symmetric=True)(x).df.select(F.col("i").alias("event_id"), F.round("v", 4).alias("y"))


@query("convolution_circ", "with n as (select count(*) n from events), e as (select (row_number() over (order by event_id)-1) i, value v from events), k(o,w) as (values (-1,1.0::double),(0,1.0::double),(1,0.5::double)) select ((e.i+k.o+n.n)%n.n)::bigint i, round(sum(e.v*k.w),4) y from e,k,n group by 1")
def convolution_circ(s, d):
    x = _events(s, d, n=True)
    return ConvolutionOperator([1, 1, 0.5], x.n)(x).df.select("i", F.round("v", 4).alias("y"))


@query("dense_rows", "select vec_id, m.r::bigint as r, round(sum(e.embedding[g.j]::double*(case m.r when 0 then g.j else 64-g.j end)),4) y from embeddings e, generate_series(1,64) g(j), (values (0),(1)) m(r) group by 1,2")
def dense_rows(s, d):
    j = np.arange(1, 65)
    y = DenseOperator(np.array([j, 64 - j])).on_column(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.posexplode(y).alias("r", "y")).select("vec_id", F.col("r").cast("long").alias("r"), F.round("y", 4).alias("y"))


@query("dense_field", "select vec_id, round(sum(e.embedding[g.j]::double*g.j),4) y from embeddings e, generate_series(1,64) g(j) group by 1")
def dense_field(s, d):
    y = DenseOperator(np.arange(1, 65)[None])(rows(table(s, d, "embeddings"), "embedding", "vec_id", 64))
    return y.df.select("vec_id", F.round("v", 4).alias("y"))


@query("dense_blocks", "select vec_id, b.b::bigint as block, round(sum(e.embedding[g.j]::double*(b.b+1)*g.j),4) y from embeddings e, generate_series(1,64) g(j), (values (0),(1),(2)) b(b) group by 1,2")
def dense_blocks(s, d):
    op = DenseBlockDiagonalOperator(np.arange(1, 4)[:, None, None] * np.arange(1, 65)[None, None])
    return op(rows(table(s, d, "embeddings"), "embedding", "vec_id", 64)).df.select("vec_id", "block", F.round("v", 4).alias("y"))


def _orders(s, d) -> SparseOperator:
    return SparseOperator(table(s, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("a")))


@query("sparse_matvec", "select l_orderkey, round(sum(l_quantity*s_acctbal),2) y from lineitem join supplier on l_suppkey=s_suppkey group by 1")
def sparse_matvec(s, d):
    y = _orders(s, d)(field(table(s, d, "supplier"), "s_suppkey", "s_acctbal"))
    return y.df.select(F.col("i").alias("l_orderkey"), F.round("v", 2).alias("y"))


@query("sparse_transpose", "select l_suppkey, round(sum(l_quantity*o_totalprice),0) y from lineitem join orders on l_orderkey=o_orderkey group by 1")
def sparse_transpose(s, d):
    y = _orders(s, d).T(field(table(s, d, "orders"), "o_orderkey", "o_totalprice"))
    return y.df.select(F.col("i").alias("l_suppkey"), F.round("v", 0).alias("y"))


@query("normalize", "select vec_id, g.j::int j, round(e.embedding[g.j]::double/n.nrm,6) y from embeddings e join (select vec_id id, sqrt(sum(embedding[j]::double*embedding[j]::double)) nrm from embeddings, generate_series(1,64) t(j) group by 1) n on n.id=vec_id, generate_series(1,64) g(j)")
def normalize(s, d):
    y = NormalizeOperator().on_column(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.posexplode(y).alias("j", "y")).select("vec_id", (F.col("j") + 1).alias("j"), F.round("y", 6).alias("y"))


@query("block_column", "select c_custkey i, c_acctbal y from customer union all select c_custkey+(select max(c_custkey) from customer)+1, 2*c_acctbal from customer")
def block_column(s, d):
    t = table(s, d, "customer")
    x = field(t, "c_custkey", "c_acctbal", n=t.count())
    return BlockColumnOperator([IdentityOperator(), HomothetyOperator(2)])(x).df.select("i", F.col("v").alias("y"))


@query("block_diagonal", "select c_custkey i, case when c_custkey < (select count(*)//2 from customer) then c_acctbal else 2*c_acctbal end y from customer")
def block_diagonal(s, d):
    t = table(s, d, "customer")
    n = t.count()
    op = BlockDiagonalOperator([IdentityOperator(), HomothetyOperator(2)], [n // 2, n - n // 2])
    return op(field(t, "c_custkey", "c_acctbal", n=n)).df.select("i", F.col("v").alias("y"))


@query("copies_transposed", "select event_id, round(3*value, 4) as y from events")
def copies_transposed(s, d):
    op = DistributionIdentityOperator(3)
    return op.T(op(_events(s, d))).df.select(F.col("i").alias("event_id"), F.round("v", 4).alias("y"))


@query("rotation2d", "select l_orderkey,l_linenumber, round(cos(radians(30))*l_quantity - sin(radians(30))*l_tax,6) y0, round(sin(radians(30))*l_quantity + cos(radians(30))*l_tax,6) y1 from lineitem")
def rotation2d(s, d):
    a, b = Rotation2dOperator(30, degrees=True).on_columns(F.col("l_quantity"), F.col("l_tax"))
    return table(s, d, "lineitem").select(*LINE, F.round(a, 6).alias("y0"), F.round(b, 6).alias("y1"))


@query("rotation3d", "select l_orderkey,l_linenumber, round(cos(0.3)*l_quantity - sin(0.3)*l_tax,6) x, round(cos(0.2)*(sin(0.3)*l_quantity+cos(0.3)*l_tax) - sin(0.2)*l_discount,6) y, round(sin(0.2)*(sin(0.3)*l_quantity+cos(0.3)*l_tax) + cos(0.2)*l_discount,6) z from lineitem")
def rotation3d(s, d):
    cs = Rotation3dOperator("X'Z''", 0.2, 0.3).on_columns(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"))
    return table(s, d, "lineitem").select(*LINE, *(F.round(c, 6).alias(n) for c, n in zip(cs, "xyz")))


@query("sph2cart", "select event_id, round(sin(value/100)*cos(value/50),6) x, round(sin(value/100)*sin(value/50),6) y, round(cos(value/100),6) z from events")
def sph2cart(s, d):
    cs = Spherical2CartesianOperator("zenith,azimuth").on_columns(F.col("value") / 100, F.col("value") / 50)
    return table(s, d, "events").select("event_id", *(F.round(c, 6).alias(n) for c, n in zip(cs, "xyz")))


@query("cart2sph", "select event_id, round(acos(cos(value/200)),6) zenith, round(case when atan2(sin(value/50),cos(value/50))<0 then atan2(sin(value/50),cos(value/50))+2*pi() else atan2(sin(value/50),cos(value/50)) end,6) azimuth from events")
def cart2sph(s, d):
    v = F.col("value")
    a, b = Cartesian2SphericalOperator("zenith,azimuth").on_columns(F.cos(v / 50), F.sin(v / 50), F.cos(v / 200))
    return table(s, d, "events").select("event_id", F.round(a, 6).alias("zenith"), F.round(b, 6).alias("azimuth"))


@query("tonD", "select event_id, (event_id//100)%100 i0, event_id%100 i1 from events")
def to_nd(s, d):
    y = ToNdOperator((100, 100)).on_column(F.col("event_id"))
    return table(s, d, "events").select("event_id", y[0].alias("i0"), y[1].alias("i1"))


@query("to1d", "select event_id, user_id*7 + event_id%7 as i from events")
def to_1d(s, d):
    y = To1dOperator((1000, 7)).on_column(F.array(F.col("user_id"), F.col("event_id") % 7))
    return table(s, d, "events").select("event_id", y.alias("i"))


@query("norm2", "select round(sum(value*value),2) y from events")
def norm2(s, d):
    return table(s, d, "events").agg(F.round(F.sum(Norm2().column(F.col("value"))), 2).alias("y"))


@query("huber", "select round(sum(case when abs(value)<50 then value*value else 2*50*abs(value)-50*50 end),2) y from events")
def huber(s, d):
    return table(s, d, "events").agg(F.round(F.sum(Huber(50).column(F.col("value"))), 2).alias("y"))


@query("normp", "select round(sum(pow(abs(value),1.5)),2) y from events")
def normp(s, d):
    return table(s, d, "events").agg(F.round(F.sum(Normp(1.5).column(F.col("value"))), 2).alias("y"))


@query("wavelet_haar", "select vec_id, (g.j-1)::bigint i, round(case when g.j<=32 then (e.embedding[2*g.j-1]::double+e.embedding[2*g.j]::double)/sqrt(2) else (e.embedding[2*g.j-65]::double-e.embedding[2*g.j-64]::double)/sqrt(2) end,6) y from embeddings e, generate_series(1,64) g(j)")
def wavelet_haar(s, d):
    y = WaveletOperator("haar", 64)(rows(table(s, d, "embeddings"), "embedding", "vec_id", 64))
    return y.df.select("vec_id", "i", F.round("v", 6).alias("y"))


@query("fft_rows", "select vec_id, (k.k)::bigint i, round(sum(e.embedding[g.j]::double*cos(2*pi()*k.k*(g.j-1)/64)),5) re, round(sum(-e.embedding[g.j]::double*sin(2*pi()*k.k*(g.j-1)/64)),5) im from embeddings e, generate_series(1,64) g(j), generate_series(0,63) k(k) group by 1,2")
def fft_rows(s, d):
    y = FFTOperator(64)(rows(table(s, d, "embeddings"), "embedding", "vec_id", 64))
    return y.df.select("vec_id", "i", F.round("v.re", 5).alias("re"), F.round("v.im", 5).alias("im"))


@query("wavelet_2d", """select vec_id, (8*(4*a.a+p.p)+4*b.b+q.q)::bigint i, round((e.embedding[16*p.p+2*q.q+1]::double + (1-2*b.b)*e.embedding[16*p.p+2*q.q+2]::double
    + (1-2*a.a)*(e.embedding[16*p.p+2*q.q+9]::double + (1-2*b.b)*e.embedding[16*p.p+2*q.q+10]::double))/2,6)+0.0::double y
    from embeddings e, (values (0),(1)) a(a), (values (0),(1)) b(b), generate_series(0,3) p(p), generate_series(0,3) q(q)""")
def wavelet_2d(s, d):
    """Embeddings as arrays of 8 by 8."""
    y = Wavelet2dOperator("haar", (8, 8))(rows(table(s, d, "embeddings"), "embedding", "vec_id", 64))
    return y.df.select("vec_id", "i", (F.round("v", 6) + 0.0).alias("y"))


@query("convolution_2d", """with k(o0,o1,w) as (values (-1,0,1.0::double),(0,0,2.0::double),(0,1,-1.0::double),(1,1,0.5::double))
    select vec_id, (8*((g.j//8+k.o0+8)%8)+(g.j%8+k.o1+8)%8)::bigint i, round(sum(k.w*e.embedding[g.j+1]::double),5)+0.0::double y from embeddings e, generate_series(0,63) g(j), k group by 1,2""")
def convolution_2d(s, d):
    """Embeddings as arrays of 8 by 8."""
    op = ConvolutionNdOperator([[0, 1, 0], [0, 2, -1], [0, 0, 0.5]], (8, 8))
    return op(rows(table(s, d, "embeddings"), "embedding", "vec_id", 64)).df.select("vec_id", "i", (F.round("v", 5) + 0.0).alias("y"))


@query("block_row", """with n as (select count(*) n from customer) select c_custkey % ((n.n+1)//2) i, sum(case when c_custkey < (n.n+1)//2 then c_acctbal else 2*c_acctbal end) y from customer, n group by 1""")
def block_row(s, d):
    """Two halves on top of each other; of an odd number of customers the second half is filled up by a zero."""
    t = table(s, d, "customer")
    half = (t.count() + 1) // 2
    op = BlockRowOperator([IdentityOperator(), HomothetyOperator(2)], [half, half])
    return op(field(t, "c_custkey", "c_acctbal")).df.select("i", F.col("v").alias("y"))


import opweave.array_queries  # noqa: E402, F401  registers its queries
