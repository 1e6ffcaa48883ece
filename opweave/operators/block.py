"""Block operators along the vector axis, slices, and lazily built groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from opweave.expr import Field, Operator, asoperator
from opweave.values import total


def split(n: int, m: int, rank: int | None = None):
    """Near-equal slices of n into m; the first ones are the longer ones."""
    size, more = divmod(n, m)
    out = [slice(r * size + min(r, more), (r + 1) * size + min(r + 1, more)) for r in range(m)]
    return out if rank is None else out[rank]


class BlockOperator(Operator):
    """Base: operands with their ranges of input and output indices."""

    def __init__(self, operands, partitionin, partitionout, **flags):
        self.operands = [asoperator(o) for o in operands]
        self.partitionin, self.partitionout = tuple(partitionin), tuple(partitionout)
        every = lambda k: all(o.flags[k] for o in self.operands)
        super().__init__(shapein=flags.pop("shapein"), shapeout=flags.pop("shapeout"), linear=every("linear"), real=every("real"), name=f"{type(self).__name__.removesuffix('Operator')}({', '.join(map(repr, self.operands))})", **flags)

    @staticmethod
    def _starts(sizes):
        if any(s is None for s in sizes):
            raise ValueError("the blocks' lengths must be known")
        return np.cumsum([0, *sizes]).tolist()

    def _part(self, f: Field, start: int, size: int) -> Field:
        df = f.df.where((F.col("i") >= start) & (F.col("i") < start + size)).withColumn("i", F.col("i") - F.lit(start).cast("long"))
        return replace(f, df=df, n=size)

    @staticmethod
    def _union(fields: list[Field], starts: list[int], n: int) -> Field:
        if any(g.is_complex for g in fields):
            fields = [g.lifted() for g in fields]
        df = None
        for g, s in zip(fields, starts):
            own = g.df.select(*g.keys, (F.col("i") + F.lit(s).cast("long")).alias("i"), "v")
            df = own if df is None else df.unionByName(own)
        return Field(df, n, fields[0].keys, all(g.dense for g in fields))


class _NewAxis(Operator):
    """Base of blocks along an axis of their own: the operands' vectors are told apart by a key (on arrays, by
    the axis before the last)."""

    def __init__(self, operands, key: str, kind: str, linear: bool | None = None):
        self.operands, self.new_axis = [asoperator(o) for o in operands], key
        every = lambda k: all(o.flags[k] for o in self.operands)
        ins, outs = ({getattr(o, n) for o in self.operands if getattr(o, n) is not None} for n in ("shapein", "shapeout"))
        if len(ins) > 1 or len(outs) > 1:
            raise ValueError("blocks along a new axis have one shape")
        super().__init__(shapein=min(ins, default=None), shapeout=min(outs, default=None), linear=every("linear") if linear is None else linear, real=every("real"), name=f"{kind}[{key}]({', '.join(map(repr, self.operands))})")

    def _own(self, f: Field, k: int) -> Field:
        """The vectors of block k, without the key."""
        if self.new_axis not in f.keys:
            raise ValueError(f"the field has no key {self.new_axis}")
        return replace(f, df=f.df.where(F.col(self.new_axis) == k).drop(self.new_axis), keys=tuple(x for x in f.keys if x != self.new_axis))

    def _keyed(self, done: list[Field]) -> Field:
        if any(g.is_complex for g in done):
            done = [g.lifted() for g in done]
        keys, df = (*done[0].keys, self.new_axis), None
        for k, g in enumerate(done):
            own = g.df.withColumn(self.new_axis, F.lit(k).cast("long")).select(*keys, "i", "v")
            df = own if df is None else df.unionByName(own)
        return Field(df, done[0].n, keys, all(g.dense for g in done))


class NewAxisDiagonal(_NewAxis):
    """Block k maps the vectors of key k."""

    def __init__(self, operands, key: str = "block"):
        super().__init__(operands, key, "BlockDiagonal")

    def on_array(self, x):
        return np.stack([o(np.asarray(x)[..., k, :]) for k, o in enumerate(self.operands)], axis=-2)

    def on_field(self, f):
        return self._keyed([o(self._own(f, k)) for k, o in enumerate(self.operands)])

    def conjugate_(self):
        return NewAxisDiagonal([o.C for o in self.operands], self.new_axis)

    def transpose_(self):
        return NewAxisDiagonal([o.T for o in self.operands], self.new_axis)

    def inverse_(self):
        return NewAxisDiagonal([o.I for o in self.operands], self.new_axis)


class NewAxisColumn(_NewAxis):
    """The operands' outputs on one input, keyed."""

    def __init__(self, operands, key: str = "block"):
        super().__init__(operands, key, "BlockColumn")

    def on_array(self, x):
        return np.stack([o(x) for o in self.operands], axis=-2)

    def on_field(self, f):
        return self._keyed([o(f) for o in self.operands])

    def conjugate_(self):
        return NewAxisColumn([o.C for o in self.operands], self.new_axis)

    def transpose_(self):
        return NewAxisRow([o.T for o in self.operands], self.new_axis)


class NewAxisRow(_NewAxis):
    """The sum, or another reduction, over the key of the operands' outputs."""

    def __init__(self, operands, key: str = "block", operation: str = "add"):
        super().__init__(operands, key, "BlockRow", None if operation == "add" else False)
        self.operation = operation

    def on_array(self, x):
        return BlockRowOperator.REDUCE[self.operation][0].reduce([o(np.asarray(x)[..., k, :]) for k, o in enumerate(self.operands)])

    def on_field(self, f):
        done = [o(self._own(f, k)) for k, o in enumerate(self.operands)]
        both = self._keyed(done if self.operation == "add" else [g.densified() for g in done])
        v = total(F.col("v"), both.is_complex) if self.operation == "add" else BlockRowOperator.REDUCE[self.operation][1]("v")
        keys = done[0].keys
        return replace(both, df=both.df.groupBy(*keys, "i").agg(v.alias("v")), keys=keys)

    def conjugate_(self):
        return NewAxisRow([o.C for o in self.operands], self.new_axis, self.operation)

    def transpose_(self):
        return NewAxisColumn([o.T for o in self.operands], self.new_axis) if self.operation == "add" else None


class BlockDiagonalOperator(BlockOperator):
    """Blocks on ranges of the index; with ``new_axis``, on the vectors of a key of that name."""

    def __new__(cls, operands, partitionin=None, new_axis=None):
        return super().__new__(cls) if new_axis is None else NewAxisDiagonal(operands, new_axis)

    def __init__(self, operands, partitionin=None, new_axis=None):
        ops = [asoperator(o) for o in operands]
        sizes = tuple(partitionin or (o.shapein for o in ops))
        outs = [o.shapeout if o.shapeout is not None else s for o, s in zip(ops, sizes)]
        every = lambda k: all(o.flags[k] for o in ops)
        super().__init__(ops, sizes, outs, shapein=sum(sizes), shapeout=sum(outs), **{k: every(k) for k in ("square", "symmetric", "hermitian", "separable", "orthogonal")})

    def on_array(self, x):
        s = self._starts(self.partitionin)
        return np.concatenate([o(x[..., a:b]) for o, a, b in zip(self.operands, s, s[1:])], axis=-1)

    def on_column(self, c, index=None):
        """Element-wise blocks: one CASE over the index ranges."""
        s, out = self._starts(self.partitionin), None
        for o, a, b in zip(self.operands, s, s[1:]):
            own = o.on_column(c, index - a if index is not None else None)
            out = F.when(index < b, own) if out is None else out.when(index < b, own)
        return out

    def on_field(self, f):
        if self.separable and self.real and not f.is_complex:
            return Operator.on_field(self, f)
        s = self._starts(self.partitionin)
        return self._union([o(self._part(f, a, n)) for o, a, n in zip(self.operands, s, self.partitionin)], self._starts(self.partitionout), self.shapeout)

    def conjugate_(self):
        return BlockDiagonalOperator([o.C for o in self.operands], self.partitionin)

    def transpose_(self):
        return BlockDiagonalOperator([o.T for o in self.operands], self.partitionout)

    def inverse_(self):
        return BlockDiagonalOperator([o.I for o in self.operands], self.partitionout)


class BlockColumnOperator(BlockOperator):
    """The operands' outputs on one input, stacked; with ``new_axis``, keyed by a column of that name."""

    def __new__(cls, operands, partitionout=None, n=None, new_axis=None):
        return super().__new__(cls) if new_axis is None else NewAxisColumn(operands, new_axis)

    def __init__(self, operands, partitionout=None, n=None, new_axis=None):
        ops = [asoperator(o) for o in operands]
        n = n if n is not None else next((o.shapein for o in ops if o.shapein is not None), None)
        outs = list(partitionout or (o.shapeout if o.shapeout is not None else n for o in ops))
        super().__init__(ops, [n], outs, shapein=n, shapeout=sum(outs) if None not in outs else None)

    def on_array(self, x):
        return np.concatenate([o(x) for o in self.operands], axis=-1)

    def on_field(self, f):
        sizes = [s if s is not None else f.n for s in self.partitionout]
        return self._union([o(f) for o in self.operands], self._starts(sizes), sum(sizes))

    def conjugate_(self):
        return BlockColumnOperator([o.C for o in self.operands], self.partitionout, self.shapein)

    def transpose_(self):
        return BlockRowOperator([o.T for o in self.operands], self.partitionout)


class BlockRowOperator(BlockOperator):
    """The sum, or another reduction, of the operands' outputs on parts of the input; with ``new_axis``, on the
    vectors of a key of that name."""

    REDUCE = {"add": (np.add, F.sum), "multiply": (np.multiply, F.product), "maximum": (np.maximum, F.max), "minimum": (np.minimum, F.min)}

    def __new__(cls, operands, partitionin=None, operation="add", new_axis=None):
        return super().__new__(cls) if new_axis is None else NewAxisRow(operands, new_axis, operation)

    def __init__(self, operands, partitionin=None, operation: str = "add", new_axis=None):
        ops = [asoperator(o) for o in operands]
        sizes = list(partitionin or (o.shapein for o in ops))
        n = next((o.shapeout for o in ops if o.shapeout is not None), sizes[0])
        super().__init__(ops, sizes, [n], shapein=sum(sizes) if None not in sizes else None, shapeout=n)
        self.operation = operation
        if operation != "add":
            self.flags["linear"] = False

    def on_array(self, x):
        s = self._starts(self.partitionin)
        return self.REDUCE[self.operation][0].reduce([o(x[..., a:b]) for o, a, b in zip(self.operands, s, s[1:])])

    def on_field(self, f):
        s = self._starts(self.partitionin)
        done = [o(self._part(f, a, n)) for o, a, n in zip(self.operands, s, self.partitionin)]
        if self.operation != "add":
            done = [g.densified() for g in done]
        both = self._union(done, [0] * len(done), self.shapeout)
        v = total(F.col("v"), both.is_complex) if self.operation == "add" else self.REDUCE[self.operation][1]("v")
        return replace(both, df=both.df.groupBy(*f.keys, "i").agg(v.alias("v")))

    def conjugate_(self):
        return BlockRowOperator([o.C for o in self.operands], self.partitionin, self.operation)

    def transpose_(self):
        return BlockColumnOperator([o.T for o in self.operands], self.partitionin) if self.operation == "add" else None


def _covered(s: slice, n: int | None) -> range:
    """The indices of a slice. Bounds that count from the end, and steps back, need the vectors' length."""
    if n is not None:
        return range(*s.indices(n))
    start, stop, step = s.start or 0, s.stop, 1 if s.step is None else s.step
    if start < 0 or step <= 0 or (stop is not None and stop < 0):
        raise ValueError(f"{s} needs the vectors' length")
    return range(start, 1 << 62 if stop is None else stop, step)


class BlockSliceOperator(Operator):
    """The input, with op_k applied in place to slice_k; what no slice covers stays. Slices don't overlap."""

    def __init__(self, operands, slices: list[slice], n: int | None = None):
        self.operands, self.slices = [asoperator(o) for o in operands], slices
        every = lambda k: all(o.flags[k] for o in self.operands)
        super().__init__(shapein=n, square=True, name="BlockSlice", **{k: every(k) for k in ("linear", "real", "symmetric", "separable")})

    def on_array(self, x):
        out = np.array(x, np.result_type(x, float))
        for o, s in zip(self.operands, self.slices):
            got = o(x[..., s])
            out = out.astype(np.result_type(out, got), copy=False)
            out[..., s] = got
        return out

    @staticmethod
    def _inside(r: range, i):
        """Whether an index is in a slice, and its place there."""
        if not len(range(r.start, r.stop, r.step)[:1]):
            return F.lit(False), i
        low, high = (r.start, r.stop - 1) if r.step > 0 else (r.stop + 1, r.start)
        return (i >= low) & (i <= high) & (F.pmod(i - r.start, F.lit(abs(r.step))) == 0), F.floor((i - r.start) / F.lit(r.step)).cast("long")

    def on_column(self, c, index=None, n=None):
        out = c
        for o, s in zip(self.operands, self.slices):
            inside, place = self._inside(_covered(s, n or self.shapein), index)
            out = F.when(inside, o.on_column(c, place)).otherwise(out)
        return out

    def on_field(self, f):
        n = self.shapein or f.n
        if self.separable and self.real and not f.is_complex:
            f = f if self.linear else f.densified()
            return f.values(self.on_column(F.col("v"), F.col("i"), n))
        left, done = F.lit(True), []
        for o, s in zip(self.operands, self.slices):
            r = _covered(s, n)
            inside, place = self._inside(r, F.col("i"))
            left = left & ~inside
            part = o(replace(f, df=f.df.where(inside).withColumn("i", place), n=len(r) if n is not None else None))
            if o.shapeout is not None and o.shapein != o.shapeout:
                raise ValueError(f"{o.name} changes the length of a slice")
            done.append(replace(part, df=part.df.withColumn("i", F.col("i") * r.step + r.start)))
        rest = replace(f, df=f.df.where(left))
        return replace(BlockOperator._union([rest, *done], [0] * (len(done) + 1), n), dense=f.dense and all(g.dense for g in done))

    def conjugate_(self):
        return BlockSliceOperator([o.C for o in self.operands], self.slices, self.shapein)

    def transpose_(self):
        return BlockSliceOperator([o.T for o in self.operands], self.slices, self.shapein)


class ProxyOperator(Operator):
    """One of a group of operators that are built when first needed; the group keeps the latest one only."""

    def __init__(self, number: int, callback: Callable[[int], Operator], slot: dict, kind: str = "", **shape):
        super().__init__(linear=True, name=f"proxy[{number}]{kind}", **shape)
        self.number, self.callback, self.slot, self.kind = number, callback, slot, kind

    def built(self) -> Operator:
        if self.slot.get("number") != self.number:
            self.slot.update(number=self.number, operator=self.callback(self.number))
        op = self.slot["operator"]
        for k in self.kind:
            op = getattr(op, k)
        return op

    def on_array(self, x):
        return self.built()(x)

    def on_field(self, f):
        return self.built()(f)

    def _as(self, kind):
        return ProxyOperator(self.number, self.callback, self.slot, self.kind + kind)

    def conjugate_(self):
        return self._as("C")

    def transpose_(self):
        return self._as("T")

    def inverse_(self):
        return self._as("I")


def proxy_group(n: int, callback: Callable[[int], Operator]) -> list[ProxyOperator]:
    slot: dict = {}
    return [ProxyOperator(i, callback, slot) for i in range(n)]


class DistributionGlobalOperator(Operator):
    """The vector dealt out by ranges of its index; transposed, gathered again. In a DataFrame both are the rows themselves."""

    def __init__(self, n: int, parts: int):
        super().__init__(shapein=n, shapeout=n, linear=True, orthogonal=True, name="Distribution")
        self.parts = parts

    def on_array(self, x):
        return x

    def on_field(self, f):
        return replace(f, df=f.df.repartitionByRange(self.parts, "i"))

    def transpose_(self):
        return DistributionGlobalOperator(self.shapein, self.parts)


class DistributionIdentityOperator(Operator):
    """A copy for each of ``parts`` (key ``part``); transposed, the sum over copies."""

    def __init__(self, parts: int, n: int | None = None):
        super().__init__(shapein=n, shapeout=n, linear=True, name="Copies")
        self.parts = parts

    def on_array(self, x):
        return np.repeat(np.asarray(x)[None], self.parts, axis=0)

    def on_field(self, f):
        return replace(f, df=f.df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))), keys=(*f.keys, "part"))

    def transpose_(self):
        return SumOfCopies(self)


class SumOfCopies(Operator):
    def __init__(self, of: DistributionIdentityOperator):
        super().__init__(shapein=of.shapeout, shapeout=of.shapein, linear=True, name="Copies.T")
        self.of = of

    def on_array(self, x):
        return np.asarray(x).sum(axis=0)

    def on_field(self, f):
        keys = tuple(k for k in f.keys if k != "part")
        return replace(f, df=f.df.groupBy(*keys, "i").agg(total(F.col("v"), f.is_complex).alias("v")), keys=keys)

    def transpose_(self):
        return self.of
