"""Identity, scaling, constants, diagonals, masks, packing and reshaping."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opweave.expr import Field, Operator
from opweave.values import complex_, ddl, is_complex, literal, literals, row_values, times

#: A diagonal with at most so many elements travels in the expression; a longer one is joined.
MOST_LITERAL = 4096


def at_index(data: np.ndarray, index: Column | None) -> Column:
    """data[index] as an expression."""
    if data.ndim == 0 or data.size == 1:
        return F.lit(data.ravel()[0].item())
    if index is None:
        raise ValueError("an element-wise operator with data needs an index column")
    return F.get(F.lit(data.tolist()), index.cast("int"))


BROADCASTS = ("disabled", "leftward", "rightward", "scalar")


def spread(m: int, n: int | None, index: Column, broadcast: str) -> Column:
    """The place, in data of length m, of an element of a vector of length n: data holds the fast axes and is
    repeated along slow ones (leftward), or holds the slow axes and each element counts for a run (rightward)."""
    if broadcast == "leftward":
        return F.pmod(index, F.lit(m))
    if broadcast == "rightward":
        if n is None or n % m:
            raise ValueError(f"vectors must have a known length that is a multiple of {m}")
        return F.floor(index / F.lit(n // m))
    return index


def spread_array(data: np.ndarray, n: int, broadcast: str) -> np.ndarray:
    m = data.shape[-1] if data.ndim else 1
    if data.ndim == 0 or broadcast not in ("leftward", "rightward") or n == m:
        return data
    if n % m:
        raise ValueError(f"vectors must have a length that is a multiple of {m}, not {n}")
    return np.tile(data, n // m) if broadcast == "leftward" else np.repeat(data, n // m, axis=-1)


def checked_broadcast(broadcast: str) -> str:
    if broadcast not in BROADCASTS:
        raise ValueError(f"no broadcast {broadcast!r}; there are {', '.join(BROADCASTS)}")
    return broadcast


def condition(c: Column | str) -> Column:
    """A column, or an expression string, which needs no session before it is used."""
    return F.expr(c) if isinstance(c, str) else c


def joined(f: Field, data: np.ndarray | DataFrame, name: str = "w", broadcast: str = "disabled") -> DataFrame:
    """f.df with data's element for each row; a DataFrame (i, w) is joined on i, by what strategy Spark finds best."""
    if isinstance(data, DataFrame):
        return f.df.join(data.select("i", F.col("w").alias(name)), "i")
    at = spread(data.size, f.n, F.col("i"), broadcast)
    if data.size <= MOST_LITERAL:
        return f.df.withColumn(name, literals(data, at))
    rows = f.df.sparkSession.createDataFrame([(i, row_values(x)) for i, x in enumerate(data)], f"_at long, {name} {ddl(data)}")
    return f.df.withColumn("_at", at.cast("long")).join(rows, "_at").drop("_at")


class IdentityOperator(Operator):
    def __init__(self, shapein=None):
        super().__init__(shapein=shapein, linear=True, square=True, symmetric=True, idempotent=True, involutary=True, orthogonal=True, separable=True)
        self.name = "I"

    def on_array(self, x):
        return x

    def on_column(self, c, index=None):
        return c

    def on_field(self, f):
        return f

    @property
    def I(self):  # noqa: E743
        return self


class CopyOperator(IdentityOperator):
    """A projection that copies; the identity in a world without in-place work."""

    def on_array(self, x):
        return np.array(x)


class HomothetyOperator(Operator):
    def __init__(self, data, shapein=None):
        a = np.asarray(data)
        if a.size != 1 and not (a == a.ravel()[0]).all():
            raise ValueError("a homothety has one value")
        value = a.ravel()[0].item()
        super().__init__(shapein=shapein, linear=True, square=True, real=not isinstance(value, complex), symmetric=True, separable=True, name=f"{value:g}I" if not isinstance(value, complex) else f"{value}I")
        self.value = value

    def on_array(self, x):
        return self.value * x

    def on_column(self, c, index=None):
        return F.lit(float(self.value)) * c

    def on_field(self, f):
        return super().on_field(f) if self.real else f.values(times(literal(self.value, True), F.col("v"), True, f.is_complex))

    def conjugate_(self):
        return self if self.real else HomothetyOperator(np.conjugate(self.value).item(), self.shapein)

    def inverse_(self):
        return HomothetyOperator(1 / self.value if self.value else float("nan"), self.shapein)


class ZeroOperator(Operator):
    def __init__(self, shapein=None, shapeout=None):
        super().__init__(shapein=shapein, shapeout=shapeout, linear=True, separable=True, symmetric=shapein == shapeout, name="0")

    def on_array(self, x):
        return np.zeros((*x.shape[:-1], self.shapeout)) if self.shapeout is not None else np.zeros_like(x)

    def on_column(self, c, index=None):
        return F.lit(0.0)

    def transpose_(self):
        return ZeroOperator(self.shapeout, self.shapein)


class ConstantOperator(Operator):
    """data, whatever it is applied to; ``broadcast`` says how data shorter than a vector is spread over it."""

    def __init__(self, data, broadcast: str = "disabled"):
        data, self.broadcast = np.asarray(data), checked_broadcast(broadcast)
        if data.size > 1 and (data == data.ravel()[0]).all():
            n, data = data.shape[-1], data.ravel()[0]
        else:
            n = data.shape[-1] if data.ndim else None
        n = n if broadcast in ("disabled", "scalar") else None
        super().__init__(shapein=n, shapeout=n, separable=True, real=not np.iscomplexobj(data), name=f"const({data})")
        self.data, self.broadcast = data, broadcast

    def on_array(self, x):
        if self.broadcast in ("leftward", "rightward"):
            return np.broadcast_to(spread_array(self.data, np.shape(x)[-1], self.broadcast), np.shape(x))
        return np.broadcast_to(self.data, np.shape(x)) if self.data.ndim == 0 or np.shape(x)[-1:] == self.data.shape[-1:] else self.data

    def on_column(self, c, index=None):
        if self.broadcast == "rightward" and self.data.ndim:
            raise ValueError("a constant along the slow axis needs a field of known length")
        return at_index(self.data.astype(float), index if self.broadcast != "leftward" or index is None else F.pmod(index, F.lit(self.data.size)))

    def on_field(self, f):
        f = f.densified()
        if self.data.ndim == 0:
            return f.values(literal(self.data[()], not self.real))
        return replace(f, df=joined(f, self.data, broadcast=self.broadcast).withColumn("v", F.col("w")).drop("w"))

    def conjugate_(self):
        return self if self.real else ConstantOperator(self.data.conj(), self.broadcast)


class DiagonalBase(Operator):
    pass


class DiagonalOperator(DiagonalBase):
    """data * x. data: an array, or a DataFrame (i, w), where w may be complex. An array of zeros, of ones, of one
    value or of zeros and ones becomes the simpler operator. ``broadcast`` says how an array is spread over longer
    vectors: repeated (leftward), or each element over a run of them (rightward)."""

    def __new__(cls, data, n=None, broadcast="disabled"):
        if cls is DiagonalOperator and not isinstance(data, DataFrame) and checked_broadcast(broadcast) in ("disabled", "scalar"):
            d = np.asarray(data)
            n = d.shape[-1] if d.ndim else None
            minus, zero, one, other, same = special_values(d)
            if d.ndim == 0 or same:
                value = d.ravel()[0]
                return ZeroOperator(n, n) if value == 0 else IdentityOperator(n) if value == 1 else HomothetyOperator(value, n)
            if not other and not minus and zero:
                return MaskOperator(d == 0)
        return super().__new__(cls)

    def __init__(self, data, n=None, broadcast="disabled"):
        frame, self.broadcast = isinstance(data, DataFrame), checked_broadcast(broadcast)
        data = data if frame else np.asarray(data)
        real = not is_complex(data, "w") if frame else not np.iscomplexobj(data)
        unit = not frame and bool((np.abs(data) == 1).all()) and real
        size = n if frame or broadcast in ("leftward", "rightward") else data.shape[-1]
        super().__init__(shapein=size, linear=True, square=True, real=real, symmetric=True, involutary=unit, separable=not frame and data.size <= MOST_LITERAL and real and broadcast != "rightward", name="Diag")
        self.data, self.broadcast = data, broadcast

    def on_array(self, x):
        return spread_array(self.data, np.shape(x)[-1], self.broadcast) * x

    def on_column(self, c, index=None):
        return at_index(self.data, index if self.broadcast != "leftward" or index is None else F.pmod(index, F.lit(self.data.size))) * c

    def on_field(self, f):
        v = times(F.col("w"), F.col("v"), not self.real, f.is_complex)
        return replace(f, df=joined(f, self.data, broadcast=self.broadcast).withColumn("v", v).drop("w"))

    def _of(self, data):
        return DiagonalOperator(data, self.shapein if isinstance(data, DataFrame) else None, self.broadcast)

    def conjugate_(self):
        if self.real:
            return self
        return self._of(self.data.withColumn("w", complex_(F.col("w")["re"], -F.col("w")["im"])) if isinstance(self.data, DataFrame) else self.data.conj())

    def inverse_(self):
        if isinstance(self.data, DataFrame):
            if not self.real:
                size = F.col("w")["re"] * F.col("w")["re"] + F.col("w")["im"] * F.col("w")["im"]
                return self._of(self.data.withColumn("w", complex_(F.try_divide(F.col("w")["re"], size), -F.try_divide(F.col("w")["im"], size))))
            return self._of(self.data.withColumn("w", F.try_divide(F.lit(1.0), "w")))
        with np.errstate(divide="ignore"):
            return self._of(1 / self.data)

    def __pow__(self, n):
        return self.inverse_() if n == -1 and not isinstance(self.data, DataFrame) else self._of(self.data**n) if not isinstance(self.data, DataFrame) else super().__pow__(n)


def special_values(x: np.ndarray) -> tuple[int, int, int, bool, bool]:
    """How many -1, 0 and 1; whether there are others; whether all are the same."""
    x = np.asarray(x)
    minus, zero, one = int((x == -1).sum()), int((x == 0).sum()), int((x == 1).sum())
    return minus, zero, one, minus + zero + one < x.size, bool(x.size and (x == x.ravel()[0]).all())


class ByColumnOperator(DiagonalBase):
    """A diagonal whose element is computed from columns of the same row (a weight joined before, an expression)."""

    def __init__(self, expr: Column | str, n=None):
        super().__init__(shapein=n, linear=True, square=True, symmetric=True, separable=True, name=f"Diag({expr})")
        self.expr = expr

    def on_column(self, c, index=None):
        return condition(self.expr) * c


class DiagonalNumexprOperator(ByColumnOperator):
    """A diagonal given by an expression string over the named columns of a row; other names are checked against an allow-list."""

    def __init__(self, expr: str, n=None, columns: tuple[str, ...] = ("i",)):
        from opweave.operators.elementwise import checked

        super().__init__(checked(expr, columns), n)


class MaskOperator(DiagonalBase):
    """Zero where the mask holds (even where x is NaN). mask: a boolean array, or a condition on the row's columns (a Column or SQL)."""

    def __new__(cls, mask, *a, **k):
        if cls is MaskOperator and not isinstance(mask, (Column, str)):
            m = np.asarray(mask, bool)
            n = m.shape[-1] if m.ndim else None
            if not m.any():
                return IdentityOperator(n)
            if m.all():
                return ZeroOperator(n, n)
        return super().__new__(cls)

    def __init__(self, mask, n=None):
        self_mask = mask if isinstance(mask, (Column, str)) else np.asarray(mask, bool)
        super().__init__(shapein=n if isinstance(mask, (Column, str)) else self_mask.shape[-1], linear=True, square=True, symmetric=True, idempotent=True, separable=True, name="Mask")
        self.mask = self_mask

    def on_array(self, x):
        return np.where(self.mask, 0, x)

    def on_column(self, c, index=None):
        return F.when(condition(self.mask) if isinstance(self.mask, (Column, str)) else at_index(self.mask, index), F.lit(0.0)).otherwise(c)


class PackOperator(Operator):
    """Keeps the elements where the mask holds, re-indexed from 0. An array mask may be spread over vectors of
    length n (``broadcast``, as for a diagonal)."""

    def __new__(cls, mask, *a, **k):
        if cls is PackOperator and not isinstance(mask, (Column, str)) and np.asarray(mask, bool).all() and not (a or k):
            return IdentityOperator(np.asarray(mask).shape[-1])
        return super().__new__(cls)

    def __init__(self, mask, n=None, broadcast="disabled"):
        array = not isinstance(mask, (Column, str))
        self_mask = spread_array(np.asarray(mask, bool), n or np.shape(mask)[-1], checked_broadcast(broadcast)) if array else mask
        super().__init__(shapein=self_mask.shape[-1] if array else n, shapeout=int(self_mask.sum()) if array else None, linear=True, name="Pack")
        self.mask = self_mask

    def on_array(self, x):
        return x[..., self.mask]

    def on_field(self, f):
        kept = f.df.where(condition(self.mask) if isinstance(self.mask, (Column, str)) else at_index(self.mask, F.col("i")))
        return replace(f, df=numbered(kept, f.keys), n=self.shapeout)

    def transpose_(self):
        return UnpackOperator(self.mask, self.shapein)


#: Index values behind one block when rows are numbered.
BLOCK = 1 << 16


def numbered(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Replaces i by its rank from 0 within the keys. Ranks are taken within blocks of the index, and the
    blocks' offsets added, so that one long vector is not one task's."""
    block = F.floor(F.col("i") / BLOCK)
    df = df.withColumn("b", block)
    sizes = df.groupBy(*keys, "b").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*keys, "b").orderBy("i"))
    return df.withColumn("r", rank).join(offsets, [*keys, "b"]).withColumn("i", (F.col("r") - 1 + F.col("offset")).cast("long")).drop("b", "r", "offset")


class UnpackOperator(Operator):
    """Scatters packed elements to where the mask holds; zero elsewhere. On a field, a mask that is a condition
    needs the ``table`` whose rows it is about: index ``i``, any keys, and the condition's columns."""

    def __init__(self, mask, n=None, table: DataFrame | None = None):
        array = not isinstance(mask, (Column, str))
        self_mask, self.table = np.asarray(mask, bool) if array else mask, table
        super().__init__(shapein=int(self_mask.sum()) if array else None, shapeout=self_mask.shape[-1] if array else n, linear=True, name="Unpack")
        self.mask = self_mask

    def on_array(self, x):
        out = np.zeros((*x.shape[:-1], self.shapeout), x.dtype)
        out[..., self.mask] = x
        return out

    def on_field(self, f):
        if isinstance(self.mask, (Column, str)):
            if self.table is None:
                raise ValueError("unpacking a field by a condition needs the table that it is about")
            keys = tuple(k for k in f.keys if k in self.table.columns)
            kept = self.table.where(condition(self.mask)).select(*keys, "i", F.col("i").alias("to"))
            df = f.df.join(numbered(kept, keys), [*keys, "i"]).withColumn("i", F.col("to")).drop("to")
            return replace(f, df=df, n=self.shapeout, dense=False)
        where = np.flatnonzero(self.mask)
        return replace(f, df=joined(f, where, "to").withColumn("i", F.col("to").cast("long")).drop("to"), n=self.shapeout, dense=False)

    def transpose_(self):
        return PackOperator(self.mask, self.shapeout)


class ReshapeOperator(Operator):
    """Between index tuples and a flat index (C order); values stay."""

    def __new__(cls, shapein, shapeout):
        return IdentityOperator() if tuple(np.atleast_1d(shapein)) == tuple(np.atleast_1d(shapeout)) else super().__new__(cls)

    def __init__(self, shapein, shapeout):
        self.dims_in, self.dims_out = tuple(np.atleast_1d(shapein).tolist()), tuple(np.atleast_1d(shapeout).tolist())
        if np.prod(self.dims_in) != np.prod(self.dims_out):
            raise ValueError(f"{self.dims_in} and {self.dims_out} differ in size")
        super().__init__(linear=True, orthogonal=True, separable=False, name="Reshape")
        self.flags["square"] = False

    def on_array(self, x):
        return np.reshape(x, (*x.shape[: x.ndim - len(self.dims_in)], *self.dims_out))

    def on_field(self, f):
        return f  # fields keep the flat index; shapes are how it is read

    def transpose_(self):
        return ReshapeOperator(self.dims_out, self.dims_in)
