"""Operator expressions: an immutable tree built on the driver, simplified by rules, applied lazily.

An operator maps vectors to vectors. It can be applied to

* a NumPy array (last axis is the vector), for small checks and constant folding,
* a ``Column`` (element-wise operators; the expression stays inside whole-stage codegen),
* a ``Field``: a DataFrame with an index column ``i``, a value column ``v`` and any further key columns,
  one row for each element of each vector. Complex values are ``struct<re, im>`` (see ``values``).

``+ - * / **`` combine operators; for two linear ones ``*`` composes, else it multiplies element-wise;
a linear operator times data applies it. ``C T H I`` are conjugate, transpose, adjoint and inverse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opweave.values import complex_, conjugate, divided, is_complex, lifted, literal, plus, times, total

FLAGS = ("linear", "square", "real", "symmetric", "hermitian", "idempotent", "involutary", "orthogonal", "unitary", "separable")


@dataclass(frozen=True)
class Field:
    """A vector for each combination of keys: rows (keys..., i, v). ``n`` is the vectors' length where known;
    ``dense`` says whether every index has a row (else absent ones are zero)."""

    df: DataFrame
    n: int | None = None
    keys: tuple[str, ...] = ()
    dense: bool = True
    whole: Whole | None = field(default=None, compare=False, repr=False)

    def values(self, v: Column) -> Field:
        return replace(self, df=self.df.withColumn("v", v))

    @property
    def is_complex(self) -> bool:
        return is_complex(self.df)

    def lifted(self) -> Field:
        """With complex values."""
        return self.values(lifted(F.col("v"), self.is_complex))

    def densified(self) -> Field:
        """Zeros for absent indices; needs n."""
        if self.dense:
            return self
        if self.n is None:
            raise ValueError("the length of a sparse field must be known before a nonlinear operator")
        axis = self.df.sparkSession.range(self.n).select(F.col("id").alias("i"))
        if self.keys:
            heads = self.df.select(*self.keys).distinct()
            axis = heads.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long"))))
        df = axis.join(self.df, [*self.keys, "i"], "left").withColumn("v", F.coalesce("v", literal(0, self.is_complex)))
        return replace(self, df=df, dense=True)


#: Elements that are worked on at once where vectors are rows, and the longest vectors that are kept so.
AT_ONCE, LONGEST_ROW = 1 << 17, 1024


@dataclass(frozen=True, eq=False)
class Whole:
    """The vectors behind a field, where each still is one row of a table: operators that say so (``takes_rows``)
    are applied to batches of rows, so that nothing is shuffled and a task holds one batch. ``table`` has the keys
    and ``x``, arrays of n numbers; ``rest`` is the field of rows that aren't such arrays (of another length, or
    with nulls). It describes the field whose ``df`` it names, no other that was made from it."""

    df: DataFrame
    table: DataFrame
    rest: Field
    steps: tuple[Callable, ...] = ()

    def then(self, op: Operator, f: Field) -> Field:
        rest, m, as_complex = op(self.rest), op.shapeout or f.n, f.is_complex or not op.real
        kinds = ", ".join([*(f"`{k}` {self.table.schema[k].dataType.simpleString()}" for k in f.keys), "i long", f"v {'struct<re: double, im: double>' if as_complex else 'double'}"])
        steps = (*self.steps, op.on_rows)
        rows = self.table.mapInArrow(_batches(steps, f.keys, as_complex), kinds)
        rest = rest.lifted() if as_complex and not rest.is_complex else rest
        df = rows.unionByName(rest.df.select(*f.keys, "i", "v"))
        return Field(df, m, f.keys, rest.dense, Whole(df, self.table, rest, steps))


def _batches(steps, keys, as_complex: bool):
    """Rows (keys..., i, v) of what the steps make of batches of arrays."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(b.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            step = max(1, AT_ONCE // x.shape[1])
            for at in range(0, len(x), step):
                y = x[at : at + step]
                for s in steps:
                    y = np.asarray(s(y))
                r, m = y.shape
                which = pa.array(np.repeat(np.arange(at, at + r), m))
                v = np.ravel(y)
                value = pa.StructArray.from_arrays([pa.array(v.real.astype(float)), pa.array(v.imag.astype(float))], ["re", "im"]) if as_complex else pa.array(v.astype(float))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(which) for k in keys), pa.array(np.tile(np.arange(m), r)), value], [*keys, "i", "v"])

    return run


def all_flags(**given: bool) -> dict[str, bool]:
    """Completes flags by what they imply."""
    f = {k: bool(given.get(k, k == "real")) for k in FLAGS}
    if any(f[k] for k in ("hermitian", "orthogonal", "symmetric", "unitary", "idempotent", "involutary") if k in given) and given.get("linear") is not False:
        f["linear"] = True
    if f["real"]:
        f["symmetric"] = f["hermitian"] = f["symmetric"] or f["hermitian"]
        f["orthogonal"] = f["unitary"] = f["orthogonal"] or f["unitary"]
    if f["involutary"] and f["symmetric"] and f["real"]:
        f["orthogonal"] = f["unitary"] = True
    if f["orthogonal"] and f["symmetric"]:
        f["involutary"] = True
    if f["orthogonal"] and f["involutary"]:
        f["symmetric"] = True
        f["hermitian"] = f["hermitian"] or f["real"]
    if any(f[k] for k in ("symmetric", "hermitian", "orthogonal", "unitary", "idempotent", "involutary")):
        f["square"] = True
    return f


def _bare(cls: type) -> Operator:
    return object.__new__(cls)


class Operator:
    """Base of all operators; subclasses give what they can of ``on_array``, ``on_column`` and ``on_field``."""

    shapein: int | None = None
    shapeout: int | None = None

    def __init__(self, direct: Callable | None = None, *, column: Callable | None = None, transpose: Callable | None = None, inverse: Callable | None = None, shapein=None, shapeout=None, name: str | None = None, **flags: bool):
        self._direct, self._column, self._transpose, self._inverse = direct, column, transpose, inverse
        self.shapein, self.shapeout = shapein, shapeout if shapeout is not None else (shapein if flags.get("square") else None)
        self.flags, self.name = all_flags(**flags), name or type(self).__name__.removesuffix("Operator")
        self.rules: dict = {}

    def __getattr__(self, key):
        if key in FLAGS and "flags" in self.__dict__:
            return self.flags[key]
        raise AttributeError(key)

    def __reduce__(self):
        """For executors; subclasses' ``__new__`` may want arguments."""
        return _bare, (type(self),), self.__dict__

    # what subclasses define

    def on_array(self, x: np.ndarray) -> np.ndarray:
        if self._direct is None:
            raise NotImplementedError(f"{self.name} has no direct method")
        return self._direct(x)

    def on_column(self, c: Column, index: Column | None = None) -> Column:
        if self._column is None:
            raise NotImplementedError(f"{self.name} is not a column expression")
        return self._column(c)

    def on_field(self, f: Field) -> Field:
        if not self.separable and self._column is None:
            raise NotImplementedError(f"{self.name} can't be applied to a field")
        f = f if self.linear else f.densified()
        if not self.real:
            raise TypeError(f"{self.name} is complex and has no column expression")
        if not f.is_complex:
            return f.values(self.on_column(F.col("v"), F.col("i")))
        if not self.linear:
            raise TypeError(f"{self.name} takes real fields")
        return f.values(complex_(self.on_column(F.col("v")["re"], F.col("i")), self.on_column(F.col("v")["im"], F.col("i"))))

    def takes_rows(self, n: int) -> bool:
        """Whether ``on_rows`` is all that the operator does to vectors of length n."""
        return False

    def on_rows(self, x: np.ndarray) -> np.ndarray:
        """A batch, one vector a row."""
        return self.on_array(x)

    def conjugate_(self) -> Operator | None:
        return self if self.real else Conjugated(self)

    def transpose_(self) -> Operator | None:
        if self._transpose is None:
            return None
        return Operator(self._transpose, transpose=self._direct, shapein=self.shapeout, shapeout=self.shapein, name=f"{self.name}.T", linear=True)

    def inverse_(self) -> Operator | None:
        if self._inverse is None:
            return None
        return Operator(self._inverse, inverse=self._direct, shapein=self.shapeout, shapeout=self.shapein, name=f"{self.name}.I", linear=self.linear)

    # associated operators: the first way that applies

    @property
    def C(self) -> Operator:
        return self.conjugate_() or Missing(self, "C")

    @property
    def T(self) -> Operator:
        if self.symmetric:
            return self
        found = self.transpose_()
        if found is None and self.orthogonal:
            found = self.inverse_()
        return found or Missing(self, "T")

    @property
    def H(self) -> Operator:
        if self.hermitian:
            return self
        return self.T if self.real else self.T.C

    @property
    def I(self) -> Operator:  # noqa: E743
        if self.involutary:
            return self
        if self.orthogonal:
            return self.T
        if self.unitary and not self.real:
            return self.H
        return self.inverse_() or Missing(self, "I")

    # application and algebra

    def __call__(self, x, out=None, operation: str = "add"):
        """The operator applied to x; with ``out``, what it gives is combined with out (add, subtract, multiply
        or divide), element by element. Nothing is changed in place."""
        if out is not None:
            return accumulated(self(x), out, operation)
        if isinstance(x, Operator):
            return self if x is self and self.idempotent else compose(self, x)
        if isinstance(x, Field):
            if x.n is not None and self.shapein is not None and x.n != self.shapein:
                raise ValueError(f"{self.name} takes vectors of length {self.shapein}, not {x.n}")
            if x.whole is not None and x.whole.df is x.df and self.takes_rows(x.n):
                return x.whole.then(self, x)
            return self.on_field(x)
        if isinstance(x, Column):
            return self.on_column(x)
        x = np.asarray(x)
        if self.shapein is not None and x.shape[-1:] != (self.shapein,):
            raise ValueError(f"{self.name} takes vectors of length {self.shapein}, not {x.shape[-1:]}")
        return self.on_array(x)

    def __mul__(self, other):
        if isinstance(other, Variable):
            return NotImplemented
        if isinstance(other, Operator) or np.isscalar(other):
            o = asoperator(other)
            if self is o and self.idempotent:
                return self
            return compose(self, o) if self.linear and o.linear else multiply(self, o)
        if self.linear:
            return self(other)
        return multiply(self, asoperator(other, constant=True))

    def __rmul__(self, other):
        if np.isscalar(other):
            return asoperator(other) * self
        return self.T(other) if self.linear else multiply(asoperator(other, constant=True), self)

    def __matmul__(self, other):
        return self(other)

    def __add__(self, other):
        return add(self, asoperator(other, constant=not self.linear or np.isscalar(other)))

    def __radd__(self, other):
        return add(asoperator(other, constant=True), self)

    def __neg__(self):
        return compose(asoperator(-1.0), self)

    def __sub__(self, other):
        return self + (-asoperator(other, constant=np.isscalar(other)) if not isinstance(other, Operator) else -other)

    def __rsub__(self, other):
        return asoperator(other, constant=True) + (-self)

    def __truediv__(self, other):
        from opweave.operators.elementwise import PowerOperator

        o = asoperator(other, constant=np.isscalar(other))
        return multiply(self, compose(PowerOperator(-1), o))

    def __rtruediv__(self, other):
        return asoperator(other, constant=True) / self

    def __pow__(self, n):
        from opweave.operators.elementwise import PowerOperator

        if not self.linear:
            return compose(PowerOperator(n), self)
        if int(n) != n:
            raise ValueError("a linear operator has whole powers only")
        if n == 0:
            from opweave.operators.diagonal import IdentityOperator

            return IdentityOperator(self.shapein)
        base = self if n > 0 else self.I
        out = base
        for _ in range(abs(int(n)) - 1):
            out = compose(out, base)
        return out

    def todense(self, n: int | None = None) -> np.ndarray:
        """The matrix: the operator on every basis vector."""
        n = n or self.shapein
        if n is None:
            raise ValueError("the number of columns must be given")
        return np.stack([self.on_array(e) for e in np.eye(n)], axis=-1)

    def matvec(self, x):
        return self(np.asarray(x).ravel())

    def rmatvec(self, x):
        return self.H(np.asarray(x).ravel())

    @property
    def shape(self):
        return self.shapeout, self.shapein

    def copy(self) -> Operator:
        """A shallow copy with rules of its own."""
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__, rules=dict(self.rules))
        return out

    def delete(self) -> None:
        """Lets go of the operator's data; what is left can't be applied."""
        name = self.name
        self.__dict__.clear()
        self.__class__ = DeletedOperator
        DeletedOperator.__init__(self, name)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def key(self) -> tuple:
        return (type(self), *((k, v.tobytes() if isinstance(v, np.ndarray) else repr(v)) for k, v in sorted(vars(self).items()) if k not in ("rules", "flags")))

    def __eq__(self, other):
        return isinstance(other, Operator) and self.key() == other.key()

    def __hash__(self):
        return hash(self.key())

    def __repr__(self):
        return self.name

    def explain(self) -> str:
        return repr(self)

    def set_rule(self, subject, rule: Callable) -> None:
        """A rule for this operator: subject is 'T', 'C', 'I' or (operator class, 'left' or 'right')."""
        self.rules[subject] = rule

    def del_rule(self, subject) -> None:
        del self.rules[subject]


class DeletedOperator(Operator):
    def __init__(self, name: str = "?"):
        super().__init__(name=f"deleted {name}")

    def on_array(self, x):
        raise RuntimeError(f"{self.name} can't be applied")

    on_column = on_field = on_array


class Conjugated(Operator):
    """conj(A(conj(x))), for a complex operator that doesn't say what its conjugate is."""

    def __init__(self, of: Operator):
        super().__init__(shapein=of.shapein, shapeout=of.shapeout, name=f"{of.name}.C", linear=of.linear, real=False)
        self.of = of

    def on_array(self, x):
        return np.conj(self.of.on_array(np.conj(x)))

    def on_field(self, f):
        out = self.of(f.lifted().values(conjugate(lifted(F.col("v"), f.is_complex))))
        return out.values(conjugate(lifted(F.col("v"), out.is_complex)))

    def conjugate_(self):
        return self.of

    def transpose_(self):
        t = self.of.T
        return None if isinstance(t, Missing) else Conjugated(t)


class Missing(Operator):
    """An associated operator without a body: it exists, and fails when applied."""

    def __init__(self, of: Operator, kind: str):
        super().__init__(shapein=of.shapein if kind == "C" else of.shapeout, shapeout=of.shapeout if kind == "C" else of.shapein, name=f"{of.name}.{kind}", linear=of.linear)
        self.of, self.kind = of, kind

    def _back(self, kind):
        return self.of if kind == self.kind else None

    def conjugate_(self):
        return self._back("C") or super().conjugate_()

    def transpose_(self):
        return self._back("T")

    def inverse_(self):
        return self._back("I")

    def on_array(self, x):
        raise NotImplementedError(f"{self.name} is not defined")

    on_field = on_array


class Composition(Operator):
    """A B C: the last is applied first."""

    def __init__(self, operands: list[Operator]):
        every = lambda k: all(o.flags[k] for o in operands)
        super().__init__(shapein=operands[-1].shapein, shapeout=operands[0].shapeout, name="∘".join(map(repr, operands)), **{k: every(k) for k in ("linear", "real", "square", "separable", "orthogonal", "unitary")})
        if not self.linear:
            self.flags |= dict.fromkeys(("orthogonal", "unitary"), False)
        self.operands = operands

    def on_array(self, x):
        for o in reversed(self.operands):
            x = o.on_array(x)
        return x

    def on_column(self, c, index=None):
        for o in reversed(self.operands):
            c = o.on_column(c, index)
        return c

    def on_field(self, f):
        for o in reversed(self.operands):
            f = o(f)
        return f

    def conjugate_(self):
        return compose(*(o.C for o in self.operands))

    def transpose_(self):
        return compose(*(o.T for o in reversed(self.operands))) if self.linear else None

    def inverse_(self):
        return compose(*(o.I for o in reversed(self.operands)))


class Group(Composition):
    """A composition that the rules leave alone."""


class Addition(Operator):
    def __init__(self, operands: list[Operator]):
        every = lambda k: all(o.flags[k] for o in operands)
        super().__init__(shapein=_first(o.shapein for o in operands), shapeout=_first(o.shapeout for o in operands), name="(" + " + ".join(map(repr, operands)) + ")", square=any(o.square for o in operands), **{k: every(k) for k in ("linear", "real", "separable", "symmetric", "hermitian")})
        self.operands = operands

    def on_array(self, x):
        return sum(o.on_array(x) for o in self.operands)

    def on_column(self, c, index=None):
        out = self.operands[0].on_column(c, index)
        for o in self.operands[1:]:
            out = out + o.on_column(c, index)
        return out

    def on_field(self, f):
        if self.separable and self.real and not f.is_complex:
            return super().on_field(f)
        done = [o(f) for o in self.operands]
        any_complex = any(g.is_complex for g in done)
        if any_complex:
            done = [g.lifted() for g in done]
        keys = done[0].keys
        df = done[0].df.select(*keys, "i", "v")
        for g in done[1:]:
            df = df.unionByName(g.df.select(*keys, "i", "v"))
        return Field(df.groupBy(*keys, "i").agg(total(F.col("v"), any_complex).alias("v")), done[0].n, keys, all(g.dense for g in done))

    def conjugate_(self):
        return add(*(o.C for o in self.operands))

    def transpose_(self):
        return add(*(o.T for o in self.operands)) if self.linear else None


class Multiplication(Operator):
    """Element-wise product of what the operands give."""

    def __init__(self, operands: list[Operator]):
        every = lambda k: all(o.flags[k] for o in operands)
        super().__init__(shapein=_first(o.shapein for o in operands), shapeout=_first(o.shapeout for o in operands), name="(" + " × ".join(map(repr, operands)) + ")", linear=False, square=any(o.square for o in operands), **{k: every(k) for k in ("real", "separable")})
        self.operands = operands

    def on_array(self, x):
        out = self.operands[0].on_array(x)
        for o in self.operands[1:]:
            out = out * o.on_array(x)
        return out

    def on_column(self, c, index=None):
        from opweave.operators.elementwise import ReciprocalOperator

        out = self.operands[0].on_column(c, index)
        for o in self.operands[1:]:
            parts = o.operands if isinstance(o, Composition) else [o]
            if isinstance(parts[0], ReciprocalOperator):  # one division, not a product with a reciprocal
                below = c
                for p in reversed(parts[1:]):
                    below = p.on_column(below, index)
                out = divided(out, below)
            else:
                out = out * o.on_column(c, index)
        return out

    def on_field(self, f):
        if self.separable and self.real and not f.is_complex:
            return super().on_field(f)
        out = self.operands[0](f)
        for o in self.operands[1:]:
            other = o(f)
            v = times(F.col("v"), F.col("w"), out.is_complex, other.is_complex)
            out = replace(out, df=out.df.join(other.df.select(*f.keys, "i", F.col("v").alias("w")), [*f.keys, "i"]).withColumn("v", v).drop("w"))
        return out


def _first(xs):
    return next((x for x in xs if x is not None), None)


def compose(*ops: Operator) -> Operator:
    from opweave.rules import simplify

    flat = [p for o in ops for p in (o.operands if type(o) is Composition else [o])]
    for a, b in zip(flat, flat[1:]):
        if a.shapein is not None and b.shapeout is not None and a.shapein != b.shapeout:
            raise ValueError(f"{a} takes length {a.shapein}, but {b} gives {b.shapeout}")
    flat = simplify(flat, "compose")
    return flat[0] if len(flat) == 1 else Composition(flat)


def add(*ops: Operator) -> Operator:
    from opweave.rules import simplify

    flat = simplify([p for o in ops for p in (o.operands if type(o) is Addition else [o])], "add")
    return flat[0] if len(flat) == 1 else Addition(flat)


def multiply(*ops: Operator) -> Operator:
    from opweave.rules import simplify

    flat = simplify([p for o in ops for p in (o.operands if type(o) is Multiplication else [o])], "multiply")
    return flat[0] if len(flat) == 1 else Multiplication(flat)


def asoperator(x, constant: bool = False) -> Operator:
    """An operator from an operator, scalar, array, (i, j, a) DataFrame, NumPy ufunc, sparse matrix (anything
    with ``tocoo``), linear operator (anything with ``shape`` and ``matvec``) or callable."""
    from opweave.operators import dense, diagonal, elementwise, sparse

    if isinstance(x, Operator):
        return x
    if isinstance(x, np.ufunc):
        return elementwise.UfuncOperator(x.__name__)
    if np.isscalar(x):
        return diagonal.ConstantOperator(x) if constant else diagonal.HomothetyOperator(x)
    if isinstance(x, DataFrame):
        return sparse.SparseOperator(x)
    if hasattr(x, "tocoo"):
        m = x.tocoo()
        return sparse.SparseOperator((m.row, m.col, m.data), m.shape)
    if hasattr(x, "matvec") and hasattr(x, "shape"):
        return Operator(_batched(x.matvec), transpose=_batched(getattr(x, "rmatvec", None)), shapein=x.shape[1], shapeout=x.shape[0], linear=True, square=x.shape[0] == x.shape[1])
    if callable(x):
        return Operator(x, column=vectorised(x), separable=True)
    a = np.asarray(x)
    if constant:
        return diagonal.ConstantOperator(a)
    if a.ndim == 0:
        return diagonal.HomothetyOperator(a[()])
    return diagonal.DiagonalOperator(a) if a.ndim == 1 else dense.DenseOperator(a) if a.ndim == 2 else dense.DenseBlockDiagonalOperator(a)


def _batched(f):
    """A function of one vector, for arrays whose last axis is the vector."""
    return f and (lambda x: f(x) if np.ndim(x) == 1 else np.apply_along_axis(f, -1, x))


def vectorised(f: Callable) -> Callable:
    """A function of arrays as one of columns: applied to the column itself if it can be, else to Arrow batches."""

    def column(c: Column) -> Column:
        try:
            out = f(c)
        except Exception:  # noqa: BLE001  whatever a function of arrays does with a column
            out = None
        if isinstance(out, Column):
            return out
        import pandas as pd

        def batch(s):
            return pd.Series(np.asarray(f(s.to_numpy()), float))

        batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return F.pandas_udf(batch, "double")(c)

    return column


def asoperator1d(x) -> Operator:
    """The operator of flat vectors: an operator between arrays with several axes is wrapped."""
    op = asoperator(x)
    dims = getattr(op, "array_shape", None)
    if dims is None or len(dims) < 2 or getattr(op, "flat", True):
        return op
    back = lambda a, y: np.reshape(y, (*np.shape(a)[:-1], -1))
    size = int(np.prod(dims))
    return Operator(lambda a: back(a, op(np.reshape(a, (*np.shape(a)[:-1], *dims)))), transpose=lambda a: back(a, op.T(np.reshape(a, (*np.shape(a)[:-1], *dims)))), shapein=size, shapeout=size, linear=op.linear, name=f"{op.name}1d")


#: NumPy's function, and whether a field's absent indices may be left out, for ``accumulated``.
COMBINE = {"add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.divide}


def accumulated(new, out, operation: str = "add"):
    """out combined with new."""
    if operation not in COMBINE:
        raise ValueError(f"no operation {operation!r}; there are {', '.join(COMBINE)}")
    if not isinstance(out, Field):
        return COMBINE[operation](out, new)
    a, b, keys = out.densified(), new.densified(), [*out.keys, "i"]
    ac, bc = a.is_complex, b.is_complex
    o, n = F.col("v"), F.col("w")
    if operation == "divide":
        if bc:
            raise TypeError("a field can't be divided by a complex one")
    if operation == "subtract":
        n = complex_(-n["re"], -n["im"]) if bc else -n
    v = divided(o, n, ac) if operation == "divide" else times(o, n, ac, bc) if operation == "multiply" else plus(o, n, ac, bc)
    return replace(a, df=a.df.join(b.df.select(*keys, F.col("v").alias("w")), keys).withColumn("v", v).drop("w"))


@dataclass(eq=False)
class Variable:
    """A symbol, for printing expressions."""

    name: str = "x"
    suffix: str = field(default="")

    @property
    def T(self):
        return Variable(self.name, "" if self.suffix == ".T" else ".T")

    def __repr__(self):
        return self.name + self.suffix

    def _with(self, sign: str, other, swap: bool = False) -> Variable:
        a, b = (other, self) if swap else (self, other)
        return Variable(f"({a!r} {sign} {b!r})")

    def __add__(self, other):
        return self._with("+", other)

    def __radd__(self, other):
        return self._with("+", other, True)

    def __sub__(self, other):
        return self._with("-", other)

    def __rsub__(self, other):
        return self._with("-", other, True)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return self._with("*", other, True)

    def __truediv__(self, other):
        return self._with("/", other)

    def __rtruediv__(self, other):
        return self._with("/", other, True)

    def __pow__(self, n):
        return self._with("**", n)

    def __neg__(self):
        return Variable(f"-{self!r}")
