"""Preconditioned conjugate gradients and Lanczos, on arrays and on fields."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from opweave.expr import Field, Operator, asoperator
from opweave.operators.sparse import EigendecompositionOperator
from opweave.session import dropped, written
from opweave.solvers.core import IterativeAlgorithm, error_within, steps_done


def gradients(product: Callable, precondition: Callable, b: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Endless conjugate gradients: each x with its residual's squared norm, the given x first."""
    r = b - product(x)
    p, last = 0.0, 1.0
    while True:
        yield x, float(r @ r)
        z = precondition(r)
        now = float(r @ z)
        p, last = z + (now / last) * p, now
        q = product(p)
        step = now / float(p @ q)
        x, r = x + step * p, r - step * q


class PCGAlgorithm(IterativeAlgorithm):
    """Solves A x = b for a symmetric positive operator, on arrays; the error is the residual's norm over b's."""

    def __init__(self, A, b, x0=None, tol=1e-5, maxiter=300, M=None, callback=None):
        A, M = asoperator(A), (lambda r: r) if M is None else asoperator(M)
        if np.iscomplexobj(b) or not A.real:
            raise TypeError("conjugate gradients take real operators")
        b = np.asarray(b, float)
        if A.shapein not in (None, len(b)):
            raise ValueError(f"the operator takes length {A.shapein}, b has {len(b)}")
        super().__init__(error_within(tol), steps_done(maxiter), callback, x=np.zeros(len(b)) if x0 is None else np.array(x0, float))
        self.A, self.M, self.b = A, M, b

    def initialize(self):
        super().initialize()
        if not self.b.any():
            self.x = np.zeros(len(self.b))
        self.steps = gradients(self.A, self.M, self.b, self.x)
        self._take()

    def _take(self):
        self.x, left = next(self.steps)
        self.error = (left / float(self.b @ self.b)) ** 0.5 if self.b.any() else 0.0

    iteration = _take


def pcg(A: Operator, b, x0=None, tol: float = 1e-5, maxiter: int = 300, M=None, callback: Callable | None = None) -> dict:
    if isinstance(b, Field):
        return pcg_field(A, b, x0, tol, maxiter, M, callback)
    a = PCGAlgorithm(A, b, x0, tol, maxiter, M, callback)
    x = a.run()
    return {"x": x, "success": a.success, "message": a.message, "nit": a.niterations, "error": a.error, "time": time.time() - a.began, "algorithm": a}


def beside(s, op: Operator, n: int | None, col: str, out: str):
    """The frame s(i, ...) with the operator's product with one of its columns."""
    y = op(Field(s.select("i", F.col(col).alias("v")), n)).df.select("i", F.col("v").alias(out))
    return s.join(y, "i", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def pcg_field(A: Operator, b: Field, x0: Field | None = None, tol: float = 1e-5, maxiter: int = 300, M=None, callback=None) -> dict:
    """On fields (i, v) without keys. x, r and what belongs to them are columns of one frame, in the form with one
    reduction an iteration (Chronopoulos and Gear): a product, one written frame, and one aggregate over it. The
    lineage stays one iteration long, and the frame before is removed."""
    if b.is_complex or not A.real:
        raise TypeError("conjugate gradients take real operators")
    began = time.time()
    c = F.col

    def with_products(s):
        s = beside(s, M, b.n, "r", "u") if M is not None else s.withColumn("u", c("r"))
        s = written(beside(s, A, b.n, "u", "w"))
        return s, *s.agg(F.sum(c("r") * c("u")), F.sum(c("w") * c("u")), F.sum(c("r") * c("r"))).first()

    s = b.densified().df.select("i", c("v").alias("b"))
    norm = s.agg(F.sum(c("b") * c("b"))).first()[0] or 0.0
    if not norm:
        return {"x": Field(s.select("i", F.lit(0.0).alias("v")), b.n), "success": True, "message": "b is zero", "nit": 0, "error": 0.0, "time": time.time() - began}
    if x0 is None:
        s = s.select("i", F.lit(0.0).alias("x"), c("b").alias("r"))
    else:
        s = s.join(x0.densified().df.select("i", c("v").alias("x")), "i")
        s = beside(s, A, b.n, "x", "ax").select("i", "x", (c("b") - c("ax")).alias("r"))
    s, gamma, delta, left = with_products(s.withColumns({"p": F.lit(0.0), "s": F.lit(0.0)}))
    nit, alpha, beta, error = 0, gamma / delta if delta else 0.0, 0.0, (left / norm) ** 0.5
    while error > tol and nit < maxiter:
        nit += 1
        old = s
        s = s.select("i", "x", "r", (c("u") + beta * c("p")).alias("p"), (c("w") + beta * c("s")).alias("s"))
        s = s.select("i", (c("x") + alpha * c("p")).alias("x"), (c("r") - alpha * c("s")).alias("r"), "p", "s")
        s, new, delta, left = with_products(s)
        dropped(old)
        error, beta = (left / norm) ** 0.5, new / gamma
        alpha, gamma = (new / (delta - beta * new / alpha) if new else 0.0), new
        if callback:
            callback(nit, error)
    message = f"error {error:.3g} is within {tol:g}" if error <= tol else f"{maxiter} iterations are done"
    return {"x": Field(s.select("i", c("x").alias("v")), b.n), "success": error <= tol, "message": message, "nit": nit, "error": error, "time": time.time() - began}


def _ritz(alpha: list, beta: list) -> tuple[np.ndarray, np.ndarray]:
    off = beta[: len(alpha) - 1]
    return np.linalg.eigh(np.diag(alpha) + np.diag(off, 1) + np.diag(off, -1))


class LanczosAlgorithm(IterativeAlgorithm):
    """Three-term recursion, re-orthogonalised only if ``orthogonal``; ends in an eigendecomposition on the Krylov space."""

    def __init__(self, A, v0=None, maxiter: int = 300, callback=None, orthogonal: bool = False):
        self.A, self.orthogonal = asoperator(A), orthogonal
        n = self.A.shapein
        v = np.ones(n) if v0 is None else np.asarray(v0, float)
        super().__init__(steps_done(min(maxiter, n)), callback=callback, v=v / np.linalg.norm(v))
        self.alpha, self.beta, self.basis = [], [], []

    def iteration(self):
        w = self.A(self.v)
        a = float(w @ self.v)
        w = w - a * self.v - (self.beta[-1] * self.basis[-1] if self.beta else 0)
        self.alpha.append(a)
        self.basis.append(self.v)
        for _ in range(2 if self.orthogonal else 0):
            w = w - np.array(self.basis).T @ (np.array(self.basis) @ w)
        b = float(np.linalg.norm(w))
        if b < 1e-12 * max(map(abs, self.alpha)):
            self.aim = steps_done(self.niterations)
            b = 0.0
        self.beta.append(b)
        self.v = w / b if b else w

    def finalize(self):
        w, u = _ritz(self.alpha, self.beta)
        return EigendecompositionOperator(w=w, v=np.array(self.basis).T @ u)


def lanczos_field(A: Operator, v0: Field, maxiter: int = 300) -> tuple[np.ndarray, Callable[[], Field]]:
    """Lanczos on fields (i, v) without keys: eigenvalues on the Krylov space, and a function that gives the
    vectors that belong to them as a field with the key ``k``. Basis vectors are written, one frame each; only
    the recursion's numbers come to the driver."""
    c = F.col
    s = v0.densified().df.select("i", c("v").alias("w"), F.lit(0.0).alias("v"))
    alpha, beta, basis = [], [], []
    b = (s.agg(F.sum(c("w") * c("w"))).first()[0] or 0.0) ** 0.5
    while b and len(alpha) < maxiter:
        s = s.select("i", c("v").alias("before"), (c("w") / b).alias("v"))
        s = written(beside(s, A, v0.n, "v", "w"))
        basis.append(s.select("i", "v"))
        a = s.agg(F.sum(c("w") * c("v"))).first()[0]
        s = s.select("i", "v", (c("w") - a * c("v") - (beta[-1] if beta else 0.0) * c("before")).alias("w"))
        alpha.append(a)
        b = (s.agg(F.sum(c("w") * c("w"))).first()[0] or 0.0) ** 0.5
        if b < 1e-12 * max(map(abs, alpha)) or (v0.n is not None and len(alpha) == v0.n):
            b = 0.0
        beta.append(b)
    values, u = _ritz(alpha, beta) if alpha else (np.zeros(0), np.zeros((0, 0)))

    def vectors() -> Field:
        m = F.lit([row.tolist() for row in u])
        every = None
        for j, one in enumerate(basis):
            own = one.withColumn("j", F.lit(j))
            every = own if every is None else every.unionByName(own)
        terms = every.select("i", F.posexplode(F.get(m, c("j"))).alias("k", "u"), "v")
        return replace(v0, df=terms.groupBy(c("k").cast("long").alias("k"), "i").agg(F.sum(c("u") * c("v")).alias("v")), keys=("k",), dense=True)

    return values, vectors
