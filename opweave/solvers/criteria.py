"""Norms, criteria, line searches and minimisers (nonlinear conjugate gradients, BFGS, Newton, Powell, projected
gradients, double loop). Those whose name ends in ``_field``, criteria and line searches take fields."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from opweave.expr import Field, accumulated, asoperator
from opweave.session import written
from opweave.solvers.cg import LanczosAlgorithm, lanczos_field, pcg
from opweave.solvers.core import NEVER, IterativeAlgorithm, Stop, steps_done, when


class Norm:
    """value(t) and its derivative; ``column`` is the summand of value as an expression."""

    factor = 1.0

    def value(self, t) -> float:
        raise NotImplementedError

    def derivative(self, t):
        raise NotImplementedError

    def column(self, c: Column) -> Column:
        raise NotImplementedError

    def slope(self, c: Column) -> Column:
        """The derivative as an expression."""
        raise NotImplementedError

    def of(self, f: Field) -> float:
        return self.factor * (f.df.agg(F.sum(self.column(F.col("v")))).first()[0] or 0.0)

    def __call__(self, t):
        return self.of(t) if isinstance(t, Field) else self.factor * self.value(np.asarray(t))

    def gradient(self, t):
        if isinstance(t, Field):
            t = t.densified()
            return t.values(self.factor * self.slope(F.col("v")))
        return self.factor * self.derivative(np.asarray(t))

    def __mul__(self, a):
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__, factor=self.factor * a)
        return out

    __rmul__ = __mul__


class Norm2(Norm):
    """t C t, with C the identity by default."""

    def __init__(self, C=None):
        self.C = asoperator(C) if C is not None else None

    def value(self, t):
        return float(np.sum(t * (self.C(t) if self.C else t)))

    def derivative(self, t):
        return 2 * (self.C(t) if self.C else t)

    def column(self, c):
        return c * c

    def slope(self, c):
        return 2 * c

    def of(self, f):
        if self.C is None:
            return super().of(f)
        both = accumulated(self.C(f), f, "multiply")
        return self.factor * (both.df.agg(F.sum("v")).first()[0] or 0.0)

    def gradient(self, t):
        return super().gradient(self.C(t) if self.C is not None and isinstance(t, Field) else t)


class Huber(Norm):
    """t² below delta, then 2 delta |t| - delta²."""

    def __init__(self, delta: float):
        self.delta = delta

    def value(self, t):
        a = np.abs(t)
        return float(np.where(a < self.delta, t * t, 2 * self.delta * a - self.delta**2).sum())

    def derivative(self, t):
        return np.where(np.abs(t) < self.delta, 2 * t, 2 * self.delta * np.sign(t))

    def column(self, c):
        return F.when(F.abs(c) < self.delta, c * c).otherwise(2 * self.delta * F.abs(c) - self.delta**2)

    def slope(self, c):
        return F.when(F.abs(c) < self.delta, 2 * c).otherwise(2 * self.delta * F.signum(c))


class Normp(Norm):
    def __init__(self, p: float):
        self.p = p

    def value(self, t):
        return float((np.abs(t) ** self.p).sum())

    def derivative(self, t):
        return self.p * np.sign(t) * np.abs(t) ** (self.p - 1)

    def column(self, c):
        return F.pow(F.abs(c), F.lit(float(self.p)))

    def slope(self, c):
        return self.p * F.signum(c) * F.pow(F.abs(c), F.lit(float(self.p - 1)))


class CriterionElement:
    """norm(op x - data), of an array or of a field."""

    def __init__(self, norm: Norm, op, data=None):
        self.norm, self.op, self.data = norm, asoperator(op), data

    def residual(self, x):
        y = self.op(x)
        if self.data is None:
            return y
        return accumulated(self.data, y, "subtract") if isinstance(y, Field) else y - self.data

    def __call__(self, x):
        return self.norm(self.residual(x))

    def gradient(self, x):
        return self.op.T(self.norm.gradient(self.residual(x)))

    def __mul__(self, a):
        return CriterionElement(self.norm * a, self.op, self.data)

    __rmul__ = __mul__

    def __add__(self, other):
        return Criterion([self]) + other


class Criterion:
    def __init__(self, elements):
        self.elements = list(elements)

    def __call__(self, x):
        return sum(e(x) for e in self.elements)

    def gradient(self, x):
        out = [e.gradient(x) for e in self.elements]
        if not isinstance(x, Field):
            return sum(out)
        df = out[0].df.select("i", "v")
        for g in out[1:]:
            df = df.unionByName(g.df.select("i", "v"))
        return Field(df.groupBy("i").agg(F.sum("v").alias("v")), x.n, dense=all(g.dense for g in out))

    def __add__(self, other):
        return Criterion(self.elements + (other.elements if isinstance(other, Criterion) else [other]))

    def __mul__(self, a):
        return Criterion([e * a for e in self.elements])

    __rmul__ = __mul__


def _criterion(norm0: Norm, model, data, hypers, priors, norms) -> Criterion:
    return Criterion([CriterionElement(norm0, model, data), *(CriterionElement(n * h, p) for h, p, n in zip(hypers, priors, norms))])


def quadratic_criterion(model, data, hypers=(), priors=(), covariances=None) -> Criterion:
    c = covariances or [None] * (len(priors) + 1)
    return _criterion(Norm2(c[0]), model, data, hypers, priors, [Norm2(x) for x in c[1:]])


def huber_criterion(model, data, hypers=(), priors=(), deltas=()) -> Criterion:
    return _criterion(Huber(deltas[0]), model, data, hypers, priors, [Huber(d) for d in deltas[1:]])


def normp_criterion(model, data, hypers=(), priors=(), ps=()) -> Criterion:
    return _criterion(Normp(ps[0]), model, data, hypers, priors, [Normp(p) for p in ps[1:]])


def normalize_hyper(hyper, y, x):
    return np.asarray(hyper) * float(np.size(y)) / float(np.size(x))


def optimal_step(criterion: Criterion, x, d, g) -> float:
    """The exact step of a quadratic criterion."""
    return -0.5 * float(d @ g) / sum(e.norm(e.op(d)) for e in criterion.elements)


def backtracking(criterion: Criterion, x, d, g, maxiter: int = 10, tau: float = 0.5) -> float:
    """Halves the step until the criterion falls."""
    a, now = 1.0, criterion(x)
    for _ in range(maxiter):
        if criterion(x + a * d) < now:
            return a
        a *= tau
    return a


def armijo(criterion: Criterion, x, d, g, c1: float = 1e-4, c2: float = 0.9, wolfe: bool = False, maxiter: int = 40) -> float:
    """Armijo's rule, with Wolfe's curvature condition if asked for, by bisection."""
    low, high, a, now, slope = 0.0, float("inf"), 1.0, criterion(x), float(d @ g)
    for _ in range(maxiter):
        if criterion(x + a * d) > now + c1 * a * slope:
            high = a
        elif wolfe and float(d @ criterion.gradient(x + a * d)) < c2 * slope:
            low = a
        else:
            return a
        a = (low + high) / 2 if high < float("inf") else 2 * a
    return a


def fletcher_reeves(g, old) -> float:
    return float(g @ g) / float(old @ old)


def polak_ribiere(g, old) -> float:
    return float(g @ (g - old)) / float(old @ old)


class ConjugateGradient(IterativeAlgorithm):
    """Nonlinear conjugate gradients on a criterion; ends when the gradient's norm is tol of the first one's."""

    def __init__(self, criterion: Criterion, x0, tol: float = 1e-6, maxiter: int = 500, update: Callable = fletcher_reeves, line_search: Callable = optimal_step, callback=None, stop: Stop = NEVER):
        settled = when(lambda a: a.error <= tol, f"the gradient is within {tol:g} of the first")
        super().__init__(settled | steps_done(maxiter) | stop, callback=callback, x=np.asarray(x0, float))
        self.criterion, self.update, self.line_search = criterion, update, line_search

    def initialize(self):
        super().initialize()
        self.g = self.criterion.gradient(self.x)
        self.d, self.first = -self.g, float(np.sqrt(self.g @ self.g))
        self.error = 1.0 if self.first else 0.0

    def iteration(self):
        if float(self.d @ self.g) >= 0:
            self.d = -self.g
        self.x = self.x + self.line_search(self.criterion, self.x, self.d, self.g) * self.d
        g = self.criterion.gradient(self.x)
        self.d, self.g = -g + self.update(g, self.g) * self.d, g
        self.error = float(np.sqrt(g @ g)) / self.first


def conjugate_gradient(criterion: Criterion, x0, tol: float = 1e-6, maxiter: int = 500, update: Callable = fletcher_reeves, line_search: Callable = optimal_step, callback=None) -> np.ndarray:
    told = callback and (lambda a: callback(a.niterations - 1, a.x) if a.niterations else None)
    return ConjugateGradient(criterion, x0, tol, maxiter, update, line_search, told).run()


def conjugate_gradient_field(criterion: Criterion, x0: Field, tol: float = 1e-6, maxiter: int = 100, exact: bool = True) -> Field:
    """Nonlinear conjugate gradients (Polak and Ribière) on a field: x, the direction and the gradient are columns
    of one frame, written once an iteration. ``exact`` takes the step that is right for quadratic criteria,
    else steps are halved until the criterion falls."""
    c, n = F.col, x0.n
    at = lambda s, name: Field(s.select("i", c(name).alias("v")), n)
    s = x0.densified().df.select("i", c("v").alias("x"))
    first = d_g = None
    for k in range(maxiter + 1):
        g = criterion.gradient(at(s, "x")).df.select("i", c("v").alias("new"))
        s = s.join(g, "i", "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
        s = written(s if k else s.withColumns({"g": F.lit(0.0), "d": F.lit(0.0)}))
        gg, turn, old = s.agg(F.sum(c("new") * c("new")), F.sum(c("new") * (c("new") - c("g"))), F.sum(c("g") * c("g"))).first()
        first = gg if first is None else first
        if not first or gg <= tol**2 * first or k == maxiter:
            break
        beta = max(0.0, turn / old) if k else 0.0
        s = s.select("i", "x", c("new").alias("g"), (beta * c("d") - c("new")).alias("d"))
        d_g = s.agg(F.sum(c("d") * c("g"))).first()[0]
        if d_g >= 0:
            s = s.withColumn("d", -c("g"))
            d_g = -gg
        if exact:
            step = -0.5 * d_g / sum(e.norm(e.op(at(s, "d"))) for e in criterion.elements)
        else:
            step, now = 1.0, criterion(at(s, "x"))
            while step > 1e-12 and criterion(at(s.withColumn("t", c("x") + step * c("d")), "t")) >= now:
                step /= 2
        s = s.withColumn("x", c("x") + step * c("d"))
    return at(s, "x")


def acg(model, data, priors=(), hypers=(), covariances=None, **k) -> np.ndarray:
    """Quadratic likelihood and priors."""
    m = asoperator(model)
    hypers = normalize_hyper(hypers, data, np.zeros(m.shapein)) if len(hypers) else hypers
    return conjugate_gradient(quadratic_criterion(m, data, hypers, priors, covariances), np.zeros(m.shapein), **k)


def hacg(model, data, priors=(), hypers=(), deltas=(1.0,), **k) -> np.ndarray:
    """Huber likelihood and priors."""
    m = asoperator(model)
    hypers = normalize_hyper(hypers, data, np.zeros(m.shapein)) if len(hypers) else hypers
    return conjugate_gradient(huber_criterion(m, data, hypers, priors, deltas), np.zeros(m.shapein), **({"line_search": backtracking} | k))


def bfgs(criterion: Criterion, x0, tol: float = 1e-8, maxiter: int = 500, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with a Wolfe line search."""
    x = np.asarray(x0, float)
    g, pairs = criterion.gradient(x), []
    for _ in range(maxiter):
        if np.sqrt(g @ g) <= tol:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step = armijo(criterion, x, -q, g, wolfe=True)
        new = x - step * q
        h = criterion.gradient(new)
        if (new - x) @ (h - g) > 1e-14:
            pairs = [*pairs, (new - x, h - g)][-memory:]
        x, g = new, h
    return x


def newton_cg(criterion: Criterion, x0, tol: float = 1e-8, maxiter: int = 100) -> np.ndarray:
    """Newton steps; the Hessian's products are differences of gradients, its systems are solved by conjugate gradients."""
    x = np.asarray(x0, float)
    g = criterion.gradient(x)
    for _ in range(maxiter):
        size = float(np.sqrt(g @ g))
        if size <= tol:
            break
        d, r, p = np.zeros(len(x)), -g, -g
        for _ in range(2 * len(x)):
            h = 1e-6 * (1 + np.sqrt(x @ x)) / np.sqrt(p @ p)
            q = (criterion.gradient(x + h * p) - criterion.gradient(x - h * p)) / (2 * h)
            curve = float(p @ q)
            if curve <= 0:
                d = d if d.any() else -g
                break
            step = float(r @ r) / curve
            d, new = d + step * p, r - step * q
            if np.sqrt(new @ new) <= min(0.1, size**0.5) * size:
                break
            p, r = new + (new @ new) / (r @ r) * p, new
        x = x + armijo(criterion, x, d, g) * d
        g = criterion.gradient(x)
    return x


def powell(criterion: Callable, x0, tol: float = 1e-10, maxiter: int = 200) -> np.ndarray:
    """Without gradients: line searches (golden section) along directions that follow the progress made."""
    x, ways = np.asarray(x0, float), list(np.eye(len(x0)))
    ratio = (5**0.5 - 1) / 2

    def along(x, d):
        f = lambda t: criterion(x + t * d)
        low, high, now = -1.0, 1.0, f(0.0)
        while f(high) < now:
            low, now, high = 0.0 if low < 0 else high / 2, f(high), 2 * high
        while low < 0 and f(low) < now:
            now, high, low = f(low), 0.0, 2 * low
        while high - low > tol * (1 + abs(low) + abs(high)):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if f(a) < f(b) else (a, high)
        return x + (low + high) / 2 * d

    value = criterion(x)
    for _ in range(maxiter):
        start, gains = x, []
        for d in ways:
            x = along(x, d)
            new = criterion(x)
            gains.append(value - new)
            value = new
        if np.abs(x - start).max() <= tol * (1 + np.abs(x).max()):
            break
        ways.pop(int(np.argmax(gains)))
        ways.append((x - start) / np.sqrt((x - start) @ (x - start)))
        x = along(x, ways[-1])
        value = criterion(x)
        if abs(np.linalg.det(np.array(ways))) < 1e-8:
            ways = list(np.eye(len(x)))
    return x


def bounded(criterion: Criterion, x0, low=-np.inf, high=np.inf, tol: float = 1e-8, maxiter: int = 5000) -> np.ndarray:
    """Projected gradients with Barzilai and Borwein's steps, between bounds."""
    inside = lambda x: np.clip(x, low, high)
    x, step = inside(np.asarray(x0, float)), 1e-3
    g, best = criterion.gradient(x), [criterion(x)]
    for _ in range(maxiter):
        if np.abs(inside(x - g) - x).max() <= tol:
            break
        d, t = inside(x - step * g) - x, 1.0
        while criterion(x + t * d) > max(best[-10:]) + 1e-4 * t * float(g @ d) and t > 1e-12:
            t /= 2
        new = x + t * d
        h = criterion.gradient(new)
        s, y = new - x, h - g
        step = float(s @ s) / float(s @ y) if s @ y > 0 else 1.0
        x, g = new, h
        best.append(criterion(x))
    return x


def constrained(criterion: Criterion, x0, equal=(), above=(), rounds: int = 30, tol: float = 1e-9) -> np.ndarray:
    """An augmented Lagrangian over Powell's method: ``equal`` functions become 0, ``above`` functions 0 or more."""
    x, weight = np.asarray(x0, float), 10.0
    a, b = np.zeros(len(equal)), np.zeros(len(above))
    for _ in range(rounds):

        def whole(x, a=a, b=b, weight=weight):
            e, m = np.array([f(x) for f in equal]), np.array([f(x) for f in above])
            return criterion(x) + a @ e + weight / 2 * (e @ e) + ((np.maximum(0, b - weight * m) ** 2 - b**2).sum() / (2 * weight) if len(m) else 0.0)

        x = powell(whole, x, tol)
        e, m = np.array([f(x) for f in equal]), np.array([f(x) for f in above])
        a, b = a + weight * e, np.maximum(0, b - weight * m)
        if max([0.0, *np.abs(e), *np.maximum(0, -m)]) <= tol:
            break
        weight = min(1e4, 3 * weight)
    return x


#: Minimisers by name: with gradients, without, between bounds, under constraints.
MINIMISERS = {"bfgs": bfgs, "cg": lambda c, x0, **k: conjugate_gradient(c, x0, **({"line_search": armijo, "update": polak_ribiere} | k)), "newton-cg": newton_cg, "powell": powell, "bounded": bounded, "constrained": constrained}


def minimise(criterion: Criterion, x0, method: str = "bfgs", **k) -> np.ndarray:
    if method not in MINIMISERS:
        raise ValueError(f"no method {method!r}; there are {', '.join(MINIMISERS)}")
    return MINIMISERS[method](criterion, x0, **k)


def double_loop(model, data, prior, sigma: float = 1.0, tau: float = 1.0, outer: int = 5, lanczos: int = 300, z0: float = 0.05, inner: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Sparse Bayesian inference: the outer loop approximates posterior variances of prior x by Lanczos, the
    inner one minimises |model x - data|² / sigma² + 2 tau sum sqrt((prior x)² / sigma² + z) by reweighted systems
    until x moves by less than tol of its norm, at most inner times."""
    m, p = asoperator(model), asoperator(prior)
    data = np.asarray(data, float)
    x, z = np.zeros(m.shapein), np.full(p.shapeout, z0)
    for _ in range(outer):
        for _ in range(inner):
            before = x
            gamma = np.sqrt((p(x) / sigma) ** 2 + z) / tau
            a = m.T * m + p.T * asoperator(1 / gamma) * p
            x = pcg(a, m.T(data), x0=x, tol=1e-8)["x"]
            if np.linalg.norm(x - before) <= tol * np.linalg.norm(x):
                break
        e = LanczosAlgorithm(a, maxiter=min(lanczos, m.shapein), orthogonal=True).run()
        v = np.stack([p(c) for c in e.eigenvectors.T])
        z = np.maximum(((v**2).T @ (1 / np.maximum(e.eigenvalues, 1e-12))), 1e-12)
    return x


def double_loop_field(model, data: Field, prior, n: int, sigma: float = 1.0, tau: float = 1.0, outer: int = 3, lanczos: int = 30, z0: float = 0.05, inner: int = 20, tol: float = 1e-4) -> Field:
    """``double_loop`` on fields: systems by ``pcg`` and variances by ``lanczos_field``, each on frames; x and z are
    written once a round."""
    m, p, c = asoperator(model), asoperator(prior), F.col
    spark = data.df.sparkSession
    right = m.T(data)
    right = Field(written(Field(right.df, n, dense=False).densified().df.select("i", "v")), n)
    x = Field(spark.range(n).select(c("id").alias("i"), F.lit(0.0).alias("v")), n)
    z = None
    for _ in range(outer):
        for _ in range(inner):
            gap = p(x).densified().df.select("i", c("v").alias("g"))
            gap = gap.withColumn("z", F.lit(z0)) if z is None else gap.join(z, "i")
            weights = written(gap.select("i", (tau / F.sqrt(F.pow(c("g") / sigma, F.lit(2.0)) + c("z"))).alias("w")))
            a = m.T * m + p.T * asoperator_diagonal(weights) * p
            new = Field(written(pcg(a, right, x0=x, tol=1e-8)["x"].df), n)
            change = accumulated(x, new, "subtract")
            moved, size = Norm2()(change) ** 0.5, Norm2()(new) ** 0.5
            x = new
            if moved <= tol * size:
                break
        start = Field(spark.range(n).select(c("id").alias("i"), F.rand(7).alias("v")), n)
        values, vectors = lanczos_field(a, Field(written(start.df), n), min(lanczos, n))
        lengths = F.lit([max(float(v), 1e-12) for v in values])
        z = p(vectors()).df.groupBy("i").agg(F.greatest(F.sum(c("v") * c("v") / F.get(lengths, c("k").cast("int"))), F.lit(1e-12)).alias("z"))
        z = written(z)
    return x


def asoperator_diagonal(weights):
    from opweave.operators.diagonal import DiagonalOperator

    return DiagonalOperator(weights)
