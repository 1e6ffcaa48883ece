"""Algebraic rewriting of operator lists, before anything reaches Catalyst (which does no algebra on doubles)."""

from __future__ import annotations

from contextlib import contextmanager


class RuleManager:
    """``rules['none'] = True`` switches rewriting off; ``with rules(none=True):`` does so for a block."""

    def __init__(self):
        self.settings = {"none": False}

    def register(self, name: str, default: bool = False) -> None:
        self.settings.setdefault(name, default)

    def __getitem__(self, name):
        return self.settings[name]

    def __setitem__(self, name, value):
        if name not in self.settings:
            raise KeyError(name)
        self.settings[name] = value

    @contextmanager
    def __call__(self, **new):
        before = dict(self.settings)
        for k, v in new.items():
            self[k] = v
        try:
            yield self
        finally:
            self.settings = before


rule_manager = RuleManager()
#: (kind, left class, right class, rule); rule(a, b) gives a list of operators, or None if it does not apply.
BINARY: list[tuple] = []


def binary(kind: str, left: type, right: type):
    """Registers a rule for two neighbours; those for more derived classes come first."""

    def put(rule):
        BINARY.append((kind, left, right, rule))
        BINARY.sort(key=lambda r: -(len(r[1].__mro__) + len(r[2].__mro__)))
        return rule

    return put


def _pair(kind: str, a, b):
    for op, other, side in ((a, b, "left"), (b, a, "right")):
        for (cls, where), rule in ((k, r) for k, r in op.rules.items() if isinstance(k, tuple)):
            if where == side and isinstance(other, cls) and (got := rule(a, b)) is not None:
                return got
    for k, left, right, rule in BINARY:
        if k == kind and isinstance(a, left) and isinstance(b, right) and (got := rule(a, b)) is not None:
            return got
    return None


def simplify(ops: list, kind: str) -> list:
    """Applies rules to neighbours (to all pairs, if the order doesn't matter) until none does."""
    import opweave.operators.rewrites  # noqa: F401  registers the rules

    if rule_manager["none"]:
        return ops
    again = True
    while again and len(ops) > 1:
        again = False
        n = len(ops)
        pairs = [(i, i + 1) for i in reversed(range(n - 1))] if kind == "compose" else [(i, j) for i in range(n) for j in range(n) if i != j]
        for i, j in pairs:
            got = _pair(kind, ops[i], ops[j])
            if got is not None:
                rest = [o for k, o in enumerate(ops) if k not in (i, j)]
                at = min(i, j)
                ops = rest[:at] + list(got) + rest[at:]
                again = True
                break
    return ops
