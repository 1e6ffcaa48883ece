"""The queries of this subpackage; ``queries`` names the modules that hold them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ann", "jaccard", "fingerprint", "toxicity", "pieces", "lm", "pii", "dedup", "mixing", "urls")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"opweave.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
