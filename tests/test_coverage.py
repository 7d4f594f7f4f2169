"""Every name of COVERAGE.md exists, and no id has two lines."""

import importlib
import os
import pkgutil
import re

from folio.plans import registry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_exist():
    modules = {}
    for part in ("functions", "operators", "sources", "streaming"):
        package = importlib.import_module(f"folio.{part}")
        modules |= {m.name: f"folio.{part}.{m.name}" for m in pkgutil.iter_modules(package.__path__)}
    with open(f"{HERE}/COVERAGE.md") as f:
        rows = re.findall(r"^\| (\d+b?\.\d+) \| `([\w.]+)` \| ([a-z, SQL]+) \|", f.read(), re.MULTILINE)
    assert len(rows) > 400 and len({i for i, *_ in rows}) == len(rows)
    for _, name, kind in rows:
        module, _, function = name.rpartition(".")
        if module:
            assert kind == "function" and hasattr(importlib.import_module(modules[module]), function), name
        else:
            assert kind == ("query, SQL" if name in registry.ORACLE else "query") and name in registry.QUERIES, name
