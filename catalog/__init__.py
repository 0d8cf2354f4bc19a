"""Registered queries: the library's operators bound to the given tables, with SQL counterparts."""

from importlib import import_module

MODULES = ("io", "quality", "expr", "pairs", "agg", "windows", "rank", "metrics", "shift", "resample", "models", "jobs")


def registry():
    from . import base

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return base.REGISTRY
