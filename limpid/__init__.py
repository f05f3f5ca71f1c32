"""Cleaning, reconciling, summarising and reporting on tables, as lazy Spark plans.

Names are loaded on first use, so that Python workers which need one module don't load all.
"""

import importlib

_HOME = {"Pipeline": "limpid.plans.pipeline", "Step": "limpid.plans.pipeline", "Table": "limpid.table"}
__all__ = [*_HOME]


def __getattr__(name: str):
    if name in _HOME:
        return getattr(importlib.import_module(_HOME[name]), name)
    raise AttributeError(name)
