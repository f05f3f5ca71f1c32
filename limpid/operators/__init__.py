"""The operators of pipelines. Each is a function (table, params, context) -> Table under its name in REGISTRY."""

from limpid.operators import columns, dedup, join, rows, summarize  # noqa: F401
from limpid.operators.registry import REGISTRY, Context, operator

__all__ = ["REGISTRY", "Context", "operator"]
