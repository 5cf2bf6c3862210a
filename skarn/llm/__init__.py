"""Operators for preparing training data. Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable


def queries() -> dict[str, Callable]:
    from skarn.llm import registry

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    from skarn.llm import registry

    return dict(registry.ORACLES)
