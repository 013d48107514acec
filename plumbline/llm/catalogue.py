"""The query modules of the package."""

from __future__ import annotations

from types import ModuleType

from plumbline.llm import queries


def modules() -> list[ModuleType]:
    """Modules with ``QUERIES`` and ``SQL``."""
    return [queries]
