"""The query modules of the core."""

from __future__ import annotations

from types import ModuleType

from plumbline.plans import corpus, delivery, graphs, requests, ruled, scored, streams

FLAGSHIP = "score_metrics"


def modules() -> list[ModuleType]:
    """Modules with ``QUERIES`` and ``SQL``."""
    return [scored, ruled, graphs, corpus, requests, delivery, streams]
