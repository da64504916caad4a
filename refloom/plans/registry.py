"""All queries of the core and their SQL."""

from __future__ import annotations

from refloom.plans import citations, packs, texts

QUERIES = {**citations.QUERIES, **texts.QUERIES, **packs.QUERIES}
ORACLES = {**citations.ORACLES, **texts.ORACLES, **packs.ORACLES}
