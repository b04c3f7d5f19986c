"""All queries of the engine and their SQL oracles, by name.

Histories, frames, transcripts and event streams come from the driver's tables
by the adapters of voxloom.sources; registries are the part table read as models,
catalogs and settings are literal rows on both sides.
"""

from __future__ import annotations

from voxloom.plans import catalogs, files, histories, streams, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (histories, texts, streams, catalogs, files):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
