"""All queries of the core and their SQL twins."""

from __future__ import annotations

from wayfold.plans import capture, clouds, detections, evaluation, files, geometry, measurements, motion, perception, quality, risk, state, summaries

_MODULES = [capture, clouds, detections, evaluation, files, geometry, measurements, motion, perception, quality, risk, state, summaries]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in _MODULES for name, q in getattr(m, "ORACLES", {}).items()}
