"""All registered queries of the engine's own operators."""

from sampletide.queries import config, digests, events, rules, sampling, sources  # noqa: F401
from sampletide.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
