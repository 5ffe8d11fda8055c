"""The query catalogue: every module of plans registers its queries when it is imported."""

from tidelog.plans import changes, files, formats, gtids, logs, relays, scalars, sources, statistics, streams  # noqa: F401
from tidelog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
