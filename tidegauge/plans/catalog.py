"""All registered queries of the analytics engine."""

from __future__ import annotations

from . import attribution, backtests, ensembles, market, scoring, series, volatility  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
