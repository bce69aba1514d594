"""Runnable queries over the given tables; importing this package registers them all."""

from quantframe.plans import (  # noqa: F401  (stream queries reuse earlier twins, so they come last)
    account_queries,
    evaluation_queries,
    market_queries,
    model_queries,
    panel_queries,
    text_queries,
    stream_queries,
)
from quantframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
