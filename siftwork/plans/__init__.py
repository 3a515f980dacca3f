"""Queries over the driver's tables."""

from . import catalog, exchange

__all__ = ["catalog", "exchange"]
