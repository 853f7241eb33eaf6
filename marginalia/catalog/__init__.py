"""Checked queries over the given tables; importing the modules registers them."""

from marginalia.catalog import batch, fields, intake, scored, streams, rendered, written  # noqa: F401
from marginalia.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
