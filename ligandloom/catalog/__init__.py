"""Runnable queries over the given tables, one per operator, with their SQL twins."""

from ligandloom.catalog import (  # noqa: F401  (registration)
    docking,
    documents,
    files,
    learning,
    measurements,
    metrics,
    quality,
    replies,
    training,
    vectors,
)
from ligandloom.catalog.registry import REGISTRY  # noqa: F401
