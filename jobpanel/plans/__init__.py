"""Queries over the driver's tables, one module per family."""

from . import cleaning, fits, panels, regressions, texts, topic_models, words  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
