"""Every relational, graph and text operator bound to the driver's tables, with its SQL."""

from __future__ import annotations

from . import criteria, gates, graphs, more, relational, states, texts, windows  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
