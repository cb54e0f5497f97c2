"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from . import indicators, land_change, observations, space_and_text  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
