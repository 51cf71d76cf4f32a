"""Registered queries over the driver tables."""

from . import analyses, dynamics, formats, graphs, imaging, order, physics, spatial, statistics  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
