"""Know what one row of a DataFrame stands for."""

from rowgrain.frame import GrainedFrame, requires_grain, safe_join_aggregate
from rowgrain.sources.tables import from_rows, read, source
from rowgrain.spec import FD, FanTrap, GrainError, GrainLost, GrainMismatch, GrainSpec, MissingColumns

__all__ = [
    "FD", "FanTrap", "GrainError", "GrainLost", "GrainMismatch", "GrainSpec", "GrainedFrame",
    "MissingColumns", "from_rows", "read", "requires_grain", "safe_join_aggregate", "source",
]
