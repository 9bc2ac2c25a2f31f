"""Observations as a stream: checked as they come, merged in windows of a cycle's time slots, cycle by cycle."""

from .windows import assimilation_windows, slots, to_cycles

__all__ = ["assimilation_windows", "slots", "to_cycles"]
