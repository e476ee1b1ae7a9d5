"""Readers and generators of readings."""

from meterloom.sources.grid import gap_fill, time_grid, time_grid_range
from meterloom.sources.readers import (
    parse_activity,
    parse_dayslot,
    parse_temperature_seed,
    parse_weather,
    read_activity,
    read_dayslot,
    read_lines,
    read_temperature_seed,
    read_weather,
)

__all__ = [
    "gap_fill",
    "parse_activity",
    "parse_dayslot",
    "parse_temperature_seed",
    "parse_weather",
    "read_activity",
    "read_dayslot",
    "read_lines",
    "read_temperature_seed",
    "read_weather",
    "time_grid",
    "time_grid_range",
]
