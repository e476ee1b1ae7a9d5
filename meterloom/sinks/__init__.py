"""Writers of points, profiles and synthetic readings."""

from meterloom.sinks.writers import (
    BATCH_POINTS,
    point_to_csv,
    points,
    to_activity_lines,
    to_line_protocol,
    to_synthetic_lines,
    write_activity,
    write_line_batches,
    write_line_protocol,
    write_points,
    write_synthetic,
)

__all__ = [
    "BATCH_POINTS",
    "point_to_csv",
    "points",
    "to_activity_lines",
    "to_line_protocol",
    "to_synthetic_lines",
    "write_activity",
    "write_line_batches",
    "write_line_protocol",
    "write_points",
    "write_synthetic",
]
