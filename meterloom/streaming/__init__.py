"""The same operators over unbounded input."""

from meterloom.streaming.streams import (
    stream_add_peaks,
    stream_adjusted,
    stream_count_trigger,
    stream_dayslot,
    stream_join_forecast,
    stream_lines,
    stream_moving_average,
    stream_peaks,
    stream_periodic_index,
    stream_raw_index,
    stream_readings,
    stream_time_grid,
    stream_wordcount,
)
from meterloom.streaming.writers import (
    merge_profile,
    read_profile,
    write_stream,
    write_stream_adjusted,
    write_stream_batches,
    write_stream_points,
    write_stream_profile,
)

__all__ = [
    "merge_profile",
    "read_profile",
    "stream_add_peaks",
    "stream_adjusted",
    "stream_count_trigger",
    "stream_dayslot",
    "stream_join_forecast",
    "stream_lines",
    "stream_moving_average",
    "stream_peaks",
    "stream_periodic_index",
    "stream_raw_index",
    "stream_readings",
    "stream_time_grid",
    "stream_wordcount",
    "write_stream",
    "write_stream_adjusted",
    "write_stream_batches",
    "write_stream_points",
    "write_stream_profile",
]
