"""The operators that run on streams: stateless tags and fills, daily values with a watermark, tags that need the last
value of a series, and slopes and the slope filter in order of event time."""

from .adapters import daily_average_stream, last_value_stream, tag_stream
from .ordered import slope_filter_stream, slopes_stream

__all__ = ["daily_average_stream", "last_value_stream", "slope_filter_stream", "slopes_stream", "tag_stream"]
