"""Steps, event-time aggregates, sessions and de-duplication on streams."""
from .steps import stream_steps, write_stream
from .windows import distinct_rows, late_rows, session_aggregates, window_aggregates

__all__ = ["distinct_rows", "late_rows", "session_aggregates", "stream_steps", "window_aggregates", "write_stream"]
