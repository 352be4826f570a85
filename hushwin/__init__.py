"""hushwin: event-time windows over quiet streams, on Spark.

A stream whose messages arrive rarely holds its watermark still between
messages, so a finished window can wait a long time for its answer. This
package provides DataFrame operators (bounded replays and Structured
Streaming) to decode keyed JSON records, assign tumbling windows, keep the
highest-valued record per key and window, track bounded-out-of-orderness
watermarks and late rows, exclude idle inputs, project event time forward
with heartbeats, close windows on an idle timeout and measure how long each
window waited to close.
"""

from hushwin.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
