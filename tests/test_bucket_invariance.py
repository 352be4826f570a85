"""Every range-dealt operator returns the same rows whatever the number of parts."""

import pytest

from hushwin.operators import idle, latency, routing, watermark, windows
from hushwin.sources import tables

SF = "/root/testdata/sf0.01"

CASES = {
    "late_rows": lambda s, w: watermark.late_rows(tables.jittered(s, SF), 3_600_000, 600_000, parts=w),
    "bounded_watermark": lambda s, w: watermark.bounded_watermark(tables.jittered(s, SF), 600_000, parts=w),
    "idle_intervals": lambda s, w: idle.idle_intervals(tables.idle_fixture(s, SF), 1_200_000, parts=w),
    "round_robin": lambda s, w: routing.round_robin(tables.jittered(s, SF), 4, parts=w),
    "session": lambda s, w: windows.session_keep_max(tables.records(s, SF), 1_800_000, parts=w),
    "heartbeat": lambda s, w: latency.heartbeat_window_close(tables.decoupled(s, SF), 3_600_000, 0, 300_000,
                                                             parts=w),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_parts_do_not_change_results(spark, name):
    assert sorted(map(tuple, CASES[name](spark, 1).collect())) == sorted(map(tuple, CASES[name](spark, 23).collect()))
