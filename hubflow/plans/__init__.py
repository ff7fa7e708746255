"""End-to-end jobs and the registered queries."""

from hubflow.plans.backlog import backlog_report, backlog_rows  # noqa: F401
from hubflow.plans.shift import (  # noqa: F401
    ShiftFrames,
    curve_productivity,
    shift_frames,
    shift_productivity,
)
