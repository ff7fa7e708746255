"""Column expressions used by the operators. Pure Spark built-ins, so they stay
inside whole-stage codegen."""

from hubflow.functions.clock import (  # noqa: F401
    LABEL_SEP,
    OUTSIDE_LABEL,
    base_date,
    clock_int,
    clock_text,
    expand_close,
    expand_open,
    hhmm_from_text,
    inside_cyclic,
    label_clock,
    label_instant,
    load_stamp,
    minutes_between,
    pad4,
    span_label,
)
from hubflow.functions.codes import hub_code, prefix_any, trim_marker  # noqa: F401
from hubflow.functions.rates import (  # noqa: F401
    duration_gap,
    hours,
    instant_text,
    rate_per_hour,
    rate_per_operator,
    share_pct,
)
