"""DataFrame -> DataFrame operators."""

from hubflow.operators.backlog import (  # noqa: F401
    hub_lookup,
    hub_rows,
    latest_per_key,
    latest_snapshot,
    max_per_key,
    station_dim,
    status_pivot,
)
from hubflow.operators.classify import (  # noqa: F401
    DISPATCH_KEYS,
    RECEIPT_KEYS,
    all_receipts,
    classify_dispatches,
    classify_receipts,
    dispatch_rows,
    dispatches_inside,
    fact_events,
    receipt_rows,
    receipts_inside,
    receipts_outside,
)
from hubflow.operators.curve import curve_stats, overnight_end, overnight_start  # noqa: F401
from hubflow.operators.filters import (  # noqa: F401
    drop_label,
    drop_sentinels,
    first_attempt,
    require_text,
    rolling_days,
    slice_dim,
    status_in,
)
from hubflow.operators.joins import anti_join  # noqa: F401
from hubflow.operators.profile import hour_profile, hour_shares, window_shares, window_totals  # noqa: F401
from hubflow.operators.segments import (  # noqa: F401
    DISPATCH,
    RECEIVE,
    hour_cells,
    hour_cover,
    placed_events,
    segment_counts,
    segment_profile,
    window_dictionary,
)
from hubflow.operators.staffing import (  # noqa: F401
    count_operators,
    hour_cuts,
    operator_scans,
    operators_in_dispatch,
    operators_per_window,
    scan_rows,
    scan_segments,
    window_intervals,
)
from hubflow.operators.windows import expanded_windows, planned_windows, window_table  # noqa: F401
