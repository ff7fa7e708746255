"""Durations, rates and shares (all in DOUBLE, rounded as the reports show)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share_pct(part, whole, scale: int | None = None) -> Column:
    """100 * part / whole rounded to 2 decimals, computed in DOUBLE.

    ``scale=1`` instead rounds the quotient to one decimal first, the way a
    warehouse with decimal division of a 1-decimal literal would."""
    pct = F.lit(100.0) * _c(part).cast("double") / _c(whole).cast("double")
    if scale is not None:
        pct = F.round(pct, scale)
    return F.round(pct, 2)


def hours(minutes) -> Column:
    """Minutes -> hours with 2 decimals."""
    return F.round(_c(minutes).cast("double") / 60, 2)


def duration_gap(a, b) -> Column:
    """a - b, NULL when either is NULL."""
    return _c(a) - _c(b)


def rate_per_hour(total, minutes) -> Column:
    """floor(total / minutes * 60) as int; NULL for 0 or NULL minutes."""
    per_min = _c(total).cast("double") / F.nullif(_c(minutes), F.lit(0))
    return F.floor(per_min * 60).cast("int")


def rate_per_operator(total, operators) -> Column:
    """floor(total / operators) as int; NULL for 0 or NULL operators."""
    return F.floor(_c(total).cast("double") / F.nullif(_c(operators), F.lit(0))).cast("int")


def instant_text(ts) -> Column:
    """Instant (timestamp without time zone) -> 'YYYY-MM-DD HH:MM'.

    Cut from the value's own text rather than ``date_format``, which would
    pass through the session time zone (and shift wall times that fall in a
    daylight-saving gap of that zone)."""
    return F.substring(_c(ts).cast("timestamp_ntz").cast("string"), 1, len("yyyy-MM-dd HH:mm"))
