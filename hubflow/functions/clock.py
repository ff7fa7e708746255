"""Clock-of-day expressions.

Times of day are ints ``HHMM`` (13:07 -> 1307), so "one hour" is 100. Planned
windows arrive as ``H:MM:SS`` / ``HH:MM:SS`` text and are cut to ``HH:MM``.
A window whose open bound is greater than its close bound passes midnight.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: these strings and numbers appear in the reports --------
LABEL_SEP = " às "                 # "06:00 às 12:00"
OUTSIDE_LABEL = "fora da janela"   # label of receipts outside every window
EARLY_OPEN = 2330                  # expanded open bound when open < 100
LATE_CLOSE = 2359                  # expanded close bound when close > 2259
# Label parts, from "HH:MM às HH:MM": (pattern, group)
LABEL_PATTERNS = {
    "start_hour": (r"^(\d{2}):", 1),
    "start_minute": (r"^(\d{2}):(\d{2})", 2),
    "end_hour": (r"(\d{2}):\d{2}$", 1),
    "end_minute": (r"(\d{2}):(\d{2})$", 2),
}
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_int(ts) -> Column:
    """Instant -> clock of day as int HHMM."""
    ts = _c(ts)
    return (F.hour(ts) * 100 + F.minute(ts)).cast("int")


def clock_text(raw) -> Column:
    """Planned time text -> 'HH:MM': left-pad to 8 with '0', keep 5 chars.

    '9:30:00' -> '09:30'; a 5-char '06:00' becomes '00006' (still an int)."""
    return F.substring(F.lpad(_c(raw), 8, "0"), 1, 5)


def hhmm_from_text(text) -> Column:
    """'HH:MM' -> int HHMM; NULL when the text is not a number without ':'."""
    return F.replace(_c(text), F.lit(":"), F.lit("")).try_cast("int")


def expand_open(lo) -> Column:
    """Open bound one hour earlier; before 01:00 it becomes 23:30."""
    lo = _c(lo)
    return F.when(lo < 100, F.lit(EARLY_OPEN)).otherwise(lo - 100)


def expand_close(hi) -> Column:
    """Close bound one hour later; after 22:59 it becomes 23:59."""
    hi = _c(hi)
    return F.when(hi > 2259, F.lit(LATE_CLOSE)).otherwise(hi + 100)


def pad4(hhmm) -> Column:
    """Int HHMM -> 4-char text, zero padded (NULL stays NULL)."""
    return F.lpad(_c(hhmm).cast("string"), 4, "0")


def span_label(a, b) -> Column:
    """'a às b'; NULL when either side is NULL."""
    return F.concat(_c(a), F.lit(LABEL_SEP), _c(b))


def inside_cyclic(hm, lo, hi) -> Column:
    """1 when clock ``hm`` lies in [lo, hi], wrapping at midnight when lo > hi;
    0 otherwise, also for NULL bounds."""
    hm, lo, hi = _c(hm), _c(lo), _c(hi)
    wrapped = F.when((hm >= lo) | (hm <= hi), 1).otherwise(0)
    plain = F.when(hm.between(lo, hi), 1).otherwise(0)
    return F.when(lo > hi, wrapped).otherwise(plain)


def base_date(day, hm, lo, hi, default_own_day: bool = False) -> Column:
    """Business date of an event in a window.

    In a window that passes midnight, the part after midnight (hm <= hi)
    belongs to the day before. With ``default_own_day`` the event's own date is
    kept when it lies in neither part (dispatch rule); otherwise it is NULL
    there (receive rule)."""
    day, hm, lo, hi = _c(day), _c(hm), _c(lo), _c(hi)
    wrapped = F.when(hm >= lo, day).when(hm <= hi, F.date_sub(day, 1))
    if default_own_day:
        wrapped = wrapped.otherwise(day)
    return F.when(lo > hi, wrapped).otherwise(day)


def label_clock(label, part: str) -> Column:
    """Int hour or minute pulled out of a 'HH:MM às HH:MM' label; NULL when
    the label does not have that shape."""
    pattern, group = LABEL_PATTERNS[part]
    text = F.regexp_extract(_c(label), pattern, group)
    return F.nullif(text, F.lit("")).cast("int")


def label_instant(day, label, side: str) -> Column:
    """Instant of the label's start ('start') or end ('end') on ``day``:
    midnight of ``day`` plus the label's hours and minutes (NULL if unparsable)."""
    hour = label_clock(label, f"{side}_hour")
    minute = label_clock(label, f"{side}_minute")
    return _c(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def minutes_between(a, b) -> Column:
    """Whole minutes from a to b, truncated toward zero (negative if b < a)."""
    return F.timestamp_diff("MINUTE", _c(a), _c(b))


def load_stamp(as_of_ts=None, hours: int = 11) -> Column:
    """Load time stamp: ``as_of_ts`` (default: the session's local now) minus
    ``hours``, as a timestamp without time zone."""
    if as_of_ts is None:
        now = F.localtimestamp()
    elif isinstance(as_of_ts, Column):
        now = as_of_ts
    else:
        now = F.lit(str(as_of_ts)).cast("timestamp_ntz")
    return now - F.make_dt_interval(F.lit(0), F.lit(hours))
