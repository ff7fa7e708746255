"""Station code expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
XPT_PREFIX = "XPT"   # cross-docking points report to their superior hub
CODE_MARKER = "X"    # trailing marker on some superior codes
CODE_KEEP = 10       # length of a code without the marker
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_marker(code, marker: str = CODE_MARKER, keep: int = CODE_KEEP) -> Column:
    """Cut ``code`` to ``keep`` chars when it ends in ``marker``."""
    code = _c(code)
    return F.when(code.endswith(F.lit(marker)), F.substring(code, 1, keep)).otherwise(code)


def hub_code(station_code, superior_code) -> Column:
    """Hub of a station: the (trimmed) superior code for XPT stations, else the
    station's own code."""
    station_code = _c(station_code)
    return F.when(
        F.substring(station_code, 1, len(XPT_PREFIX)) == XPT_PREFIX, trim_marker(superior_code)
    ).otherwise(station_code)


def prefix_any(col, prefixes) -> Column:
    """True when ``col`` starts with any of ``prefixes`` (SQL ``LIKE 'p%' OR ...``)."""
    col = _c(col)
    return reduce(lambda a, b: a | b, [col.startswith(F.lit(p)) for p in prefixes])
