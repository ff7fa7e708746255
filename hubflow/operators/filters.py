"""Row filters. Each keeps a plain column on one side so that Catalyst can
push it into the parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.functions.clock import OUTSIDE_LABEL

# fixed values: station ids that mean "no station"
SENTINEL_IDS = ["-", "?", ".", "", "Inativo", "Inactive"]


def drop_sentinels(df: DataFrame, col: str = "station_id", values: Iterable[str] = SENTINEL_IDS) -> DataFrame:
    """Drop rows whose ``col`` is a sentinel text; NULL ids drop too (NOT IN)."""
    return df.filter(~F.col(col).isin(list(values)))


def is_first_attempt(attempt_col: str) -> Column:
    return F.col(attempt_col) == 1


def first_attempt(df: DataFrame, attempt_col: str) -> DataFrame:
    """Keep first attempts (``attempt_col = 1``)."""
    return df.filter(is_first_attempt(attempt_col))


def _as_date(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.to_date(F.lit(str(as_of)))


def in_rolling_days(date_col: str, as_of=None, first: int = 30, last: int = 1) -> Column:
    """``date_col`` in [as_of - first, as_of - last], both ends inclusive.
    ``as_of`` is a date, its text or a Column, today by default; a literal
    folds to constants and the range is pushed to the scan."""
    day = _as_date(as_of)
    return F.col(date_col).between(F.date_sub(day, first), F.date_sub(day, last))


def rolling_days(df: DataFrame, date_col: str, as_of=None, first: int = 30, last: int = 1) -> DataFrame:
    """Keep the rows ``in_rolling_days``."""
    return df.filter(in_rolling_days(date_col, as_of, first, last))


def require_text(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows where every ``cols`` is neither NULL nor empty."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in cols])
    return df.filter(cond)


def drop_label(df: DataFrame, col: str = "window_label", label: str = OUTSIDE_LABEL) -> DataFrame:
    """Keep rows whose label differs from ``label``; NULL labels drop too."""
    return df.filter(F.col(col) != label)


def status_in(df: DataFrame, col: str, codes: Iterable) -> DataFrame:
    """Keep rows whose status code is in ``codes``."""
    return df.filter(F.col(col).isin(list(codes)))


def slice_dim(df: DataFrame, **equals) -> DataFrame:
    """Keep rows where each named column equals the given constant."""
    cond = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in equals.items()])
    return df.filter(cond)
