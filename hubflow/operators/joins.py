"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Over how many keys rows with a NULL key are dealt.
NULL_SALTS = 4096


def anti_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose ``key`` does not occur in ``right`` (LEFT ANTI).
    Rows with a NULL key always stay.

    ``left`` is read once: NULL keys travel through the same join, dealt over
    many keys that ``right`` can't have, so they don't meet in one task. The
    ids of ``right`` are not deduplicated: both sides then are plain shuffles,
    in which AQE splits the partitions of a hot key."""
    k = F.col(key)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(NULL_SALTS)) + 1
    zero = F.lit(0).cast(left.schema[key].dataType)
    rows = left.withColumns({"_anti_key": F.coalesce(k, zero), "_anti_salt": F.when(k.isNull(), salt).otherwise(F.lit(0).cast("long"))})
    ids = right.filter(k.isNotNull()).select(k.alias("_anti_key"), F.lit(0).cast("long").alias("_anti_salt"))
    return rows.join(ids, ["_anti_key", "_anti_salt"], "left_anti").drop("_anti_key", "_anti_salt")
