"""Time notations of board logs, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)? ?([Zz]|UTC|[+-]\d\d(:?\d\d)?)?$"
_ZONED = r"([Zz]|UTC|[+-]\d\d(:?\d\d)?)$"


def epoch_ms(text: Column) -> Column:
    """Milliseconds since the epoch of a time in any of the logs' notations, null where it is unusable.

    ISO date-times with ``T`` or a blank, with a zone, an offset or none (then UTC), and epoch numbers of ten
    (seconds) or thirteen digits (milliseconds). Everything else, impossible dates included, is null.
    """
    t = F.trim(text)
    has_zone = F.substring(t, 17, 40).rlike(_ZONED)
    iso = F.regexp_replace(F.regexp_replace(t, ",", "."), r" ?UTC$|z$", "Z")
    iso = F.when(has_zone, iso).otherwise(F.concat(iso, F.lit("Z")))
    return (
        F.when(t.rlike(r"^\d{13}$"), t.try_cast("bigint"))
        .when(t.rlike(r"^\d{10}$"), t.try_cast("bigint") * 1000)
        .when(t.rlike(_ISO), F.unix_millis(iso.try_cast("timestamp")))
    )


def event_time(text: Column) -> Column:
    """:func:`epoch_ms` as a timestamp."""
    return F.timestamp_millis(epoch_ms(text))
