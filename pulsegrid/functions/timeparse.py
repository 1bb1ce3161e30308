"""Time parsing and calendar keys (F1-F6), all native Spark expressions.

Two clocks are kept for every reading (deviation D1): the *instant*
(TIMESTAMP, correct across UTC offsets, used for durations) and the *wall
clock as written* (TIMESTAMP_NTZ, used for day, hour and week keys).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.model import EXPORT_TS_PATTERN, NIGHT_CUTOFF_HOUR


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_instant(raw) -> Column:
    """export date text -> TIMESTAMP instant; unparseable -> NULL."""
    raw = _c(raw)
    return F.coalesce(
        F.try_to_timestamp(raw, F.lit(EXPORT_TS_PATTERN)),
        raw.try_cast("timestamp"),
    )


def parse_local(raw) -> Column:
    """export date text -> wall clock as written (TIMESTAMP_NTZ); bad -> NULL.

    The instant must parse as well, so a string that is not a date at all
    yields NULL on both clocks.
    """
    raw = _c(raw)
    wall = F.substring(F.trim(raw), 1, 19).try_cast("timestamp_ntz")
    return F.when(parse_instant(raw).isNotNull(), wall)


# Numbers as text: decimal or exponent notation, or infinity.  The guard keeps
# out type suffixes ('1d', '2f') that the cast alone would accept.
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def parse_double(raw) -> Column:
    """F2 + P17: text -> DOUBLE; NULL, empty or unparseable -> NULL (never
    raises).  'nan' also becomes NULL: it means missing, and Spark would
    otherwise carry NaN through every aggregate."""
    raw = _c(raw)
    return F.when(raw.rlike(NUMBER), F.trim(raw).try_cast("double"))


def day(ts_local) -> Column:
    """calendar day of the wall clock."""
    return F.to_date(_c(ts_local))


def night_of(ts_local, cutoff_hour: int = NIGHT_CUTOFF_HOUR) -> Column:
    """the night a sleep interval belongs to: its start day, minus one
    day when it starts before ``cutoff_hour``."""
    ts = _c(ts_local)
    return F.date_sub(F.to_date(ts), F.when(F.hour(ts) < cutoff_hour, 1).otherwise(0))


def duration_hours(start_ts, end_ts) -> Column:
    """interval length in hours from the two instants (microsecond exact)."""
    s = _c(start_ts).cast("timestamp")
    e = _c(end_ts).cast("timestamp")
    return (F.unix_micros(e) - F.unix_micros(s)) / F.lit(3_600_000_000.0)


def week_start(ts_local) -> Column:
    """Monday of the wall-clock week."""
    return F.to_date(F.date_trunc("week", _c(ts_local)))
