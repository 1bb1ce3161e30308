"""Classification and labelling expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.model import (
    ANOMALY_THRESHOLD, SLEEP_STAGES, TREND_MIN_POINTS, TREND_STABLE_BELOW, WORKOUT_PREFIX,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def activity_name(raw) -> Column:
    """strip the workout type prefix; a missing type reads as 'None'."""
    return F.replace(F.coalesce(_c(raw), F.lit("None")), F.lit(WORKOUT_PREFIX), F.lit(""))


def sleep_stage(code) -> Column:
    """F8: numeric sleep code -> stage name; anything unmapped -> 'unknown'."""
    pairs = []
    for k, v in SLEEP_STAGES.items():
        pairs += [F.lit(float(k)), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[_c(code).cast("double")], F.lit("unknown"))


def severity(deviation, threshold: float = ANOMALY_THRESHOLD) -> Column:
    """on the unrounded deviation."""
    d = _c(deviation)
    return (F.when(d >= threshold + 1.5, "critical")
            .when(d >= threshold + 0.5, "high")
            .otherwise("moderate"))


def trend_class(n, slope, std, min_points: int = TREND_MIN_POINTS,
                stable_below: float = TREND_STABLE_BELOW) -> Column:
    """insufficient_data / stable / increasing / decreasing."""
    n, slope, std = _c(n), _c(slope), _c(std)
    norm = F.try_divide(slope, std)
    return (F.when(n < min_points, "insufficient_data")
            .when(std == 0, "stable")
            .when(F.abs(norm) < stable_below, "stable")
            .when(norm > 0, "increasing")
            .otherwise("decreasing"))


def polarity_label(direction, polarity) -> Column:
    """improving / declining for metrics with a known good direction."""
    d, p = _c(direction), _c(polarity)
    return (F.when(d.isin("stable", "insufficient_data"), d)
            .when(p == "higher", F.when(d == "increasing", "improving").otherwise("declining"))
            .when(p == "lower", F.when(d == "decreasing", "improving").otherwise("declining"))
            .otherwise(d))


def display_name(metric) -> Column:
    """'_' -> ' ' then title case: a letter is upper-cased when it starts
    the text or follows a non-letter (so 'vo2max' -> 'Vo2Max'), else lower-cased."""
    s = F.replace(_c(metric), F.lit("_"), F.lit(" "))
    chars = F.split(s, "")
    prev_is_letter = lambda i: F.element_at(chars, i).rlike(r"^\p{L}$")
    cased = F.transform(
        chars,
        lambda ch, i: F.when((i == 0) | ~prev_is_letter(i), F.upper(ch)).otherwise(F.lower(ch)),
    )
    return F.array_join(cased, "")


def safe_name(text) -> Column:
    """drop characters unsafe in file names, then trim."""
    return F.trim(F.regexp_replace(_c(text), r'[<>:"/\\|?*]', ""))


def arrow_class(direction) -> Column:
    """up / down / flat ('improving' and 'declining' read as flat)."""
    key = F.lower(F.trim(_c(direction)))
    return (F.when(key.isin("up", "increasing", "rising"), "up")
            .when(key.isin("down", "decreasing", "falling"), "down")
            .otherwise("flat"))


def callout_class(deviation, threshold: float = ANOMALY_THRESHOLD) -> Column:
    """warning when the deviation reaches the threshold, else info."""
    d = _c(deviation)
    return F.when(d.isNotNull() & (F.abs(d) >= threshold), "warning").otherwise("info")


def wow_direction(delta) -> Column:
    """F14 direction part: unchanged below 0.01, else up / down."""
    d = _c(delta)
    return F.when(F.abs(d) < 0.01, "unchanged").when(d > 0, "up").otherwise("down")
