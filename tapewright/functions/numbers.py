"""Number and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strict_double(text: Column, invalid: float | None = None) -> Column:
    """The number in a string; NaN, infinities, suffixes and padding count as invalid."""
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    value = F.when(F.abs(value) < float("inf"), value)
    return value if invalid is None else F.coalesce(value, F.lit(float(invalid)))


def fmt8(x: Column) -> Column:
    return F.format_string("%.8f", x)


def whole_division(x: Column, by: int) -> Column:
    """Largest whole number not above x / by, exact for all 64-bit integers."""
    return F.floor(x.cast("decimal(20,0)") / by).cast("bigint")


def to_millis(x: Column) -> Column:
    """Milliseconds of a time in nanoseconds (above 1e15) or milliseconds."""
    return F.when(x > 10**15, whole_division(x, 1_000_000)).otherwise(x)


def pct_change(old: Column, new: Column) -> Column:
    """Change in per cent, two decimals; 0 when the old value is 0."""
    return F.when(old == 0, F.lit(0.0)).otherwise(F.round((new - old) / F.when(old != 0, old) * 100, 2))


def spread_pct(bid: Column, ask: Column) -> Column:
    """Spread in per cent of the bid, four decimals; 0 when either is 0."""
    return F.when((bid == 0) | (ask == 0), F.lit(0.0)).otherwise(F.round((ask - bid) / F.when(bid != 0, bid) * 100, 4))


def floor_window(ts_ms: Column, width_ms: int) -> Column:
    """Start of the epoch-aligned window that holds a time."""
    return ts_ms - F.pmod(ts_ms, F.lit(width_ms))


def relative_seconds(ts_ms: Column, trigger_ms: Column) -> Column:
    """Whole seconds between trigger and time, cut towards zero."""
    diff = ts_ms - trigger_ms
    return (F.signum(diff) * F.floor(F.abs(diff) / 1000)).cast("bigint")


def time_window_label(relative_s: Column) -> Column:
    return F.when(relative_s <= -15, "early").when(relative_s <= -10, "mid").when(relative_s <= -5, "late").when(relative_s <= 0, "final").otherwise("post")


def intensity(change_pct: Column, volume_ratio: Column) -> Column:
    return 0.7 * change_pct + 0.3 * volume_ratio


def is_significant(change_pct: Column, duration_ms: Column, *, least_change: float = 3.0, longest_ms: int = 1000) -> Column:
    return (change_pct >= least_change) & (duration_ms <= longest_ms)


def event_key(symbol: Column, ts_ms: Column) -> Column:
    """SYMBOL_yyyyMMdd_HHmmss in the session's time zone."""
    return F.concat(symbol, F.lit("_"), F.date_format(F.timestamp_millis(ts_ms), "yyyyMMdd_HHmmss"))


def event_key_symbol(key: Column) -> Column:
    return F.regexp_extract(key, r"^(.+)_\d{8}_\d{6}$", 1)


def event_key_ms(key: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.regexp_extract(key, r"(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss")))


def format_ts(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd HH:mm:ss.SSS")


def parse_ts(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def parse_notice_time(text: Column) -> Column:
    """Time of a notice: RFC 3339, or one of four plain forms."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
