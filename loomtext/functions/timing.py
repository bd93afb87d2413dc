"""Delays, statuses and timestamps (DAT1-DAT3) and speech timing (AGG17, AGG18)."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

RETRYABLE = (429, 500, 502, 503, 504)
MOST_RETRIES = 2


def retry_delay(retry_after: Column, attempt: Column, now: Column) -> Column:
    """DAT1: seconds to wait: the header's seconds or date, else a doubling quarter second; 0 to 5."""
    value = F.trim(retry_after)
    seconds = F.try_to_number(F.when(value.rlike(r"^[0-9]{1,9}$"), value), F.lit("999999999")).cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(date) - F.unix_micros(now)) / 1e6
    return F.least(F.greatest(F.coalesce(seconds, until, 0.25 * F.pow(F.lit(2.0), attempt)), F.lit(0.0)), F.lit(5.0))


def should_retry(status: Column, retries: Column) -> Column:
    """DAT2."""
    return status.isin(*RETRYABLE) & (retries < MOST_RETRIES)


def iso8601(ts: Column) -> Column:
    """DAT3: UTC with milliseconds (the session runs in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_CJK = r"[\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
_SPACE = r"[\s\x{85}\p{Z}]"
_PUNCTUATION = r"(?!" + _CJK + r")\p{P}"


def speech_weight(c: Column) -> Column:
    """AGG17: 1 for a character, 0.35 for punctuation, 0 for white space."""
    spaces, marks = F.regexp_count(c, F.lit(_SPACE)), F.regexp_count(c, F.lit(_PUNCTUATION))
    return F.length(c) - spaces - marks + 0.35 * marks


def cjk_ratio(c: Column) -> Column:
    visible = F.length(c) - F.regexp_count(c, F.lit(_SPACE))
    return F.when(visible > 0, F.regexp_count(c, F.lit(_CJK)) / visible).otherwise(F.lit(0.0))


def speech_seconds(c: Column) -> Column:
    """Estimated duration, 0.35 s at least."""
    r = cjk_ratio(c)
    return F.greatest(F.lit(0.35), speech_weight(c) / (9.5 * r + 18.5 * (1 - r)))


def allocated_seconds(remaining: Column, rest_text: Column, *group: str) -> Column:
    """AGG18: a group's remaining audio dealt out by the weight of what is not spoken yet."""
    weight = F.greatest(F.lit(1.0), speech_weight(rest_text))
    total = F.sum(weight).over(Window.partitionBy(*group))
    return F.when(remaining > 0.05, F.greatest(F.lit(0.08), remaining * weight / total))
