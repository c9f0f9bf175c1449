"""Dates and times, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(text: Column) -> Column:
    """An ISO date or time, or yyyymmdd; null for anything else."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(text))
    return F.coalesce(iso, F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def claim_time(claim: Column, as_of: Column) -> Column:
    """1 January of the first year 20xx that the claim names, else ``as_of``."""
    year = F.nullif(F.regexp_extract(claim, r"(20\d{2})", 1), F.lit(""))
    return F.coalesce(F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd")), as_of)


_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def date_in(text: Column) -> Column:
    """The first date of the forms Mon d, yyyy; then yyyy-mm-dd; then d Mon yyyy.  A form that does not parse gives way."""
    body = F.coalesce(text, F.lit(""))
    short = lambda d, m, y: F.try_to_timestamp(F.concat_ws(" ", d, F.initcap(m), y), F.lit("d MMM yyyy"))
    get = lambda p, i: F.regexp_extract(body, f"(?i){p}", i)
    us = rf"\b({_MONTH})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"
    eu = rf"\b(\d{{1,2}})\s+({_MONTH})[a-z]*\.?\s+(\d{{4}})"
    iso = F.try_to_timestamp(F.nullif(get(r"\b(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd"))
    return F.coalesce(short(get(us, 2), get(us, 1), get(us, 3)), iso, short(get(eu, 1), get(eu, 2), get(eu, 3)))


def weeks(first_month: Column, last_month: Column) -> Column:
    """Blocks of seven days from the start of the first month; the last ends with the last month, one second short."""
    end = F.add_months(F.trunc(last_month, "month"), 1).cast("timestamp") - F.expr("interval 1 second")
    starts = F.sequence(F.trunc(first_month, "month").cast("timestamp"), end, F.expr("interval 7 days"))
    stop = lambda s: F.least(s + F.expr("interval 7 days") - F.expr("interval 1 second"), end)
    form = lambda t, p: F.date_format(t, p)
    return F.transform(starts, lambda s: F.struct(form(s, "yyyy-MM-dd").alias("week"), form(s, "yyyyMMddHHmmss").alias("start"), form(stop(s), "yyyyMMddHHmmss").alias("stop")))


def decay(claim_at: Column, evidence_at: Column, half_life_days: float = 90.0) -> Column:
    """Halves each ``half_life_days`` that evidence is older than the claim; 1 for later evidence, null without a time."""
    age = F.unix_micros(claim_at) - F.unix_micros(evidence_at)
    rate = 0.6931471805599453 / (half_life_days * 86400.0)
    return F.when(age.isNotNull(), F.exp(-F.greatest(F.lit(0), age) / 1e6 * rate))
