"""Numeric and date expressions. The present is always an explicit ``as_of`` timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _now(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def age_days(when, as_of) -> Column:
    """Fractional days since ``when`` (a date, timestamp or ISO text); null when it is no date."""
    at = F.try_to_timestamp(_c(when).cast("string"))
    return (F.unix_micros(_now(as_of)) - F.unix_micros(at)) / F.lit(86400.0 * 1e6)


def freshness(when, as_of, half_life: float = fixed.SEARCH_HALF_LIFE) -> Column:
    """1.0 now or in the future, halving every ``half_life`` days; 0 for no date."""
    age = age_days(when, as_of)  # `greatest` skips nulls, so an unknown age must be kept out of it
    return F.when(age.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life))


def trend_score(claps, published, as_of) -> Column:
    """Claps weighted down by whole days of age; an unknown date counts as thirty days."""
    age = age_days(published, as_of)
    days = F.when(age.isNull(), F.lit(fixed.TREND_DEFAULT_AGE)).otherwise(F.greatest(F.lit(0), F.floor(age)))
    return F.coalesce(_c(claps), F.lit(0)) / F.pow(days + fixed.TREND_OFFSET, F.lit(fixed.TREND_POWER))


def clamp(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(c)))


def priority_share(prio) -> Column:
    return clamp((F.coalesce(F.nullif(_c(prio), F.lit(0.0)), F.lit(fixed.DEFAULT_PRIO)) - 0.1) / 0.9)


def relative_day(text, as_of) -> Column:
    """"30d", "6w", "6m", "1y", a full or partial ISO date -> date; anything else is null."""
    t = F.lower(F.trim(_c(text), F.lit('" ')))
    n = F.regexp_extract(t, r"^(\d{1,6})\s*[dwmy]$", 1).try_cast("int")
    unit = F.regexp_extract(t, r"^\d{1,6}\s*([dwmy])$", 1)
    days = F.when(unit == "d", 1).when(unit == "w", 7).when(unit == "m", 30).when(unit == "y", 365)
    moved = F.date_sub(F.to_date(_now(as_of)), (n * days).cast("int"))
    iso = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01")))
        .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    )
    relative = F.when((unit != "") & (F.year(moved) >= 1), moved)
    return F.coalesce(relative, iso.try_cast("date"))


def map_cosine(a, b) -> Column:
    """Cosine of two map<string,double> columns, 0 when either is empty."""
    x, y = _c(a), _c(b)

    def norm(m):
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))

    dot = F.aggregate(
        F.map_keys(x), F.lit(0.0), lambda s, k: s + F.coalesce(x[k] * y[k], F.lit(0.0))
    )
    scale = norm(x) * norm(y)
    return F.when(scale > 0, dot / scale).otherwise(F.lit(0.0))


def engagement_weight(has_notes, read_at, fetched, source) -> Column:
    w = fixed.ENGAGEMENT
    return (
        F.when(F.coalesce(_c(has_notes), F.lit(False)), w["notes"])
        .when(_c(read_at).isNotNull(), w["read"])
        .when(F.coalesce(_c(fetched), F.lit(False)), w["fetched"])
        .when(F.coalesce(_c(source), F.lit("")) != "auto", w["saved"])
        .otherwise(w["auto"])
    )


def decayed(weight, when, as_of) -> Column:
    floor = fixed.PROFILE_FLOOR
    return _c(weight) * (floor + (1 - floor) * freshness(when, as_of, fixed.PROFILE_HALF_LIFE))


def whole(value, limit: int = 10**12) -> Column:
    """A bounded whole number out of untrusted text or number; 0 when it is not one.

    Fractions round half to even; infinities, NaN, words and absurd sizes are all 0.
    """
    d = _c(value).try_cast("double")
    n = F.bround(d).try_cast("bigint")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) <= float(limit))
    return F.when(ok, F.coalesce(n, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def moment(ms) -> Column:
    """Timestamp from epoch milliseconds, null when it is no real date."""
    n = whole(ms, 10**15)
    last = 253402300799999  # 9999-12-31
    return F.when((n > 0) & (n <= last), F.date_trunc("second", F.timestamp_millis(n)))
