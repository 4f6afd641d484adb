"""Date column expressions. No operator reads the clock: ``as_of`` is passed."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, let

# Feed date layouts tried in order. RFC 822 day names are removed first
# ("Mon, 02 Jun 2025 ..."), as Spark's parser does not take day-of-week text.
FEED_DATE_FORMATS = (
    "dd MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss Z",
    "dd MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss z",
    "dd MMM yyyy HH:mm Z",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)


def as_date_col(as_of) -> Column:
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        return F.lit(as_of.isoformat()[:10]).cast("date")
    if isinstance(as_of, str):
        return F.lit(as_of).cast("date")
    return col_of(as_of).cast("date")


def parse_feed_ts(c) -> Column:
    """Timestamp (UTC instant) of a feed date string, NULL when unparsable."""
    s = F.regexp_replace(F.trim(F.coalesce(col_of(c), F.lit(""))), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in FEED_DATE_FORMATS])


def item_date(published, updated, as_of=None) -> Column:
    """UTC calendar date of ``published``, else ``updated``, else ``as_of``."""
    parts = [parse_feed_ts(published).cast("date"), parse_feed_ts(updated).cast("date")]
    if as_of is not None:
        parts.append(as_date_col(as_of))
    return F.coalesce(*parts)


def epoch_date(seconds, as_of) -> Column:
    """P4, listing variant: UTC date of epoch seconds, else ``as_of``."""
    secs = col_of(seconds).cast("double")
    return F.coalesce(F.timestamp_seconds(secs).cast("date"), as_date_col(as_of))


def iso_prefix_date(c) -> Column:
    """``date.fromisoformat(str(x)[:10])`` for the plain ``YYYY-MM-DD`` layout."""
    s = F.substring(F.coalesce(col_of(c).cast("string"), F.lit("")), 1, 10)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def time_sensitivity(published, as_of) -> Column:
    """P20: age <= 30 days (future too) high, <= 365 medium, else low;
    unparsable unknown. ``as_of`` is explicit (the reference uses today)."""
    def bucket(age):
        return (F.when(age.isNull(), F.lit("unknown"))
                .when(age <= 30, F.lit("high"))
                .when(age <= 365, F.lit("medium"))
                .otherwise(F.lit("low")))

    return let(F.datediff(as_date_col(as_of), iso_prefix_date(published)), bucket)
