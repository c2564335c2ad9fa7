"""Cookies and their lifetimes."""

from __future__ import annotations

from datetime import timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import vocab

DAY = 86400.0


def header_cookies(headers: Column) -> Column:
    """The cookie strings in an array of (name, value) headers: folded lines apart, blank ones dropped."""
    lines = F.flatten(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == "set-cookie"), lambda h: F.split(h["value"], "\n")))
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def parse_set_cookie(line: Column) -> Column:
    """struct(name, value, attributes). Attribute names are in lower case, flags have null, and the last of a name counts.

    The last one is picked by position, so no session setting matters.
    """
    parts = F.transform(F.split(line, ";"), lambda x: F.trim(x))
    first = F.get(parts, 0)
    pairs = F.transform(F.filter(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: x != ""), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.when(F.contains(x, F.lit("=")), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    value = F.when(F.contains(first, F.lit("=")), F.trim(F.substring(first, F.instr(first, "=") + 1, F.length(first)))).otherwise(F.lit(""))
    return F.struct(F.trim(F.substring_index(first, "=", 1)).alias("name"), value.alias("value"), F.map_from_entries(last).alias("attributes"))


def cookie_date(text: Column) -> Column:
    """An HTTP date in either form; the day of the week is not looked at."""
    rest = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]+,?\s+", ""))
    return F.coalesce(F.try_to_timestamp(rest, F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(rest, F.lit("dd-MMM-yyyy HH:mm:ss z")), F.try_to_timestamp(rest, F.lit("d MMM yyyy HH:mm:ss z")))


@F.pandas_udf(T.TimestampType())
def odd_date(text: pd.Series) -> pd.Series:
    """Dates as mail headers write them, in UTC where no zone is given; null is passed over."""

    def of(x):
        try:
            at = parsedate_to_datetime(x)
            return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
        except (TypeError, ValueError, OverflowError):
            return None

    return pd.Series(pd.to_datetime([None if x is None else of(x) for x in text], utc=True, errors="coerce"), index=text.index)


def cookie_expires(text: Column) -> Column:
    """cookie_date, and what only the mail parser reads; it is handed no date that is read already."""
    known = cookie_date(text)
    return F.coalesce(known, odd_date(F.when(known.isNull(), text)))


def header_lifetime_days(attributes: Column, started: Column, as_of: Column | None = None, odd_dates: bool = False) -> Column:
    """Days that a header's cookie lives: Max-Age if it is there, readable or not, else Expires, with odd dates if asked for."""
    begin = started if as_of is None else F.coalesce(started, as_of)
    age = F.try_element_at(attributes, F.lit("max-age"))
    until = F.unix_micros((cookie_expires if odd_dates else cookie_date)(F.try_element_at(attributes, F.lit("expires"))))
    return F.when(F.map_contains_key(attributes, "max-age"), age.try_cast("bigint") / DAY).otherwise((until - F.unix_micros(begin)) / 1e6 / DAY)


def epoch_lifetime_days(expires: Column, captured: Column) -> Column:
    """Days that a browser's cookie lives; session cookies, with 0 or less, have null."""
    at = expires.try_cast("double")
    return F.when(at > 0, (at - F.unix_micros(captured) / 1e6) / DAY)


def long_lived_header(days: Column, least: int = vocab.PROFILING_DAYS) -> Column:
    """Whether days, rounded half-even to one place as doubles are, reach the least: the same as over least - 0.05."""
    return F.coalesce(days, F.lit(0.0)) > F.lit(least - 0.05)


def long_lived_browser(days: Column, least: int = vocab.PROFILING_DAYS) -> Column:
    return F.coalesce(days, F.lit(0.0)) >= F.lit(float(least))


def is_profiling(third_party: Column, tracker: Column, long_lived: Column) -> Column:
    return F.coalesce(third_party & tracker & long_lived, F.lit(False))
