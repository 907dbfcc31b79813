"""Normal forms of instants, digests and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def instant_us(text: Column) -> Column:
    """Microseconds since the epoch of an ISO 8601 text with any offset; no offset means UTC; null if it can't be read."""
    zoned = F.trim(text).rlike(r"(?i)(z|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & F.contains(F.trim(text), F.lit(":"))
    return F.unix_micros(F.try_to_timestamp(F.when(zoned, F.trim(text)).otherwise(F.concat(F.trim(text), F.lit("Z")))))


def ntz_us(at: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone that means UTC, whatever the session's zone is."""
    day = F.unix_date(at.cast("date")).cast("bigint") * DAY_US
    seconds = F.hour(at).cast("bigint") * 3600 + F.minute(at) * 60
    micros = (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
    return day + seconds * 1_000_000 + micros


def month_of_us(us: Column) -> Column:
    """YYYY-MM in UTC; works on dates only, so the session's zone plays no part."""
    return F.date_format(F.date_from_unix_date(F.floor(us / F.lit(DAY_US)).cast("int")), "yyyy-MM")


def digest_norm(digest: Column) -> Column:
    """The spelling in which two names of the same SHA-256 are equal."""
    return F.regexp_replace(F.lower(F.trim(digest)), "^sha256:", "")


def posix_path(path: Column) -> Column:
    """Relative posix form: `/` as separator, no `.` segments, no doubled or leading separators."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    tidy = F.array_join(F.filter(F.split(slashed, "/"), lambda x: (x != ".") & (x != "")), "/")
    plain = ~slashed.rlike(r"(^|/)\.?(/|$)")
    return F.when(plain, slashed).otherwise(tidy)
