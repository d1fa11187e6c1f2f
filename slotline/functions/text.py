"""Column functions for blanks, search, percent-encoding and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PENDING, CONFIRMED = "pending", "confirmed"


def filled(x: Column | str) -> Column:
    """Neither null nor empty."""
    x = F.col(x) if isinstance(x, str) else x
    return x.isNotNull() & (x != "")


def blank(x: Column | str) -> Column:
    """Null or empty."""
    x = F.col(x) if isinstance(x, str) else x
    return x.isNull() | (x == "")


def or_default(x: Column | str, default: Column | str) -> Column:
    """The value, or the default where it is null or empty."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def status_of(x: Column | str = "status") -> Column:
    """The one rule for a booking's status: null, empty and blank all read as pending."""
    x = F.col(x) if isinstance(x, str) else x
    return or_default(F.trim(x), PENDING)


def matches(query: str, *fields: str) -> Column:
    """Case-blind literal search in the fields run together without a separator; an empty query matches all."""
    text = F.concat(*[F.coalesce(F.col(f), F.lit("")) for f in fields])
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def url_quote(x: Column | str) -> Column:
    """Percent-encoding that keeps `/` and `~`, writes a space as %20 and `*` as %2A."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def request_id(*fields: str) -> Column:
    """A repeatable identifier of a booking: each field goes in with its length, and a null one as `-`, so that no two lists of fields run together."""
    text = [F.col(f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)
