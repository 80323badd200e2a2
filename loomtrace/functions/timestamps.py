"""Timestamps in the forms that event logs use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms in order of precedence; those without an offset are in UTC.
FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]xx",
    "EEE, dd MMM yyyy HH:mm:ss xx",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss 'UTC'",
)
_RFC2822 = r"^[A-Z][a-z]{2}, (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4})$"
_SCRIPT = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d{1,2}) (\d{4}) (\d{2}:\d{2}:\d{2}) GMT([+-]\d{4}).*$"


def parse_timestamp(text: Column, form: str | None = None) -> Column:
    """The time of a text, null if no form fits; form is tried first."""
    t = F.trim(text.cast("string"))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in ([form] if form else [])]
    for pattern, order in ((_RFC2822, "$1 $2 $3 $4 $5"), (_SCRIPT, "$2 $1 $3 $4 $5")):
        tries.append(F.when(t.rlike(pattern), F.try_to_timestamp(F.regexp_replace(t, pattern, order), F.lit("d MMM yyyy HH:mm:ss xx"))))
    plain = F.regexp_replace(F.regexp_replace(t, r" UTC$", "Z"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(*tries, F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(plain)))


def rfc3339(ts: Column) -> Column:
    """A UTC time as text with microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", F.lit("")).otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


# -- values


def typed(value: Column, kind: str) -> Column:
    """A text as integer, float, boolean, time or string; what does not fit is null. Floats become
    integers only if exact, and null as a float is not a number."""
    if kind == "integer":
        d = value.try_cast("double")
        return F.when(d == F.floor(d), F.coalesce(value.try_cast("bigint"), d.cast("bigint")))
    if kind == "float":
        return F.when(value == "null", F.lit(float("nan"))).otherwise(value.try_cast("double"))
    if kind == "boolean":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    if kind == "time":
        return parse_timestamp(value)
    return value


#: Names of value types in SQL stores.
SQL_TYPES = {"string": "TEXT", "float": "REAL", "boolean": "BOOLEAN", "integer": "INTEGER", "time": "TIMESTAMP"}


def type_of_sql(name: str) -> str:
    return {v: k for k, v in SQL_TYPES.items()}.get(name.upper(), {"DOUBLE": "float", "BIGINT": "integer", "VARCHAR": "string"}.get(name.upper(), "string"))


def type_of_value(value: object) -> str:
    """Declared type of a decoded value, in the order integer, float, boolean, time, string."""
    import datetime

    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "float"
    return "time" if isinstance(value, datetime.datetime) else "string"
