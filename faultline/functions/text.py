"""Tokens, set similarity, labels, times and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Methods that only log, names that aren't real ones, and short names of known services.
LOG_METHODS = ["info", "warn", "warning", "debug", "error", "trace", "fatal", "log"]
PLAIN_LOG_CALLS = ["info", "warn", "error", "debug", "log", "print"]
ANONYMOUS = ["<lambda>", "<anonymous>", "<arrow>", "<init>", ""]
SERVICE_LABELS = {
    "frontend": "fe",
    "adservice": "ad",
    "cartservice": "cart",
    "checkoutservice": "chk",
    "currencyservice": "cur",
    "emailservice": "email",
    "paymentservice": "pay",
    "recommendationservice": "rec",
    "shippingservice": "ship",
    "redis": "rds",
}


def cpg_tokens(text: Column) -> Column:
    """Lower-cased words of three ASCII letters or more, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z ]+", " "), " +"), lambda x: F.length(x) >= 3)))


def word_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))))


def string_literals(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit("(?s)[\"`'](.*?)[\"`']"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; 0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def qualified(service: Column, method: Column) -> Column:
    return F.concat_ws("::", service, method)


def service_of(name: Column) -> Column:
    return F.split_part(name, F.lit("::"), F.lit(1))


def method_of(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def is_real_method(label: Column, name: Column) -> Column:
    return (F.upper(label) == "METHOD") & ~name.isin(ANONYMOUS) & ~name.startswith("<")


def is_log_method(name: Column) -> Column:
    return F.lower(name).isin(LOG_METHODS)


def call_name(label: Column) -> Column:
    """The callee that a node's label names, in the dialect that keeps it there."""
    return F.nullif(F.regexp_extract(label, r'name:\s*"([^"]+)"', 1), F.lit(""))


def micros(ts: Column) -> Column:
    """Epoch seconds as whole microseconds, the fraction rounded to the nearest (of two, the even one)."""
    whole = F.floor(ts)
    return whole * 1_000_000 + F.rint((ts - whole) * 1_000_000).cast("long")


def moment(ts: Column) -> Column:
    return F.timestamp_micros(micros(ts))


def duckdb_micros(column: str) -> str:
    """micros() as SQL for DuckDB."""
    return f"(floor({column})::bigint * 1000000 + round_even(({column} - floor({column})) * 1000000, 0)::bigint)"


def timestamp_text(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(moment(ts), pattern)


def clock_text(ts: Column) -> Column:
    return timestamp_text(ts, "HH:mm:ss.SSS")


def iso_text(ts: Column) -> Column:
    whole = F.pmod(micros(ts), F.lit(1_000_000)) == 0
    return F.when(whole, timestamp_text(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(timestamp_text(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def service_label(service: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in SERVICE_LABELS.items() for v in kv))
    return F.coalesce(F.try_element_at(table, service), F.substring(service, 1, 4))


def method_label(method: Column) -> Column:
    """Initials of the first two parts of a long name, or its first letters."""
    parts = F.filter(F.split(method, "_"), lambda x: x != "")
    initials = F.array_join(F.transform(F.slice(parts, 1, 2), lambda x: F.substring(x, 1, 1)), "")
    return F.upper(F.when(
        (F.length(method) > 8) & (F.size(parts) > 1),
        initials,
    ).when(F.length(method) > 8, F.substring(method, 1, 3)).otherwise(F.substring(method, 1, 4)))


def shortened(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def relative(ts: Column, start: Column, places: int = 3) -> Column:
    """Seconds since a start, rounded (of two, to the even last digit)."""
    return F.bround(ts - start, places)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
