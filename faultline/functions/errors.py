"""Detection, classification and extraction from log messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order in which they are tried, with severity and patterns (case-insensitive).
CATEGORIES: dict[str, tuple[int, list[str]]] = {
    "EXCEPTION": (9, [r"exception", r"Exception:", r"Error:", r"Traceback \(most recent call last\)"]),
    "ERROR": (8, [r"\berror\b", r"ERROR:", r"\[error\]", r"\[ERROR\]"]),
    "FAILED": (7, [r"\bfailed\b", r"\bfailure\b", r"has failed", r"failed to"]),
    "FATAL": (10, [r"\bfatal\b", r"FATAL:", r"\[FATAL\]", r"critical error"]),
    "CRASH": (10, [r"\bcrash(ed)?\b", r"segmentation fault", r"core dumped"]),
    "TIMEOUT": (7, [r"\btimeout\b", r"timed out", r"time out", r"deadline exceeded"]),
    "CONNECTION_ERROR": (7, [r"connection (refused|reset|closed)", r"unable to connect", r"connection error", r"network unreachable"]),
    "DENIED": (6, [r"(access |permission )?denied", r"forbidden", r"unauthorized", r"authentication failed"]),
    "OUT_OF_MEMORY": (9, [r"out of memory", r"memory error", r"OOM", r"cannot allocate memory"]),
    "DISK_FULL": (8, [r"disk full", r"no space left", r"quota exceeded"]),
    "NULL_POINTER": (8, [r"null pointer", r"NullPointerException", r"nil pointer", r"null reference"]),
    "INVALID": (6, [r"\binvalid\b", r"validation failed", r"invalid input"]),
    "NOT_FOUND": (5, [r"not found", r"does not exist", r"no such file", r"(?<![\d:])\b404\b(?![\d\"])"]),
    "WARNING": (3, [r"\bwarning\b", r"WARN:", r"\[WARN\]", r"\[WARNING\]"]),
    "DEPRECATED": (2, [r"deprecated", r"deprecation warning"]),
}
# The five classes of the step profile, by substring of the lower-cased message, first match wins.
CLASSES: dict[str, list[str]] = {
    "error": ["error", "exception", "failed", "failure", "fatal"],
    "timeout": ["timeout", "timed out", "deadline exceeded"],
    "crash": ["crash", "panic", "segfault", "core dump", "killed"],
    "connection": ["connection refused", "connection reset", "connection closed"],
    "oom": ["out of memory", "oom", "memory exhausted"],
}
# Trace ids, exception names, places and stack traces.
TRACE_IDS = [
    r"trace[_-]?id[:\s=]+([a-zA-Z0-9-]+)",
    r"request[_-]?id[:\s=]+([a-zA-Z0-9-]+)",
    r"\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b",
]
EXCEPTIONS = [r"(\w+Exception):", r"(\w+Error):", r"raise (\w+Exception)", r"throw new (\w+Exception)"]
PLACES = [r"File\s+\"([^\"]+)\",\s+line\s+(\d+)", r"at\s+[\w.]+\((\w+\.java):(\d+)\)", r"in\s+(\w+)\s+at\s+line\s+(\d+)"]
TRACE_HEADER = r"Traceback \(most recent call last\):"
TRACE_LINES = [r"^\s+at\s+\w+", r"^\s+File\s+\"[^\"]+\",\s+line\s+\d+", r"^\s+\w+\.\w+\([^)]*\)"]
MOST_TRACE_LINES = 50


def _any(patterns: list[str], flags: str = "iU") -> str:
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns)


def category(message: Column) -> Column:
    """The first category with a match; null if none has."""
    out = None
    for name, (_, patterns) in CATEGORIES.items():
        hit = message.rlike(_any(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def severity(category_name: Column) -> Column:
    table = F.create_map(*(F.lit(v) for name, (s, _) in CATEGORIES.items() for v in (name, s)))
    return F.when(category_name.isNotNull(), F.coalesce(F.element_at(table, category_name), F.lit(5)))


def _has(message: Column, parts: list[str]) -> Column:
    """Whether the lower-cased message has one of some literal parts (plain words: no part has a special character)."""
    return F.lower(message).rlike("|".join(parts))


def is_step_error(message: Column) -> Column:
    return _has(message, [p for parts in CLASSES.values() for p in parts])


def step_class(message: Column) -> Column:
    """One of five classes; `error` if none fits."""
    out = None
    for name, parts in CLASSES.items():
        out = F.when(_has(message, parts), name) if out is None else out.when(_has(message, parts), name)
    return out.otherwise("error")


def is_error(message: Column) -> Column:
    """The three-word test of the window and trace profiles."""
    return _has(message, ["error", "fail", "exception"])


def trace_class(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("timeout"), "timeout").when(low.contains("connection"), "connection").when(low.contains("exception"), "exception").otherwise("error")


def _first_group(message: Column, patterns: list[str], flags: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(message, f"(?{flags}){p}", 1), F.lit("")) for p in patterns))


def exception_type(message: Column) -> Column:
    return _first_group(message, EXCEPTIONS, "U")


def error_location(message: Column) -> Column:
    """file:line or function:line of the first kind of place that the message names."""
    return F.coalesce(*(F.when(
        message.rlike(f"(?U){p}"),
        F.concat_ws(":", F.regexp_extract(message, f"(?U){p}", 1), F.regexp_extract(message, f"(?U){p}", 2)),
    ) for p in PLACES))


def trace_id(message: Column) -> Column:
    return _first_group(message, TRACE_IDS, "iU")


def has_traceback(message: Column) -> Column:
    return message.rlike(f"(?iU){TRACE_HEADER}") | message.rlike(_any(TRACE_LINES, "mU"))


def traceback_lines(message: Column) -> Column:
    """Trimmed lines of stack traces: a header opens one, `File` and `at` lines belong to it, an exception line ends it."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    nothing = F.struct(F.lit(False).alias("open"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        header = line.rlike(f"(?iU){TRACE_HEADER}")
        inner = acc["open"] & line.rlike(r"(?U)^(?:File\s+\"[^\"]+\",\s+line\s+\d+|at\s+\w+)")
        last = acc["open"] & ~inner & line.contains(":") & (line.contains("Exception") | line.contains("Error"))
        return F.struct(
            (header | (acc["open"] & ~last)).alias("open"),
            F.when(header | inner | last, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"),
        )

    found = F.aggregate(lines, nothing, step, lambda acc: F.slice(acc["kept"], 1, MOST_TRACE_LINES))
    return F.when(has_traceback(message), found).otherwise(F.expr("cast(array() as array<string>)"))


def duckdb_category(column: str) -> str:
    """The same test as SQL for DuckDB, whose expressions have no lookaround."""
    plain = lambda p: r"(^|[^\w:])404($|[^\w\"])" if "404" in p else p
    cases = [
        f"when regexp_matches({column}, '(?i)" + "|".join(f"(?:{plain(p)})" for p in ps).replace("'", "''") + f"') then '{name}'" for name,
        (_, ps) in CATEGORIES.items()
    ]
    return "case " + " ".join(cases) + " end"


def python_category(message: str) -> str | None:
    """The same test in Python, for tests."""
    return next((name for name, (_, ps) in CATEGORIES.items() if any(re.search(p, message, re.I) for p in ps)), None)
