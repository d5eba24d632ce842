"""Normalised messages and signatures, one profile for each family of pipelines: mine, steps and trace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"

# What is replaced in the lower-cased message, in this order. $1 is the first group.
RULES: dict[str, list[tuple[str, str]]] = {
    "mine": [
        (_UUID, "<UUID>"),
        (_STAMP, "<TIMESTAMP>"),
        (r"\d{10,13}", "<TIMESTAMP>"),
        (_IP + r"\b", "<IP>"),
        (r"\b[\w.+-]+@[\w.-]+\.\w+\b", "<EMAIL>"),
        (r"https?://[^\s]+", "<URL>"),
        (r"0x[0-9a-f]+", "<HEX>"),
        (r"\b\d{6,}\b", "<NUMBER>"),
        (r"\bv?\d+\.\d+(\.\d+)?([.-]\w+)?\b", "<VERSION>"),
        (r"(?:/[\w.-]+)+/?", "<PATH>"),
        (r"(?:[A-Z]:)?(?:\\[\w.-]+)+\\?", "<PATH>"),
        (r"\b[0-9a-f]{8,16}\b", "<ADDR>"),
        (r"\b(user|session|request|trace)[-_]?id[=:]?\s*\w+", "$1_id=<ID>"),
        (r":\s*\d+", ":<NUM>"),
        (r"=\s*\d+", "=<NUM>"),
        (r'"[^"]{20,}"', '"<STRING>"'),
        (r"'[^']{20,}'", "'<STRING>'"),
    ],
    "steps": [
        (_UUID, "<UUID>"),
        (_STAMP + r"(\.\d+)?", "<TIMESTAMP>"),
        (_IP + r"(:\d+)?\b", "<IP>"),
        (r"\b\d{4,}\b", "<NUM>"),
        (r":\s*\d+", ":<NUM>"),
        (r"=\s*\d+", "=<NUM>"),
        (r'"[^"]{20,}"', '"<STRING>"'),
    ],
    "trace": [
        (_UUID, "<UUID>"),
        (_STAMP, "<TIMESTAMP>"),
        (_IP + r"\b", "<IP>"),
        (r"\b\d{6,}\b", "<NUMBER>"),
        (r":\s*\d+", ":<NUM>"),
        (r"=\s*\d+", "=<NUM>"),
        (r'"[^"]{20,}"', '"<STRING>"'),
    ],
}
#: Longer normalised messages are cut in the signatures of these profiles.
CUT, CUTS = 200, {"mine", "trace"}


def normalized(message: Column, profile: str) -> Column:
    out = F.lower(message)
    for pattern, to in RULES[profile]:
        out = F.regexp_replace(out, f"(?U){pattern}", to)
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", "")


def signature(message_normalized: Column, error_type: Column, service: Column, profile: str, exception: Column | None = None) -> Column:
    """The first 12 digits of the MD5 of service, type, (exception) and normalised message."""
    text = message_normalized
    if profile in CUTS:
        text = F.when(F.length(text) > CUT, F.concat(F.substring(text, 1, CUT), F.lit("..."))).otherwise(text)
    if profile == "mine":
        named = F.when(exception.isNotNull(), F.concat(F.lit("exception:"), exception)) if exception is not None else F.lit(None).cast("string")
        whole = F.concat_ws("|", F.concat(F.lit("service:"), service), F.concat(F.lit("type:"), error_type), named, F.concat(F.lit("msg:"), text))
    else:
        whole = F.concat_ws("|", service, error_type, text)
    return F.substring(F.md5(whole.cast("binary")), 1, 12)


def duckdb_normalized(column: str, profile: str) -> str:
    out = f"lower({column})"
    for pattern, to in RULES[profile]:
        p, t = pattern.replace("'", "''"), to.replace("$1", r"\1").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{t}', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def duckdb_signature(text: str, error_type: str, service: str, profile: str, exception: str | None = None) -> str:
    if profile in CUTS:
        text = f"case when length({text}) > {CUT} then substr({text}, 1, {CUT}) || '...' else {text} end"
    if profile == "mine":
        named = f"coalesce('|exception:' || {exception}, '')" if exception else "''"
        return f"substr(md5('service:' || {service} || '|type:' || {error_type} || {named} || '|msg:' || {text}), 1, 12)"
    return f"substr(md5({service} || '|' || {error_type} || '|' || {text}), 1, 12)"
