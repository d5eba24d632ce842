"""Error mining: detection, summaries, patterns by signature, by service and type, and by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import normalize as N
from ..functions import text as X
from .graph import cut
from .ordering import numbered


def select_logs(logs: DataFrame, service: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Logs of a service and an inclusive time range; a bound of 0 or None is no bound."""
    if start:
        logs = logs.where(F.col("timestamp") >= start)
    if end:
        logs = logs.where(F.col("timestamp") <= end)
    return logs.where(F.col("service") == service) if service else logs


def detect(logs: DataFrame, error_type: str | None = None, min_severity: int = 1) -> DataFrame:
    """The error rows of logs with category, severity, stack trace, exception and place."""
    m = F.col("message")
    # an exploded array of one: a plain column would be worked out again wherever it is used or filtered by
    found = logs.withColumn("error_type", F.explode(F.array(E.category(m)))).where("error_type is not null").withColumn("severity", E.severity(F.col("error_type")))
    found = found.where(F.col("severity") >= min_severity)
    if error_type:
        found = found.where(F.col("error_type") == error_type.upper())
    return found.withColumns({
        "timestamp_str": X.timestamp_text(F.col("timestamp")),
        "has_traceback": E.has_traceback(m),
        "traceback_lines": E.traceback_lines(m),
        "exception_type": E.exception_type(m),
        "error_location": E.error_location(m),
    })


def with_traceback(errors: DataFrame) -> DataFrame:
    """Applied after the summary, which counts all errors."""
    return errors.where("has_traceback")


def summary(errors: DataFrame) -> DataFrame:
    """One row: totals, distinct exceptions and the time range (0, 0 without errors)."""
    start, end = F.coalesce(F.min("timestamp"), F.lit(0.0)), F.coalesce(F.max("timestamp"), F.lit(0.0))
    return errors.agg(
        F.count("*").alias("total_errors"),
        F.count_if("has_traceback").alias("errors_with_traceback"),
        F.array_sort(F.collect_set("exception_type")).alias("unique_exceptions"),
        start.alias("start"),
        end.alias("end"),
        (end - start).alias("duration_seconds"),
    )


def counts(rows: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows by key with their share of all, most frequent first, ties by first appearance."""
    total = rows.agg(F.count("*").alias("__all"))
    out = rows.groupBy(key).agg(F.count("*").alias(name), F.min("row_id").alias("first_row")).crossJoin(F.broadcast(total))
    return out.select(key, name, (X.share(F.col(name), F.col("__all")) * 100).alias("percent"), "first_row").orderBy(F.desc(name), "first_row")


def top(frame: DataFrame, n: int, by: str = "count", ties: str = "first_row") -> DataFrame:
    return frame.orderBy(F.desc(by), ties).limit(n)


def first_rows(frame: DataFrame, keys: list[str], k: int, order: str = "row_id") -> DataFrame:
    """The first k rows of each key. A running rank filter that Spark applies before the shuffle keeps groups bounded."""
    return frame.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("__nth") <= k).drop("__nth")


def signed(rows: DataFrame, profile: str) -> DataFrame:
    """rows with `normalized`, `signature` and, but for mine, the profile's error_type."""
    m = F.col("message")
    if profile == "steps":
        rows = rows.where(E.is_step_error(m)).withColumn("error_type", E.step_class(m)).withColumn("trace_id", E.trace_id(m))
    elif profile == "trace":
        rows = rows.where(E.is_error(m)).withColumn("error_type", E.trace_class(m))
    rows = rows.withColumn("normalized", N.normalized(m, profile))
    return rows.withColumn(
        "signature",
        N.signature(F.col("normalized"), F.col("error_type"), F.col("service"), profile, F.col("exception_type") if profile == "mine" else None),
    )


def _samples(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, and the messages of the first k rows in order."""
    return first_rows(rows, keys, k).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_id", "message"))), lambda x: x["message"]).alias("sample_messages"),
        F.transform(F.array_sort(F.collect_list(F.struct("row_id", "normalized"))), lambda x: x["normalized"]).alias("__norms"),
    )


def most_common(values: Column) -> Column:
    """The most frequent member of an array; of ties, the first."""
    ranked = F.transform(
        F.array_distinct(values),
        lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("p"), v.alias("v")),
    )
    return F.array_max(ranked)["v"]


def patterns(errors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One row for each key: counts, services, time range, first message, samples and template.

    errors: detect() through signed(), stored once as sums and samples both read it. Partial sums are taken before the
    shuffle; only k rows a key are kept for samples. Lines of stack traces, of which a key may have very many, are rows
    of their own: trace_lines().
    """
    needed = {"row_id", "timestamp", "service", "message", "error_type", "normalized", "has_traceback", "exception_type", *keys}
    errors = cut(errors.select(*sorted(needed)))
    out = errors.groupBy(*keys).agg(
        F.min_by("error_type", "row_id").alias("__type") if "error_type" not in keys else F.count("*").alias("__n"),
        F.count("*").alias("count"),
        F.array_sort(F.collect_set("service")).alias("services_affected"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min_by("message", "row_id").alias("representative_message"),
        F.bool_or("has_traceback").alias("has_traceback"),
        F.array_sort(F.collect_set("exception_type")).alias("exception_types"),
    )
    out = out.withColumnRenamed("__type", "error_type") if "error_type" not in keys else out.drop("__n")
    out = out.join(_samples(errors, keys, k), keys)
    return out.withColumn("message_template", most_common(F.col("__norms"))).drop("__norms")


def trace_lines(errors: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys, row_id, nth, line: the first k stack trace lines of each error, the list of a key in the order of row_id, nth."""
    return errors.select(*keys, "row_id", F.posexplode(F.slice("traceback_lines", 1, k)).alias("nth", "line"))


def step_patterns(logs: DataFrame, k: int = 3) -> DataFrame:
    rows = signed(logs, "steps")
    base = rows.groupBy("signature").agg(
        F.count("*").alias("count"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.array_sort(F.collect_set("trace_id")).alias("trace_ids"),
        F.min_by("error_type", "row_id").alias("error_type"),
        F.min_by("normalized", "row_id").alias("normalized_message"),
        F.min("row_id").alias("first_row"),
    )
    return base.join(_samples(rows, ["signature"], k).select("signature", F.col("sample_messages").alias("samples")), "signature")


def trace_patterns(logs: DataFrame, k: int = 3) -> DataFrame:
    rows = signed(logs, "trace")
    base = rows.groupBy("signature").agg(
        F.count("*").alias("count"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min_by("error_type", "row_id").alias("error_type"),
        F.min_by("normalized", "row_id").alias("normalized_message"),
    )
    return base.join(_samples(rows, ["signature"], k).select("signature", F.col("sample_messages").alias("samples")), "signature")


def aggregation_stats(found: DataFrame) -> DataFrame:
    """One row over patterns: errors, patterns, services, and 1 - patterns / errors."""
    sums = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_errors"), F.count("*").alias("unique_patterns"))
    services = found.select(F.explode("services_affected").alias("s")).agg(F.count_distinct("s").alias("services_affected"))
    return sums.crossJoin(services).withColumn("deduplication_ratio", 1 - X.share(F.col("unique_patterns"), F.col("total_errors")))


def _leaders(first: float):
    """Leader clustering of the distinct token sets of one service and type, in the order of their first rows.

    A set can only reach the threshold with a leader that has one of its rarest tokens too (as many as it may lack, and
    one): leaders are listed by those, so a set meets few of them.
    """

    def lead(frame):
        import math

        import pandas as pd

        sets = [(row.first_row, sorted(row.tokens)) for row in frame.sort_values("first_row").itertuples()]
        often: dict[str, int] = {}
        for _, own in sets:
            for token in own:
                often[token] = often.get(token, 0) + 1
        leaders: list[frozenset[str]] = []
        listed: dict[str, list[int]] = {}
        out = []
        for _, own in sets:
            mine = frozenset(own)
            rare = sorted(own, key=lambda x: (often[x], x))[: len(own) - math.ceil(first * len(own) - 1e-9) + 1]
            best, at = 0.0, None
            for i in sorted({i for token in rare for i in listed.get(token, ())}):
                both = len(mine & leaders[i])
                s = both / (len(mine) + len(leaders[i]) - both)
                if s >= first and s > best:
                    best, at = s, i
            if at is None:
                at = len(leaders)
                leaders.append(mine)
                for token in rare:
                    listed.setdefault(token, []).append(at)
            out.append((own, at))
        return pd.DataFrame({
            "service": frame["service"].iloc[0],
            "error_type": frame["error_type"].iloc[0],
            "tokens": [t for t, _ in out],
            "leader": [i for _, i in out],
        })

    return lead


def similar_patterns(errors: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """Leader clustering within each service and type, in row order: a message joins the most similar leader (the first of
    ties) at or above the threshold, or becomes one. The k first messages of a pattern are samples and give its template.

    Equal token sets join one leader, so each distinct set is one step. The order is part of the definition: one task holds
    the distinct token sets of a service and type, never its rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0, and 1 at most")
    rows = signed(errors, "mine").withColumn("tokens", X.word_tokens(F.col("normalized")))
    rows = cut(rows.select("row_id", "timestamp", "service", "error_type", "message", "normalized", "has_traceback", "exception_type", "tokens"))
    sets = rows.groupBy("service", "error_type", "tokens").agg(F.min("row_id").alias("first_row"))
    led = sets.groupBy("service", "error_type").applyInPandas(
        _leaders(threshold),
        "service string, error_type string, tokens array<string>, leader long",
    )
    # a message without tokens is like none: each is a pattern of its own
    member = cut(rows.join(led, ["service", "error_type", "tokens"]).withColumn(
        "own",
        F.when(F.size("tokens") == 0, F.col("row_id")).otherwise(-1),
    ).drop("tokens"))
    keys = ["service", "error_type", "leader", "own"]
    found = member.groupBy(*keys).agg(
        F.min("row_id").alias("first_row"),
        F.count("*").alias("count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min_by("message", "row_id").alias("representative_message"),
        F.bool_or("has_traceback").alias("has_traceback"),
        F.array_sort(F.collect_set("exception_type")).alias("exception_types"),
    )
    found = numbered(found.join(_samples(member, keys, k), keys), "number", "first_row")
    name = F.concat_ws(":", "service", "error_type", F.col("number").cast("string"))
    found = found.withColumns({
        "pattern_id": name,
        "signature": name,
        "services_affected": F.array("service"),
        "message_template": most_common(F.col("__norms")),
    })
    return found.drop("leader", "own", "number", "__norms")
