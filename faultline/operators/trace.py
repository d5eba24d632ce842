"""Evidence: the latest log before a time, calls that logs support, and the backward trace over callers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small
from .graph import call_graph, cut
from .ordering import numbered


def _near(probes: DataFrame, logs: DataFrame, window: float, on: list[str]) -> DataFrame:
    """Probes (at) with logs of equal `on` and timestamp in [at - window, at). An as-of join by time buckets: a log can
    only be in the probe's bucket or the one before, so the join is on equal keys and a hot service is split by time."""
    dealt = probes.withColumn("__bucket", F.explode(F.array(F.floor(F.col("at") / window), F.floor(F.col("at") / window) - 1)))
    own = logs.withColumn("__bucket", F.floor(F.col("timestamp") / window))
    return dealt.join(own, [*on, "__bucket"]).where(
        (F.col("timestamp") < F.col("at")) & (F.col("timestamp") >= F.col("at") - window)
    ).drop("__bucket")


def evidence_before(probes: DataFrame, logs: DataFrame, window: float) -> DataFrame:
    """For each probe (probe_id, service, method, at): its service's latest log in [at - window, at) that names the method."""
    found = _near(
        probes,
        logs.select("service", "timestamp", "row_id", "message"),
        window,
        ["service"],
    ).where(F.col("message").contains(F.col("method")))
    best = found.groupBy("probe_id").agg(F.max(F.struct("timestamp", "row_id")).alias("x"))
    return best.select("probe_id", F.col("x.timestamp").alias("evidence_ts"), F.col("x.row_id").alias("evidence_row"))


def method_logs_before(probes: DataFrame, matched: DataFrame, window: float) -> DataFrame:
    """All logs matched to the probe's method in [at - window, at)."""
    return _near(
        probes,
        matched.select("service", "method", "timestamp", "row_id"),
        window,
        ["service", "method"],
    ).select("probe_id", "row_id", "timestamp")


def internal_calls(errors: DataFrame, edges: DataFrame, inside: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """service, method, call, n_calls: what the methods of the errors call within their service, and how often.

    inside: the calls below methods in their syntax trees (service, method, call, n_calls); a method without any has the
    internal edges of its call graph instead. Duplicates count.
    """
    roots = errors.select("service", "method").distinct()
    if inside is not None:
        own = cut(inside.join(roots, ["service", "method"], "left_semi").select(
            "service",
            "method",
            "call",
            F.col("n_calls").cast("long").alias("n_calls"),
        ))
        roots = roots.join(own.select("service", "method").distinct(), ["service", "method"], "left_anti")
    named = roots.select(X.qualified(F.col("service"), F.col("method")).alias("root"))
    graph = call_graph(named, edges, depth).where("class = 'internal'")
    out = graph.groupBy(
        X.service_of(F.col("root")).alias("service"),
        X.method_of(F.col("root")).alias("method"),
        X.method_of(F.col("callee")).alias("call"),
    ).agg(F.count("*").alias("n_calls"))
    return out if inside is None else own.unionByName(out)


def call_evidence(
    errors: DataFrame,
    edges: DataFrame,
    matched: DataFrame,
    window: float,
    depth: int = 2,
    inside: DataFrame | None = None,
) -> DataFrame:
    """For each error (error_id, service, method, at) and method that it calls within its service: how often it does, the
    number of matched logs before the error, and the first and the second of them."""
    calls = internal_calls(errors, edges, inside, depth)
    wanted = cut(errors.join(small(calls), ["service", "method"]).select("error_id", "service", F.col("call").alias("method"), "n_calls", "at"))
    logs = _near(wanted.drop("n_calls"), matched.select("service", "method", "timestamp", "row_id"), window, ["service", "method"])
    nth = F.row_number().over(W.partitionBy("error_id", "method").orderBy("timestamp", "row_id"))
    # two rows for each call are kept, and counts are taken before the shuffle
    two = logs.withColumn("nth", nth).where("nth <= 2").groupBy("error_id", "method").agg(*(
        F.max(F.when(F.col("nth") == k, F.col(c))).alias(f"{name}_{to}") for k,
        name in ((1, "first"), (2, "second")) for c,
        to in (("timestamp", "ts"), ("row_id", "row"))
    ))
    seen = logs.groupBy("error_id", "method").agg(F.count("*").alias("n_logs")).join(two, ["error_id", "method"])
    shown = ["first_ts", "first_row", "second_ts", "second_row"]
    return wanted.join(seen, ["error_id", "method"], "left").select(
        "error_id",
        "service",
        "method",
        "n_calls",
        F.coalesce("n_logs", F.lit(0)).alias("n_logs"),
        *shown,
    )


def intra_analysis(errors: DataFrame, edges: DataFrame, matched: DataFrame, window: float = 10.0, inside: DataFrame | None = None) -> DataFrame:
    """One row for each error: calls with and without evidence, in time order, and the share with it. A call that is made
    several times counts as often."""
    each = call_evidence(errors, edges, matched, window, inside=inside)
    done = F.col("n_logs") > 0
    often = lambda x: F.array_repeat(x["method"], x["n"].cast("int"))
    named = F.struct("method", F.col("n_calls").alias("n"))
    path = F.array_sort(F.collect_list(F.when(done, F.struct("first_ts", "method", F.col("n_calls").alias("n")))))
    flat = lambda rows: F.flatten(F.transform(rows, often))
    out = each.groupBy("error_id").agg(
        flat(F.array_sort(F.collect_list(named))).alias("all_internal_calls"),
        flat(path).alias("executed_calls"),
        flat(F.array_sort(F.collect_list(F.when(~done, named)))).alias("not_executed_calls"),
        F.sum("n_calls").alias("total_calls"),
        F.coalesce(F.sum(F.when(done, F.col("n_calls"))), F.lit(0)).alias("matched_calls"),
    )
    out = errors.select("error_id", X.qualified(F.col("service"), F.col("method")).alias("error_method"), "service").join(out, "error_id", "left")
    none = F.expr("cast(array() as array<string>)")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("all_internal_calls", "executed_calls", "not_executed_calls")})
    return out.na.fill(0, ["total_calls", "matched_calls"]).withColumn(
        "confidence",
        F.coalesce(X.share(F.col("matched_calls"), F.col("total_calls")), F.lit(0.0)),
    )


def mentions(logs: DataFrame, names: DataFrame) -> DataFrame:
    """service, method, timestamp, row_id: logs that name a method of their service; names: (service, method)."""
    own = names.groupBy("service").agg(F.collect_set("method").alias("names"))
    rows = logs.select("service", "timestamp", "row_id", "message").join(small(own), "service")
    return rows.select("service", "timestamp", "row_id", F.explode(F.filter("names", lambda x: F.contains(F.col("message"), x))).alias("method"))


def backward_trace(errors: DataFrame, edges: DataFrame, logs: DataFrame, window: float = 10.0, depth: int = 10) -> DataFrame:
    """The chain of callers behind each error (error_id, service, method, at), root first.

    Each hop goes to the caller with the latest log that names it in less than `window` seconds before the head, of ties
    the first in the order of edges (`ord`; without it by name), never back to a method of the chain; its confidence is the
    part of the window that is left. Logs that name a caller are found once; then all errors advance together, one as-of
    join by time buckets a hop.
    """
    pairs = edges.where("kind = 'CALL'").select(F.col("callee").alias("head"), "caller", *(["ord"] if "ord" in edges.columns else []))
    if "ord" in edges.columns:
        calls = pairs.groupBy("head", "caller").agg(F.min("ord").alias("ord"))
    else:  # the window is over edges
        calls = pairs.distinct().withColumn("ord", F.row_number().over(W.partitionBy("head").orderBy("caller")).cast("long"))
    calls = cut(calls.withColumns({"service": X.service_of(F.col("caller")), "method": X.method_of(F.col("caller"))}))
    seen = cut(mentions(logs, calls.select("service", "method").distinct()).withColumn("__bucket", F.floor(F.col("timestamp") / window)))
    hop = F.struct(
        F.col("head").alias("method"),
        F.col("at").alias("timestamp"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("double").alias("confidence"),
    )
    state = cut(errors.select("error_id", X.qualified(F.col("service"), F.col("method")).alias("head"), "at").withColumn("path", F.array(hop)))
    done = []
    for d in range(1, depth + 1):
        tried = state.join(small(calls), "head").where(~F.exists("path", lambda x: x["method"] == F.col("caller"))).select(
            "error_id",
            "at",
            "caller",
            "ord",
            "service",
            "method",
        )
        dealt = tried.withColumn("__bucket", F.explode(F.array(F.floor(F.col("at") / window), F.floor(F.col("at") / window) - 1)))
        near = dealt.join(seen, ["service", "method", "__bucket"]).where(
            (F.col("timestamp") < F.col("at")) & (F.col("at") - F.col("timestamp") < window)
        )
        best = near.groupBy("error_id").agg(F.max_by(F.struct("caller", "timestamp"), F.struct("timestamp", -F.col("ord"))).alias("next"))
        part = 1 - (F.col("at") - F.col("next.timestamp")) / window
        step = F.struct(
            F.col("next.caller").alias("method"),
            F.col("next.timestamp").alias("timestamp"),
            F.lit(d).alias("depth"),
            part.alias("confidence"),
        )
        moved = cut(state.join(best, "error_id", "left").withColumn(
            "path",
            F.when(F.col("next").isNotNull(), F.concat(F.array(step), F.col("path"))).otherwise(F.col("path")),
        ))
        done.append(moved.where("next is null").select("error_id", "path"))
        state = moved.where("next is not null").select("error_id", F.col("next.caller").alias("head"), F.col("next.timestamp").alias("at"), "path")
        if state.isEmpty():
            break
    out = state.select("error_id", "path")
    for part in done:
        out = out.unionByName(part)
    times = F.transform("path", lambda x: x["timestamp"])
    services = F.array_sort(F.array_distinct(F.transform("path", lambda x: X.service_of(x["method"]))))
    return out.select(
        "error_id",
        F.transform("path", lambda x: x["method"]).alias("execution_path"),
        F.array(F.col("path")[0]["method"]).alias("root_methods"),
        services.alias("services_involved"),
        "path",
        times[0].alias("start_time"),
        F.element_at(times, -1).alias("end_time"),
        (F.element_at(times, -1) - times[0]).alias("duration"),
    )


def error_ids(errors: DataFrame) -> DataFrame:
    """errors with `error_name`: error_ and the number in order of error_id, of four digits at least."""
    return numbered(errors, "__n", "error_id").withColumn("error_name", F.format_string("error_%04d", "__n")).drop("__n")


def trace_summary(errors: DataFrame, traces: DataFrame, found: DataFrame) -> DataFrame:
    """One row: errors, those with a trace, patterns, and services of the traced errors. errors: all, with error_id;
    traces: one row for each traced error, with error_method; found: one row for each pattern."""
    services = traces.agg(F.count("*").alias("analyzed"), F.count_distinct(X.service_of(F.col("error_method"))).alias("services_analyzed"))
    return errors.agg(F.count("*").alias("total_errors")).crossJoin(services).crossJoin(found.agg(F.count("*").alias("unique_patterns")))
