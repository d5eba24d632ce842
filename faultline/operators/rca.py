"""Root-cause summaries: the call graph of a window, its statistics, recommendations, and a prompt."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small


def nodes(window: DataFrame) -> DataFrame:
    """Each method's calls, errors, first time in row order and last time."""
    return window.groupBy("qualified_name", "service", "method").agg(
        F.count("*").alias("call_count"),
        F.count_if("is_error").alias("error_count"),
        F.min_by("timestamp", "row_id").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def edges(window: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Call edges with both ends in the window, with their multiplicity."""
    own = small(window.select("qualified_name").distinct())
    inside = call_edges.where("kind = 'CALL'").join(
        own.withColumnRenamed("qualified_name", "caller"),
        "caller",
        "left_semi",
    ).join(own.withColumnRenamed("qualified_name", "callee"), "callee", "left_semi")
    return inside.groupBy("caller", "callee").agg(F.count("*").alias("count")).withColumn(
        "cross_service",
        X.service_of(F.col("caller")) != X.service_of(F.col("callee")),
    )


def error_summary(graph: DataFrame) -> DataFrame:
    """total_errors counts methods that have an error; it is also given as methods_with_errors."""
    bad = F.col("error_count") > 0
    return graph.agg(
        F.count_if(bad).alias("total_errors"),
        F.count_if(bad).alias("methods_with_errors"),
        F.array_sort(F.collect_set(F.when(bad, F.col("service")))).alias("affected_services"),
    )


def service_stats(graph: DataFrame) -> DataFrame:
    return graph.groupBy("service").agg(
        F.sum("call_count").alias("calls"),
        F.sum("error_count").alias("errors"),
    ).withColumn("error_rate", X.share(F.col("errors"), F.col("calls")))


def ranking(graph: DataFrame) -> DataFrame:
    """An extension without a counterpart: services by errors and how early they show, as a plain score."""
    out = graph.groupBy("service").agg(
        F.sum("error_count").alias("errors"),
        F.sum("call_count").alias("calls"),
        F.min(F.when(F.col("error_count") > 0, F.col("first_seen"))).alias("first_error"),
    )
    return out.withColumn(
        "score",
        F.coalesce(X.share(F.col("errors"), F.col("calls")), F.lit(0.0)),
    ).orderBy(F.desc("score"), F.asc_nulls_last("first_error"), "service")


def context_summary(errors: DataFrame, patterns: DataFrame, mapped: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: totals and rates over all errors; a rate without errors is null."""
    total = errors.agg(
        F.count("*").alias("total_errors"),
        F.count_distinct("service").alias("services_affected"),
        F.count_if(F.col("error_type") == "timeout").alias("timeouts"),
    )
    out = total.crossJoin(patterns.agg(
        F.count("*").alias("unique_patterns"),
        F.max("count").alias("most_frequent"),
    )).crossJoin(mapped.agg(F.count("*").alias("mapped_to_methods"))).crossJoin(paths.agg(F.count("*").alias("call_paths_traced")))
    return out.withColumns({
        "deduplication_ratio": 1 - X.share(F.col("unique_patterns"), F.col("total_errors")),
        "mapping_rate": X.share(F.col("mapped_to_methods"), F.col("total_errors")),
    })


def error_roots(mapped: DataFrame) -> DataFrame:
    """root, error_type and first_row of each method that has an error, by its first one. mapped: errors with a method."""
    return mapped.groupBy(F.col("qualified_name").alias("root")).agg(
        F.min_by("error_type", "row_id").alias("error_type"),
        F.min("row_id").alias("first_row"),
    )


def root_causes(roots: DataFrame, paths: DataFrame, most: int | None = 10) -> DataFrame:
    """The first `most` (None: all) methods, by their first error, whose call paths have no call within their service."""
    found = paths.where("n_internal = 0").select("root", F.col("n_outbound").alias("outbound_calls"), "services_involved")
    out = roots.join(found, "root").select(
        F.col("root").alias("method"),
        "error_type",
        F.lit("No incoming calls (potential root cause)").alias("reason"),
        "outbound_calls",
        "services_involved",
        "first_row",
    )
    return out.orderBy("first_row").limit(most) if most else out


def complex_paths(roots: DataFrame, paths: DataFrame, most: int = 10) -> DataFrame:
    """The `most` methods that reach most others, of ties the one with the first error."""
    out = roots.join(paths.select("root", "total_reachable", "call_depth", "services_involved"), "root")
    return out.select(
        F.col("root").alias("method"),
        "error_type",
        "total_reachable",
        "call_depth",
        "services_involved",
        "first_row",
    ).orderBy(F.desc("total_reachable"), "first_row").limit(most)


def path_totals(paths: DataFrame) -> DataFrame:
    """One row: how many call paths there are, and calls within and between services in all of them."""
    return paths.agg(
        F.count("*").alias("call_paths"),
        F.coalesce(F.sum("n_internal"), F.lit(0)).alias("internal_calls"),
        F.coalesce(F.sum("n_outbound"), F.lit(0)).alias("outbound_calls"),
    )


def top_patterns(patterns: DataFrame, total: DataFrame, most: int = 10) -> DataFrame:
    """The `most` frequent step patterns with their share of all errors (total: one row with total_errors)."""
    out = patterns.crossJoin(F.broadcast(total.select("total_errors"))).withColumn("percentage", X.share(F.col("count"), F.col("total_errors")) * 100)
    out = out.withColumns({c: X.iso_text(F.col(c)) for c in ("first_seen", "last_seen")})
    return out.select(
        "signature",
        "error_type",
        "count",
        "percentage",
        "services",
        "normalized_message",
        "first_seen",
        "last_seen",
        F.col("samples").alias("sample_messages"),
        "first_row",
    ).orderBy(F.desc("count"), "first_row").limit(most)


def recommendations(summary: DataFrame, patterns: DataFrame, causes: DataFrame) -> DataFrame:
    """Findings that the summary row gives rise to, in order: priority, finding, action, and the pattern or methods meant.

    patterns: top_patterns(); causes: root_causes(). Both are of bounded size.
    """
    none, no_names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    first = patterns.orderBy(F.desc("count"), "first_row").limit(1).select(F.struct("count", "percentage", "normalized_message").alias("p"))
    names = causes.agg(F.transform(F.array_sort(F.collect_list(F.struct("first_row", "method"))), lambda x: x["method"]).alias("methods"))
    # a row of findings even where there is no pattern at all
    row = summary.select("total_errors", "timeouts").join(F.broadcast(first), F.lit(True), "left").crossJoin(F.broadcast(names))
    item = lambda priority, finding, pattern, methods, action: F.struct(
        F.lit(priority).alias("priority"),
        finding.alias("finding"),
        pattern.alias("pattern"),
        methods.alias("methods"),
        F.lit(action).alias("action"),
    )
    whole = lambda x: F.format_string("%.0f", F.bround(x))
    share = X.share(F.col("timeouts"), F.col("total_errors")) * 100
    dominant = F.when(
        F.col("p.count") > F.col("total_errors") * 0.5,
        item(
            "CRITICAL",
            F.concat(F.lit("One error pattern accounts for "), whole(F.col("p.percentage")), F.lit("% of all errors")),
            F.col("p.normalized_message"),
            no_names,
            "Focus investigation on this specific error pattern",
        ),
    )
    slow = F.when(
        F.col("timeouts") > F.col("total_errors") * 0.3,
        item(
            "HIGH",
            F.concat(F.lit("Timeouts represent "), whole(share), F.lit("% of errors")),
            none,
            no_names,
            "Check service response times, connection pools, and network latency",
        ),
    )
    few = F.when(
        F.size("methods") <= 3,
        item(
            "HIGH",
            F.concat(F.lit("Only "), F.size("methods").cast("string"), F.lit(" root cause methods identified")),
            none,
            F.col("methods"),
            "Investigate these methods - they have no incoming calls",
        ),
    )
    return row.select(F.posexplode(F.array_compact(F.array(dominant, slow, few))).alias("nth", "x")).select("nth", "x.*")


def prompt(graph: DataFrame, links: DataFrame, start: float, end: float, most: int = 10) -> str:
    """A compact text for a language model, from tables of at most a few hundred rows."""
    summary = error_summary(graph).first()
    stats = service_stats(graph).orderBy("service").collect()
    lines = [
        f"Window: {start:.3f} to {end:.3f} ({end - start:.1f} s)",
        f"Services: {', '.join(r.service for r in stats)}",
        f"Methods with errors: {summary.methods_with_errors}; affected services: {', '.join(summary.affected_services)}",
        "",
        "Calls and errors by service:",
    ]
    lines += [f"- {r.service}: {r.calls} calls, {r.errors} errors ({r.error_rate:.1%})" for r in stats]
    order = ["first_edge"] if "first_edge" in links.columns else ["caller", "callee"]
    cross = links.where("cross_service").orderBy(*order).limit(most).collect()
    lines += ["", "Calls between services:", *(f"- {r.caller} -> {r.callee} ({r['count']})" for r in cross)] if cross else []
    return "\n".join([
        *lines,
        "",
        "Rank the services by how likely each is the root cause; give one line a service with confidence and reason, then ROOT_CAUSE and EXPLANATION.",
    ])


def parse_ranking(text: str) -> dict:
    """What a model's answer says: ranking (service, confidence, reason), root_cause and explanation; missing parts are empty."""
    ranking = [{"service": m[1].strip(), "confidence": m[2].upper(), "reason": m[3].strip()} for m in re.finditer(
        r"(?mi)^\s*\d+\.\s*\[?([^\]\n]+?)\]?\s+-\s+\[?(HIGH|MEDIUM|LOW)\]?\s+-\s+(.+)$",
        text,
    )]
    found = {name: re.search(rf"(?m)^\s*{name}:\s*(.+)$", text) for name in ("ROOT_CAUSE", "EXPLANATION")}
    return {"ranking": ranking, **{name.lower(): (m[1].strip().strip("[]") if m else "") for name, m in found.items()}}


def analyze(graph: DataFrame, links: DataFrame, start: float, end: float, model: Callable[[str], str]) -> dict:
    """A model's analysis of a window: the prompt, its answer, and what that says. model maps a prompt to an answer, and is
    whatever the caller has: a local model, a service, or a rule."""
    asked = prompt(graph, links, start, end)
    answer = model(asked)
    return {"prompt": asked, "analysis": answer, **parse_ranking(answer)}


def by_rates(graph: DataFrame) -> Callable[[str], str]:
    """A stand-in for a model: an answer in its format from the ranking of services by errors."""

    def answer(_: str) -> str:
        rows = ranking(graph).collect()  # one for each service
        level = lambda x: "HIGH" if x > 0.5 else "MEDIUM" if x > 0.1 else "LOW"
        lines = [f"{k}. {r.service} - {level(r.score)} - {r.errors} of {r.calls} calls are errors" for k, r in enumerate(rows, 1)]
        best = rows[0].service if rows else "none"
        return "\n".join(["RANKING:", *lines, "", f"ROOT_CAUSE: {best}", f"EXPLANATION: {best} has the largest share of errors."])

    return answer
