"""The documents that other tools read: parts of each as tables, which sinks.write_document writes as one JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import flows, mining, rca


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Calls in the order of row_id, with the time as ISO text."""
    return rows.select(*columns, X.iso_text(F.col("timestamp")).alias("timestamp"), F.col("row_id").alias("__nth"))


def window_document(inside: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """A window's summary, errors, calls in order and call relationships. inside: error_window(); edges: all_edges()."""
    summary = inside.agg(
        F.count("*").alias("total_method_calls"),
        F.count_if("is_error").alias("error_count"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.max(F.col("end_ts") - F.col("start_ts")).alias("time_range_seconds"),
        X.iso_text(F.min(F.when(F.col("is_error"), F.col("timestamp")))).alias("first_error_time"),
    )
    return {
        "summary": summary,
        "errors": _shown(inside.where("is_error"), "service", "method", "message"),
        "lifecycle_events": inside.where(F.lit(False)).select("service", F.lit("").alias("type"), "timestamp", "message"),
        "method_sequence": _shown(inside, "service", "method", "is_error"),
        "call_relationships": edges.where("kind = 'CALL'").select("caller", "callee"),
    }


def flow_document(inside: DataFrame, edges: DataFrame, gap: float = 2.0) -> dict[str, DataFrame]:
    """window_document() with the execution flows and their calls instead of one sequence. A flow's calls are one value,
    as the document has them: flows of a window, not of all logs."""
    parts = window_document(inside, edges)
    folded = flows.cut(flows.flows(inside, edges, gap))
    table = flows.cut(flows.flow_table(folded, edges))
    call = F.struct(
        "timestamp",
        "row_id",
        F.struct("service", "method", "qualified_name", X.iso_text(F.col("timestamp")).alias("timestamp"), "is_error").alias("call"),
    )
    calls = folded.groupBy(F.format_string("flow_%04d", "flow").alias("flow_id")).agg(F.transform(
        F.array_sort(F.collect_list(call)),
        lambda x: x["call"],
    ).alias("method_sequence"))
    counts = table.agg(F.count("*").alias("total_flows"), F.count_if("has_error").alias("error_flows"))
    shown = [
        "flow_id",
        "root_methods",
        "leaf_methods",
        "services_involved",
        F.round("duration", 3).alias("duration_seconds"),
        "has_error",
        "error_count",
        "method_sequence",
    ]
    rows = table.join(calls, "flow_id").select(*shown, F.regexp_extract("flow_id", "[0-9]+", 0).cast("long").alias("__nth"))
    return {
        "summary": parts["summary"].crossJoin(counts),
        "errors": parts["errors"],
        "execution_flows": rows,
        "lifecycle_events": parts["lifecycle_events"],
        "call_relationships": parts["call_relationships"],
    }


def context_document(errors: DataFrame, patterns: DataFrame, mapped: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """The context of the six steps: summary, top patterns, errors by service and type, root causes, complex paths and
    recommendations. errors: signed() with the step profile; mapped: error_methods(); paths: call_paths() of their roots."""
    roots = rca.error_roots(mapped)
    summary = rca.context_summary(errors, patterns, mapped, roots)
    first = rca.top_patterns(patterns, summary)
    causes = rca.root_causes(roots, paths)
    best = mining.top(mining.counts(mapped, "qualified_name"), 10)
    ranked = lambda frame, key: frame.select(
        key,
        "count",
        F.row_number().over(flows.W.orderBy(F.desc("count"), "first_row")).alias("__nth"),
    )
    by = {name: ranked(mining.counts(mapped, key), key) for name, key in (("by_service", "service"), ("by_error_type", "error_type"))}
    numbered = lambda frame, *order: frame.withColumn("__nth", F.row_number().over(flows.W.orderBy(*order)))
    return {
        "summary": summary.drop("timeouts", "most_frequent"),
        "error_patterns": numbered(first, F.desc("count"), "first_row").drop("first_row"),
        **by,
        "top_methods": ranked(best, "qualified_name"),
        "path_totals": rca.path_totals(paths),
        "root_causes": numbered(causes, "first_row").drop("first_row"),
        "complex_paths": numbered(rca.complex_paths(roots, paths), F.desc("total_reachable"), "first_row").drop("first_row"),
        "recommendations": rca.recommendations(summary, first, causes).withColumnRenamed("nth", "__nth"),
    }
