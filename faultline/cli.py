"""The command line: each command reads files, composes operators and writes its results below --out."""

from __future__ import annotations

import argparse
import importlib
import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flows, graph, matching, mining, rca, trace
from .session import configure
from .sources import dot, exports, logs, sinks

STRATEGIES = ("signature", "service-type", "similarity")


def graphs_of(spark: SparkSession, services_dir: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the property graphs of the services that the logs name and that have one, and what is below methods."""
    paths = [r.path for r in logs.services_with_graph(spark, services_dir, rows).collect()]  # one for each service
    if not paths:
        raise SystemExit(f"no service of the logs has an export.dot below {services_dir}")
    nodes, links = dot.read_dot(spark, paths)
    roots = nodes.where(F.col("label") == "METHOD").select("service", F.col("node_id").alias("root"))
    return nodes, graph.cut(graph.subtree(roots, dot.ast_edges(links), ["service"]))


def methods_of(nodes: DataFrame, below: DataFrame) -> DataFrame:
    return graph.cut(matching.method_index(nodes, below))


def errors(spark: SparkSession, o: argparse.Namespace) -> None:
    """Errors of a log file: the summary counts all of them, the other filters come after it."""
    found = mining.detect(mining.select_logs(logs.read_csv(spark, o.csv), o.service, o.start_ts, o.end_ts), o.error_type, o.min_severity)
    found = graph.cut(found)
    shown = mining.with_traceback(found) if o.with_traceback else found
    if "json" in o.formats:
        by = {
            f"errors_by_{name}": mining.counts(found, key).select(
                key,
                "count",
                F.row_number().over(flows.W.orderBy(F.desc("count"), "first_row")).alias("__nth"),
            ) for name,
            key in (("type", "error_type"), ("service", "service"))
        }
        sinks.write_document({"summary": mining.summary(found), **by, "errors": shown.withColumn("__nth", F.col("row_id"))}, f"{o.out}/errors.json")
    if "csv" in o.formats:
        sinks.write_errors_csv(shown, f"{o.out}/errors.csv")
    if "text" in o.formats:
        sinks.write_report(shown, f"{o.out}/errors.txt")
    if not o.quiet:
        print(sinks.report(found))


def patterns(spark: SparkSession, o: argparse.Namespace) -> None:
    """Errors with equal signatures, equal service and type, or similar words, by number."""
    found = logs.read_errors_json(spark, o.json) if o.json else logs.read_errors_csv(spark, o.csv)
    if o.strategy == "similarity":
        out = mining.similar_patterns(found, o.threshold)
    elif o.strategy == "service-type":
        out = mining.patterns(mining.signed(found, "mine"), ["service", "error_type"], 10)
    else:
        signed = graph.cut(mining.signed(found, "mine"))
        out = mining.patterns(signed, ["signature"], 5)
        sinks.write_json(mining.trace_lines(signed, ["signature"]), f"{o.out}/trace_lines.json")
    out = graph.cut(out)
    sinks.write_json(mining.aggregation_stats(out), f"{o.out}/stats.json")
    if o.strategy != "service-type":
        sinks.write_patterns_csv(out, f"{o.out}/patterns.csv")
    sinks.write_json(out.orderBy(F.desc("count"), "first_seen"), f"{o.out}/patterns.json")
    if not o.quiet:
        print(sinks.pattern_report(out))


def model_of(name: str | None, nodes: DataFrame):
    """The callable that module:function names, or the stand-in that ranks services by errors."""
    if not name:
        return rca.by_rates(nodes)
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def window(spark: SparkSession, o: argparse.Namespace) -> None:
    """Calls around the first error, their flows, graph and layout. Calls and edges are cached beside the results."""
    key = sinks.cache_key(o.csv, os.path.getmtime(o.csv), o.services_dir)
    held = None if o.rebuild_cache else sinks.load_cache(spark, f"{o.out}/cache", key)
    if held is None:
        rows = logs.read_csv(spark, o.csv)
        methods = methods_of(*graphs_of(spark, o.services_dir, rows))
        sinks.save_cache(
            {"calls": matching.method_calls(matching.match(rows, methods)), "edges": matching.all_edges(methods), "logs": logs.scan_metrics(rows)},
            f"{o.out}/cache",
            key,
        )
        held = sinks.load_cache(spark, f"{o.out}/cache", key)
    inside = graph.cut(flows.error_window(held["calls"], o.window))
    nodes, links = rca.nodes(inside), rca.edges(inside, held["edges"])
    folded = flows.flow_table(flows.flows(inside, held["edges"], o.flow_window), held["edges"])
    tables = {
        "logs": held["logs"],
        "summary": flows.window_summary(inside),
        "flows": folded,
        "nodes": nodes,
        "edges": links,
        "service_stats": rca.service_stats(nodes),
        "labels": flows.method_labels(inside),
        "call_times": flows.call_times(inside),
        "lanes": flows.lanes(inside),
        "ticks": flows.ticks(inside),
        "arrows": flows.arrows(inside, held["edges"]),
    }
    for name, frame in tables.items():
        sinks.write_json(frame, f"{o.out}/{name}.json")
    sinks.write_document(exports.window_document(inside, held["edges"]), f"{o.out}/llm_input.json")
    sinks.write_document(exports.flow_document(inside, held["edges"], o.flow_window), f"{o.out}/llm_input_flows.json")
    bounds = inside.agg(F.min("start_ts"), F.max("end_ts")).first()
    if bounds[0] is not None:
        found = rca.analyze(nodes, links, *bounds, model_of(o.model, nodes))
        text = json.dumps({"timestamp": datetime.now(timezone.utc).isoformat(), "model": o.model or "by_rates", **found}, indent=2)
        spark.createDataFrame([(found["prompt"],)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.out}/prompt.txt")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.out}/analysis.json")
    if not o.quiet:
        print(sinks.table_report("Window:", tables["summary"]))
        print(sinks.table_report("Services:", tables["service_stats"].orderBy("service")))


def steps(spark: SparkSession, o: argparse.Namespace) -> None:
    """Errors, patterns, methods of errors, call paths and the context of all, one output a step."""
    rows = logs.read_csv(spark, o.csv, strip_service=False)
    found = graph.cut(mining.signed(rows, "steps"))
    methods = methods_of(*graphs_of(spark, o.services_dir, rows))
    limited = found.orderBy("row_id").limit(o.max_errors) if o.max_errors else found
    mapped = graph.cut(matching.error_methods(matching.match(limited.select("row_id", "timestamp", "service", "message"), methods)))
    similar = graph.cut(mining.step_patterns(rows))
    paths = graph.cut(graph.call_paths(rca.error_roots(mapped).select("root"), graph.cut(matching.all_edges(methods)), o.max_depth))
    context = exports.context_document(found, similar, mapped, paths)
    for name, frame in {
        "1_errors": found,
        "2_patterns": similar,
        "3_error_methods": mapped,
        "4_call_paths": paths,
        "5_root_causes": context["root_causes"].drop("__nth"),
    }.items():
        sinks.write_json(frame, f"{o.out}/{name}.json")
    sinks.write_document(context, f"{o.out}/6_context.json")
    if not o.quiet:
        print(sinks.table_report("Context:", context["summary"]))
        print(sinks.table_report("Call paths:", context["path_totals"]))


def traces(spark: SparkSession, o: argparse.Namespace) -> None:
    """What each error's method called before it, and the chain of callers behind it."""
    rows = logs.read_csv(spark, o.csv)
    nodes, below = graphs_of(spark, o.services_dir, rows)
    methods = methods_of(nodes, below)
    inside = matching.calls_below(nodes, below).join(nodes.select("service", "node_id", F.col("name").alias("method")), ["service", "node_id"])
    calls, edges = graph.cut(matching.method_calls(matching.match(rows, methods))), graph.cut(matching.ordered_calls(methods))
    wrong = calls.where("is_error").select(F.col("row_id").alias("error_id"), "service", "method", F.col("timestamp").alias("at"), "message")
    probes = trace.error_ids(wrong.orderBy("error_id").limit(o.limit) if o.limit else wrong)
    names = graph.cut(probes.select("error_id", "error_name", F.col("message").alias("error_message"), F.col("at").alias("error_time")))
    probes = graph.cut(probes.drop("error_name", "message"))
    found = graph.cut(mining.trace_patterns(rows))
    intra = graph.cut(trace.intra_analysis(probes, edges, calls, o.window, inside))
    back = trace.backward_trace(probes, edges, rows, o.window, o.max_depth)
    evidence = trace.call_evidence(probes, edges, calls, o.window, inside=inside)
    whole = trace.trace_summary(wrong, intra, found)
    for name, frame in {
        "0_summary": whole,
        "1_error_patterns": found,
        "2_intra": names.join(intra, "error_id"),
        "2_call_evidence": evidence,
        "2_backward": names.join(back, "error_id"),
    }.items():
        sinks.write_json(frame, f"{o.out}/{name}.json")
    if not o.quiet:
        print(sinks.table_report("Traces:", whole))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="faultline", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, graphs: bool = False, csv: bool = True) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=run.__doc__)
        own.set_defaults(run=run)
        own.add_argument("--out", required=True)
        own.add_argument("--quiet", action="store_true")
        if csv:
            own.add_argument("--csv", required=True)
        if graphs:
            own.add_argument("--services-dir", required=True)
        return own

    c = command("errors", errors)
    c.add_argument("--service")
    c.add_argument("--error-type")
    c.add_argument("--with-traceback", action="store_true")
    c.add_argument("--min-severity", type=int, default=1)
    c.add_argument("--start-ts", type=float)
    c.add_argument("--end-ts", type=float)
    c.add_argument("--formats", nargs="*", choices=("json", "csv", "text"), default=["json", "csv"])
    c = command("patterns", patterns, csv=False)
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv")
    source.add_argument("--json")
    c.add_argument("--strategy", choices=STRATEGIES, default="signature")
    c.add_argument("--threshold", type=float, default=0.8)
    c = command("window", window, graphs=True)
    c.add_argument("--window", type=float, default=10.0)
    c.add_argument("--flow-window", type=float, default=2.0)
    c.add_argument("--rebuild-cache", action="store_true")
    c.add_argument("--model", help="module:function that maps a prompt to an answer; without it services are ranked by errors")
    c = command("steps", steps, graphs=True)
    c.add_argument("--max-errors", type=int)
    c.add_argument("--max-depth", type=int, default=3)
    c = command("trace", traces, graphs=True)
    c.add_argument("--window", type=float, default=10.0)
    c.add_argument("--max-depth", type=int, default=10)
    c.add_argument("--limit", type=int)
    return top


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = parser().parse_args(given)
    options.run(configure(spark or SparkSession.builder.getOrCreate()), options)


if __name__ == "__main__":
    main()
