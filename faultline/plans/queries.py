"""The registered queries of the log and graph operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import normalize as N
from ..functions import text as X
from ..operators import flows as FL
from ..operators import graph as G
from ..operators import matching as J
from ..operators import mining as P
from ..operators import rca as R
from ..operators import trace as T
from ..session import configure
from ..sources import exports as EX
from ..sources import logs as LG
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Inputs:
    """The views of one session and folder, and what several queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        configure(spark)
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def logs(self) -> DataFrame:
        return V.logs(self.spark, self.dir)

    @property
    def named_logs(self) -> DataFrame:
        return V.logs(self.spark, self.dir, named=True)

    @property
    def methods(self) -> DataFrame:
        return V.methods(self.spark)

    @property
    def matched(self) -> DataFrame:
        return J.match(self.logs, self.methods)

    @property
    def calls(self) -> DataFrame:
        return J.method_calls(self.matched)

    @cached_property
    def held_calls(self) -> DataFrame:
        """Calls, stored: for queries that read them several times."""
        return G.cut(self.calls)

    @cached_property
    def edges(self) -> DataFrame:
        return G.cut(J.all_edges(self.methods))

    @cached_property
    def calls_inside(self) -> DataFrame:
        """service, method, call, n_calls: what a syntax tree says of every third method."""
        own = self.methods.where("rec_idx % 3 = 0").select("service", F.col("name").alias("method"), F.explode("callee_names").alias("call"))
        return own.withColumn("n_calls", (F.length("call") % 3 + 1).cast("long"))

    @property
    def errors(self) -> DataFrame:
        return P.detect(self.logs)

    @property
    def error_roots(self) -> DataFrame:
        return self.held_calls.where("is_error").select(F.col("qualified_name").alias("root")).distinct()

    @property
    def probes(self) -> DataFrame:
        return self.held_calls.where("is_error").select(F.col("row_id").alias("probe_id"), "service", "method", F.col("timestamp").alias("at"))

    @property
    def traced(self) -> DataFrame:
        return self.probes.withColumnRenamed("probe_id", "error_id")

    @cached_property
    def error_methods(self) -> DataFrame:
        return G.cut(J.error_methods(self.matched))

    @cached_property
    def error_paths(self) -> DataFrame:
        """Call paths of the methods that have errors of the step profile."""
        return G.cut(G.call_paths(R.error_roots(self.error_methods).select("root"), self.edges, 3))


def query(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
    return f


@query
def clean_logs(i):
    return i.logs.withColumn("timestamp_str", X.timestamp_text(F.col("timestamp")))


@query
def detect_errors(i):
    return i.errors.select("row_id", "service", "error_type", "severity", "timestamp_str")


@query
def detect_errors_5class(i):
    return i.logs.where(E.is_step_error(F.col("message"))).select("row_id", E.step_class(F.col("message")).alias("error_type"))


@query
def classify_4(i):
    return i.logs.where(E.is_error(F.col("message"))).select("row_id", E.trace_class(F.col("message")).alias("error_type"))


@query
def errors_filtered(i):
    return P.detect(P.select_logs(i.logs, "cartservice", 1704067300.0, 1704075000.0), min_severity=7).select("row_id", "error_type", "severity")


@query
def errors_of_type(i):
    return P.detect(i.logs, "timeout").select("row_id", "error_type", "message")


@query
def errors_with_traceback(i):
    return P.with_traceback(i.errors).select("row_id", "service", "error_type")


@query
def errors_first(i):
    return P.top(i.errors.withColumn("count", F.lit(0)).withColumnRenamed("row_id", "first_row"), 50).select("first_row", "service", "error_type")


@query
def logs_first_of_services(i):
    return P.first_rows(i.logs, ["service"], 20).select("row_id", "service")


@query
def messages_shortened(i):
    rows = i.logs.crossJoin(F.broadcast(i.logs.agg(F.min("timestamp").alias("start"))))
    return rows.select("row_id", X.shortened(F.col("message"), 30).alias("message"), X.relative(F.col("timestamp"), F.col("start")).alias("seconds"))


@query
def call_names(i):
    label = F.concat(F.lit('<CALL> name: "'), "event_type", F.lit('" code'))
    return i.table("events").select("event_id", X.call_name(F.when(F.col("event_id") % 3 > 0, label).otherwise(F.col("event_type"))).alias("call"))


@query
def exception_types(i):
    return i.logs.select("row_id", E.exception_type(F.col("message")).alias("exception_type"))


@query
def error_locations(i):
    return i.logs.select("row_id", E.error_location(F.col("message")).alias("error_location"))


@query
def trace_ids(i):
    return i.logs.select("row_id", E.trace_id(F.col("message")).alias("trace_id"))


@query
def tracebacks_flag(i):
    return i.logs.select("row_id", E.has_traceback(F.col("message")).alias("has_traceback"))


@query
def traceback_lines(i):
    return i.logs.select("row_id", E.traceback_lines(F.col("message")).alias("traceback_lines")).where(F.size("traceback_lines") > 0)


@query
def normalize_mine(i):
    return i.logs.select("row_id", N.normalized(F.col("message"), "mine").alias("normalized"))


@query
def normalize_steps(i):
    return i.logs.select("row_id", N.normalized(F.col("message"), "steps").alias("normalized"))


@query
def normalize_trace(i):
    return i.logs.select("row_id", N.normalized(F.col("message"), "trace").alias("normalized"))


@query
def signatures_mine(i):
    return P.signed(i.errors, "mine").select("row_id", "signature")


@query
def signatures_steps(i):
    return P.signed(i.logs, "steps").select("row_id", "error_type", "signature")


@query
def signatures_trace(i):
    return P.signed(i.logs, "trace").select("row_id", "error_type", "signature")


@query
def patterns_signature(i):
    return P.patterns(P.signed(i.errors, "mine"), ["signature"], 5)


@query
def patterns_service_type(i):
    return P.patterns(P.signed(i.errors, "mine"), ["service", "error_type"], 10)


@query
def patterns_traces(i):
    return P.trace_lines(P.signed(i.errors, "mine"), ["signature"])


@query
def patterns_similarity(i):
    return P.similar_patterns(i.errors)


@query
def patterns_steps(i):
    return P.step_patterns(i.logs).drop("first_row")


@query
def patterns_trace(i):
    return P.trace_patterns(i.logs)


@query
def error_summary(i):
    return P.summary(i.errors)


@query
def errors_by_type(i):
    return P.counts(i.errors, "error_type")


@query
def errors_by_service(i):
    return P.counts(i.errors, "service")


@query
def aggregation_stats(i):
    return P.aggregation_stats(P.patterns(P.signed(i.errors, "mine"), ["signature"], 5))


@query
def top_patterns(i):
    return P.top(P.signed(i.errors, "mine").groupBy("signature").agg(F.count("*").alias("count"), F.min("row_id").alias("first_row")), 10)


@query
def first_traces(i):
    return i.errors.where("has_traceback").orderBy("row_id").select("row_id", "service", "message").limit(3)


@query
def cpg_tokens(i):
    return i.table("pages").select("page_id", X.cpg_tokens(F.col("html")).alias("tokens"))


@query
def string_literals(i):
    return i.table("pages").select("page_id", X.string_literals(F.col("html")).alias("literals"))


@query
def word_tokens(i):
    return i.table("documents").select("doc_id", X.word_tokens(F.col("text")).alias("tokens"))


@query
def jaccard_pairs(i):
    """Pairs of methods of a service that share a token: they meet at shared tokens, never all with all."""
    own = i.methods.select("service", "rec_idx", "tokens", F.explode("tokens").alias("token"))
    a = own.select("service", "token", F.col("rec_idx").alias("a"), F.col("tokens").alias("ta"))
    b = own.select("service", "token", F.col("rec_idx").alias("b"), F.col("tokens").alias("tb"))
    both = a.join(b, ["service", "token"]).where("a < b").dropDuplicates(["service", "a", "b"])
    return both.select("service", "a", "b", X.jaccard(F.col("ta"), F.col("tb")).alias("score"))


@query
def name_index(i):
    return J.name_index(i.methods)


@query
def token_index(i):
    return J.token_index(i.methods)


@query
def method_index(i):
    nodes, edges = V.tree(i.spark, i.dir)
    nodes = nodes.select(
        F.lit("tree").alias("service"),
        "node_id",
        F.xxhash64("node_id").alias("node_ord"),
        "label",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("name", F.lit("")).alias("full_name"),
        F.lit("").alias("line"),
        F.coalesce("code", F.lit("")).alias("code"),
    )
    closure = G.subtree(
        nodes.where("label = 'METHOD'").select("service", F.col("node_id").alias("root")),
        edges.withColumn("service", F.lit("tree")),
        ["service"],
    )
    return J.method_index(nodes, closure).select("node_id", "name", "tokens", "call_tokens", "callee_names")


@query
def match_logs(i):
    return i.matched.select("row_id", "service", "method", "rec_idx", "full_name", "score")


@query
def match_logs_all_services(i):
    return J.match_all_services(i.logs, i.methods).select(
        "row_id",
        "n_candidates",
        "candidates",
        *(f"best_{c}" for c in ("service", "rec_idx", "method", "full_name", "line", "score")),
    )


@query
def method_calls(i):
    return i.calls


@query
def activity(i):
    return J.activity(i.matched)


@query
def edges_intra(i):
    return J.intra_edges(i.methods)


@query
def edges_inter(i):
    return J.inter_edges(i.methods)


@query
def edges_all(i):
    return i.edges


@query
def ast_subtree(i):
    nodes, edges = V.tree(i.spark, i.dir)
    return G.subtree(nodes.where("label = 'METHOD'").select(F.col("node_id").alias("root")), edges)


@query
def call_graph(i):
    return G.call_graph(i.methods.select(X.qualified(F.col("service"), F.col("name")).alias("root")), i.edges, 3)


@query
def reachable_depth(i):
    return G.reach(i.methods.select(X.qualified(F.col("service"), F.col("name")).alias("root")), i.edges, 10)


@query
def call_paths(i):
    return G.call_paths(i.error_roots, i.edges, 3)


@query
def root_causes(i):
    return G.leaf_candidates(i.error_roots, i.edges, 3)


@query
def complex_paths(i):
    return R.complex_paths(R.error_roots(i.error_methods), i.error_paths)


@query
def root_causes_first(i):
    return R.root_causes(R.error_roots(i.error_methods), i.error_paths)


@query
def path_totals(i):
    return R.path_totals(i.error_paths)


@query
def errors_mapped_by_service(i):
    return P.counts(i.error_methods, "service")


@query
def errors_mapped_by_type(i):
    return P.counts(i.error_methods, "error_type")


@query
def top_step_patterns(i):
    found = G.cut(P.step_patterns(i.logs))
    return R.top_patterns(found, found.agg(F.sum("count").alias("total_errors")))


@query
def calls_below(i):
    nodes, edges = V.tree(i.spark, i.dir)
    nodes = nodes.withColumn("service", F.lit("tree"))
    closure = G.subtree(
        nodes.where("label in ('METHOD', 'TYPE_DECL')").select("service", F.col("node_id").alias("root")),
        edges.withColumn("service", F.lit("tree")),
        ["service"],
    )
    return J.calls_below(nodes, closure).drop("service")


@query
def potential_external(i):
    return J.potential_external(
        G.reach(i.methods.select(X.qualified(F.col("service"), F.col("name")).alias("root")), i.edges, 3).select("root", "method"),
        i.methods,
    )


@query
def callers(i):
    return G.callers(i.edges)


@query
def error_window(i):
    return FL.error_window(i.held_calls).select("row_id", "qualified_name", "start_ts", "end_ts")


@query
def window_summary(i):
    return FL.window_summary(FL.error_window(i.held_calls, 600.0))


@query
def flows_time(i):
    return FL.time_sessions(i.calls).select("row_id", "session")


@query
def flow_stats(i):
    return FL.flow_table(FL.time_sessions(i.calls).withColumnRenamed("session", "flow"))


@query
def flows(i):
    return FL.flow_table(FL.flows(i.held_calls, i.edges), i.edges)


@query
def flow_connections(i):
    return FL.flow_connections(FL.time_sessions(i.held_calls, 6.0).withColumnRenamed("session", "flow"), i.edges)


@query
def timeline_arrows(i):
    return FL.arrows(FL.error_window(i.held_calls, 3600.0), i.edges).select("from_row", "to_row", "cross_service")


@query
def method_labels(i):
    return FL.method_labels(i.calls)


@query
def call_times(i):
    return FL.call_times(i.calls)


@query
def axis_ticks(i):
    return FL.ticks(i.held_calls).select(F.round("tick", 6).alias("tick"))


@query
def lanes(i):
    return FL.lanes(i.held_calls)


@query
def stacking(i):
    return FL.stacking(i.held_calls, 15.0).select("row_id", "bucket", "nth", "in_bucket")


@query
def short_labels(i):
    return i.methods.select(
        "service",
        "name",
        X.service_label(F.col("service")).alias("service_label"),
        X.method_label(F.col("name")).alias("method_label"),
    )


@query
def short_labels_of_parts(i):
    name = F.concat_ws("_", "event_type", F.when(F.col("event_id") % 2 == 0, F.lit("of_user")), F.lit(""), F.col("user_id") % 5)
    return i.table("events").select("event_id", name.alias("name"), X.method_label(name).alias("label"))


@query
def times_text(i):
    return i.logs.select("row_id", X.clock_text(F.col("timestamp")).alias("clock"))


@query
def times_iso(i):
    return i.logs.select("row_id", X.iso_text(F.col("timestamp")).alias("iso"))


@query
def evidence_before_10(i):
    return T.evidence_before(i.probes, i.named_logs, 10.0)


@query
def evidence_before_60(i):
    return T.evidence_before(i.probes, i.named_logs, 60.0)


@query
def method_logs_before(i):
    return T.method_logs_before(i.probes, i.calls, 60.0).select("probe_id", "row_id")


@query
def call_evidence(i):
    return T.call_evidence(i.traced, i.edges, i.held_calls, 60.0)


@query
def call_evidence_inside(i):
    return T.call_evidence(i.traced, i.edges, i.held_calls, 60.0, inside=i.calls_inside)


@query
def intra_analysis(i):
    return T.intra_analysis(i.traced, i.edges, i.held_calls, 60.0, i.calls_inside)


@query
def backward_trace(i):
    found = T.backward_trace(i.traced, J.ordered_calls(i.methods), i.named_logs, 60.0)
    parts = F.transform("path", lambda x: F.round(x["confidence"], 4))
    return found.withColumn("confidences", F.filter(parts, lambda x: x.isNotNull())).drop("path")


@query
def error_ids(i):
    return T.error_ids(i.traced).select("error_id", "error_name")


@query
def trace_summary(i):
    traced = i.traced.select("error_id", X.qualified(F.col("service"), F.col("method")).alias("error_method"))
    return T.trace_summary(i.traced, traced, P.trace_patterns(i.logs))


@query
def llm_window_summary(i):
    return EX.window_document(G.cut(FL.error_window(i.held_calls, 600.0)), i.edges)["summary"]


@query
def llm_window_errors(i):
    return EX.window_document(FL.error_window(i.held_calls, 600.0), i.edges)["errors"].withColumnRenamed("__nth", "nth")


@query
def llm_method_sequence(i):
    return EX.window_document(FL.error_window(i.held_calls, 600.0), i.edges)["method_sequence"].withColumnRenamed("__nth", "nth")


@query
def llm_call_relationships(i):
    return EX.window_document(FL.error_window(i.held_calls, 600.0), i.edges)["call_relationships"]


@query
def llm_flows(i):
    rows = EX.flow_document(G.cut(FL.error_window(i.held_calls, 600.0)), i.edges)["execution_flows"]
    return rows.withColumn(
        "method_sequence",
        F.transform("method_sequence", lambda x: F.concat_ws("|", x["qualified_name"], x["timestamp"], x["is_error"].cast("string"))),
    ).drop("__nth")


@query
def rca_nodes(i):
    return R.nodes(i.calls)


@query
def rca_edges(i):
    return R.edges(i.held_calls, i.edges)


@query
def service_stats(i):
    return R.service_stats(R.nodes(i.calls))


@query
def rca_error_summary(i):
    return R.error_summary(R.nodes(i.calls))


@query
def service_ranking(i):
    return R.ranking(R.nodes(i.calls))


@query
def top_methods(i):
    return P.top(P.counts(i.calls.where("is_error"), "qualified_name"), 10).select("qualified_name", "count")


@query
def mapping_coverage(i):
    return J.mapping_coverage(i.matched)


def _context(i, errors):
    """Recommendations over some errors of the step profile."""
    errors = G.cut(errors)
    found = G.cut(P.step_patterns(errors.select("row_id", "timestamp", "service", "message")))
    mapped = i.error_methods.join(errors.select("row_id"), "row_id", "left_semi")
    roots = R.error_roots(mapped)
    summary = G.cut(R.context_summary(errors, found, mapped, roots))
    causes = R.root_causes(roots, i.error_paths.join(roots.select("root"), "root", "left_semi"))
    return R.recommendations(summary, R.top_patterns(found, summary), causes)


@query
def recommendations(i):
    return _context(i, P.signed(i.logs, "steps"))


@query
def recommendations_timeouts(i):
    return _context(i, P.signed(i.logs, "steps").where("error_type = 'timeout' and service in ('redis', 'adservice')"))


@query
def context_summary(i):
    errors = P.signed(i.logs, "steps")
    return R.context_summary(errors, errors.groupBy("signature").agg(F.count("*").alias("count")), i.held_calls.where("is_error"), i.error_roots)


@query
def session_window_batch(i):
    own = i.logs.withColumn("ts", X.moment(F.col("timestamp"))).groupBy(F.session_window("ts", "2 seconds"), "service").agg(F.count("*").alias("n"))
    return own.select("service", F.unix_micros("session_window.start").alias("start_us"), "n")


@query
def log_statistics(i):
    return LG.scan_metrics(i.logs)


@query
def activity_by_second(i):
    return i.logs.groupBy("service", X.timestamp_text(F.col("timestamp")).alias("second")).agg(F.count("*").alias("count"))
