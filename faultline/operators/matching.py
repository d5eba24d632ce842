"""Logs to methods by token-set similarity, and call edges from callee names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import text as X
from ..session import small

#: A match counts if its score, rounded to four places, is above this.
GATE = 0.01


def token_index(methods: DataFrame) -> DataFrame:
    return methods.select("service", "rec_idx", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))


def name_index(methods: DataFrame) -> DataFrame:
    """service, key, rec_idx by short and full name; of equal keys the last method wins."""
    keys = methods.select("service", "rec_idx", F.explode(F.array("name", "full_name")).alias("key")).where("key <> ''")
    return keys.groupBy("service", "key").agg(F.max("rec_idx").alias("rec_idx"))


def _scores(sets: DataFrame, methods: DataFrame, on: list[str]) -> DataFrame:
    """tokens x method: shared tokens and Jaccard score, for pairs with a token in common (inverted index, equi-join)."""
    index = small(token_index(methods))
    shared = sets.select("*", F.explode("tokens").alias("token")).join(
        index.withColumnRenamed("service", "__s") if "service" not in on else index,
        ["token", *on],
    )
    keys = [*sets.columns, *(["__s"] if "service" not in on else [])]
    out = shared.groupBy(*keys, "rec_idx", "n_tokens").agg(F.count("*").alias("both"))
    return out.withColumn("score", F.col("both") / (F.size("tokens") + F.col("n_tokens") - F.col("both")))


def match(logs: DataFrame, methods: DataFrame) -> DataFrame:
    """Each log with its service's best method, or <unknown> with score 0. Each distinct token set is matched once."""
    rows = logs.withColumn("tokens", X.cpg_tokens(F.col("message")))
    sets = rows.select("service", "tokens").distinct()
    best = _scores(sets, methods, ["service"]).groupBy("service", "tokens").agg(F.max_by(
        F.struct("rec_idx", "score"),
        F.struct("score", -F.col("rec_idx")),
    ).alias("b"))
    named = best.select(
        "service",
        "tokens",
        F.col("b.rec_idx").alias("rec_idx"),
        F.col("b.score").alias("score"),
    ).join(small(methods.select("service", "rec_idx", "name", "full_name")), ["service", "rec_idx"])
    return rows.join(named, ["service", "tokens"], "left").drop("tokens").withColumns({
        "method": F.coalesce("name", F.lit("<unknown>")),
        "score": F.coalesce("score", F.lit(0.0)),
    }).drop("name")


def match_all_services(logs: DataFrame, methods: DataFrame, least: float = GATE) -> DataFrame:
    """Each log's best method in any service (of ties, the first service) with its place, and in `candidates` each service's
    best whose score, rounded to four places, is `least` or more; <unknown> and 0 where there is none."""
    rows = logs.withColumn("tokens", X.cpg_tokens(F.col("message")))
    per = _scores(rows.select("tokens").distinct(), methods, []).groupBy("tokens", "__s").agg(F.max_by(
        F.struct("rec_idx", "score"),
        F.struct("score", -F.col("rec_idx")),
    ).alias("b"))
    per = per.select(
        "tokens",
        F.col("__s").alias("service"),
        F.col("b.rec_idx").alias("rec_idx"),
        F.round("b.score", 4).alias("score"),
    ).where(F.col("score") >= least)
    line = "line" if "line" in methods.columns else F.lit("").alias("line")
    per = per.join(small(methods.select("service", "rec_idx", F.col("name").alias("method"), "full_name", line)), ["service", "rec_idx"])
    # at most one row for each service
    ranked = per.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("k"),
        "service",
        "rec_idx",
        "method",
        "full_name",
        "line",
        "score",
    ))).alias("all"))
    first = F.col("all")[0]
    best = ranked.select(
        "tokens",
        F.size("all").alias("n_candidates"),
        *(first[c].alias(f"best_{c}") for c in ("service", "rec_idx", "method", "full_name", "line", "score")),
        F.transform("all", lambda x: F.concat_ws("::", x["service"], x["method"])).alias("candidates"),
    )
    out = rows.join(best, "tokens", "left").drop("tokens")
    blank = {
        "n_candidates": F.lit(0),
        "best_method": F.lit("<unknown>"),
        "best_full_name": F.lit(""),
        "best_line": F.lit(""),
        "best_score": F.lit(0.0),
        "candidates": F.expr("cast(array() as array<string>)"),
    }
    return out.withColumns({c: F.coalesce(c, v) for c, v in blank.items()})


def method_calls(matched: DataFrame) -> DataFrame:
    kept = matched.where((F.col("method") != "<unknown>") & (F.round("score", 4) > GATE))
    return kept.select(
        "row_id",
        "timestamp",
        "service",
        "method",
        X.qualified(F.col("service"), F.col("method")).alias("qualified_name"),
        E.is_error(F.col("message")).alias("is_error"),
        "message",
        F.round("score", 4).alias("score"),
    )


def activity(matched: DataFrame) -> DataFrame:
    """Logs by service, method and second."""
    return matched.groupBy("service", "method", X.timestamp_text(F.col("timestamp")).alias("bucket")).agg(F.count("*").alias("count"))


def _both_ways(calls: DataFrame) -> DataFrame:
    """Call edges, and for each a RETURN edge the other way."""
    back = calls.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), F.lit("RETURN").alias("kind"))
    return calls.select("caller", "callee", F.lit("CALL").alias("kind")).unionByName(back)


def ordered_calls(methods: DataFrame) -> DataFrame:
    """caller, callee, kind and ord of the calls within services; ord: by the caller's number, then the order of its callees."""
    names, own = name_index(methods), methods.select("service", F.col("rec_idx").alias("to"), F.col("name").alias("callee_name"))
    wanted = methods.select("service", "name", F.col("rec_idx").alias("from"), F.posexplode("callee_names").alias("pos", "key"))
    calls = wanted.join(small(names), ["service", "key"]).withColumnRenamed("rec_idx", "to").join(small(own), ["service", "to"])
    ord_ = (F.col("from").cast("long") * (1 << 31) + F.col("pos")).alias("ord")
    return calls.select(
        X.qualified(F.col("service"), F.col("name")).alias("caller"),
        X.qualified(F.col("service"), F.col("callee_name")).alias("callee"),
        F.lit("CALL").alias("kind"),
        ord_,
    )


def intra_edges(methods: DataFrame) -> DataFrame:
    """caller, callee, kind within services: CALL, and RETURN for each the other way."""
    return _both_ways(ordered_calls(methods))


def inter_edges(methods: DataFrame) -> DataFrame:
    """Calls that the own service doesn't resolve, to the first other service that does."""
    names = name_index(methods)
    wanted = methods.select("service", "rec_idx", "name", F.explode("callee_names").alias("key")).join(
        small(names.select("service", "key")),
        ["service", "key"],
        "left_anti",
    )
    other = small(names.select(F.col("service").alias("dst"), "key", F.col("rec_idx").alias("to")))
    found = wanted.join(other, "key").where("dst <> service").groupBy("service", "rec_idx", "name", "key").agg(F.min(F.struct("dst", "to")).alias("x"))
    found = found.select("service", "name", F.col("x.dst").alias("dst"), F.col("x.to").alias("to")).join(
        small(methods.select(F.col("service").alias("dst"), F.col("rec_idx").alias("to"), F.col("name").alias("callee_name"))),
        ["dst", "to"],
    )
    return _both_ways(found.select(
        X.qualified(F.col("service"), F.col("name")).alias("caller"),
        X.qualified(F.col("dst"), F.col("callee_name")).alias("callee"),
    ))


def all_edges(methods: DataFrame) -> DataFrame:
    """Both kinds of edges, with duplicates: edges are a multiset."""
    return intra_edges(methods).unionByName(inter_edges(methods))


def potential_external(reached: DataFrame, methods: DataFrame) -> DataFrame:
    """Callee names of reached methods (root, method) that no service has."""
    named = methods.select(X.qualified(F.col("service"), F.col("name")).alias("method"), F.explode("callee_names").alias("callee"))
    return reached.join(small(named), "method").join(
        small(name_index(methods).select(F.col("key").alias("callee")).distinct()),
        "callee",
        "left_anti",
    ).select("root", "method", "callee").distinct()


def mapping_coverage(matched: DataFrame) -> DataFrame:
    """For each service: its errors (of the step profile) among matched logs, how many have a method, and their share."""
    hit = (F.col("method") != "<unknown>") & (F.round("score", 4) > GATE)
    rows = matched.where(E.is_step_error(F.col("message")))
    out = rows.groupBy("service").agg(F.count("*").alias("errors"), F.count_if(hit).alias("mapped"))
    return out.withColumn("coverage", X.share(F.col("mapped"), F.col("errors")))


def error_methods(matched: DataFrame) -> DataFrame:
    """The errors of the step profile among matched logs that have a method: row_id, qualified_name, service, error_type."""
    rows = matched.where(E.is_step_error(F.col("message"))).where((F.col("method") != "<unknown>") & (F.round("score", 4) > GATE))
    return rows.select(
        "row_id",
        "timestamp",
        "service",
        "method",
        X.qualified(F.col("service"), F.col("method")).alias("qualified_name"),
        E.step_class(F.col("message")).alias("error_type"),
        "message",
    )


def calls_below(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """service, node_id, call, n_calls: the calls below each method in the syntax tree, however often each is made; calls that
    only log are none. Each node counts once for a method, nested methods included."""
    below = closure.join(nodes.select("service", "node_id", "label", "name"), ["service", "node_id"])
    calls = below.where((F.upper("label") == "CALL") & (F.col("name") != "") & ~F.col("name").isin(X.PLAIN_LOG_CALLS))
    return calls.groupBy("service", F.col("root").alias("node_id"), F.col("name").alias("call")).agg(F.count("*").alias("n_calls"))


def method_index(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Methods of a property graph: tokens of name, code and callees below each method, and the callees' names.

    nodes: service, node_id, node_ord, label, name, full_name, line, code. closure: service, root, node_id.
    """
    empty = F.expr("cast(array() as array<string>)")
    roots = nodes.where(X.is_real_method(F.col("label"), F.col("name")))
    below = closure.join(nodes.select("service", "node_id", "label", "name", "code"), ["service", "node_id"])
    call = F.upper("label") == "CALL"
    parts = below.select(
        "service",
        "root",
        F.coalesce(X.cpg_tokens(F.col("code")), empty).alias("c"),
        F.when(call, X.cpg_tokens(F.coalesce("name", F.lit("")))).otherwise(empty).alias("k"),
        F.when(call & (F.col("name") != "") & ~X.is_log_method(F.col("name")), F.col("name")).alias("callee"),
    )
    flat = parts.select("service", "root", "callee", F.explode_outer(F.concat("c", "k")).alias("t"))
    sums = flat.groupBy("service", "root").agg(F.collect_set("t").alias("below"), F.array_sort(F.collect_set("callee")).alias("callee_names"))
    calls = parts.select("service", "root", F.explode("k").alias("t")).groupBy("service", "root").agg(
        F.array_sort(F.collect_set("t")).alias("call_tokens")
    )
    out = roots.join(sums.withColumnRenamed("root", "node_id"), ["service", "node_id"], "left").join(
        calls.withColumnRenamed("root", "node_id"),
        ["service", "node_id"],
        "left",
    )
    order = W.partitionBy("service").orderBy("node_ord")
    return out.select(
        "service",
        (F.row_number().over(order) - 1).alias("rec_idx"),
        "node_id",
        "name",
        "full_name",
        "line",
        F.array_sort(F.array_union(X.cpg_tokens(F.col("name")), F.coalesce("below", empty))).alias("tokens"),
        F.coalesce("call_tokens", empty).alias("call_tokens"),
        F.coalesce("callee_names", empty).alias("callee_names"),
    )
