"""Graph operators as frontier rounds over edge tables: one round per level, all roots at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpoint_dir


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder that the session names."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(frame.sparkSession))
    return frame.checkpoint()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def subtree(roots: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(root, node_id) of all that AST edges (src, dst) reach from roots (root), each once, roots included.

    Rounds go on until no node is new, however deep the tree. Each round's nodes are stored once and never copied.
    """
    keys = keys or []
    step = edges.select(*keys, F.col("src").alias("node_id"), "dst")
    levels = [cut(roots.select(*keys, "root", F.col("root").alias("node_id")).distinct())]
    seen, since = levels[0], 1
    while True:
        front = levels[-1].join(step, [*keys, "node_id"]).select(*keys, "root", F.col("dst").alias("node_id")).distinct()
        front = cut(front.join(seen, [*keys, "root", "node_id"], "left_anti"))
        if front.isEmpty():
            return seen
        levels.append(front)
        since += 1
        # plans stay short: every 16 levels what is known becomes one table
        seen = cut(seen.unionByName(front)) if since % 16 == 0 else seen.unionByName(front)


def reach(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, method, bfs_depth) over CALL edges up to `depth` hops from roots (root)."""
    calls = cut(edges.where("kind = 'CALL'").select("caller", "callee").distinct())
    levels = [cut(roots.select("root", F.col("root").alias("method"), F.lit(0).alias("bfs_depth")).distinct())]
    for d in range(1, depth + 1):
        step = levels[-1].select("root", F.col("method").alias("caller")).join(calls, "caller").select("root", F.col("callee").alias("method")).distinct()
        front = cut(step.join(_union(levels), ["root", "method"], "left_anti").withColumn("bfs_depth", F.lit(d)))
        if front.isEmpty():
            break
        levels.append(front)
    return _union(levels)


def call_graph(roots: DataFrame, edges: DataFrame, depth: int, seen: DataFrame | None = None) -> DataFrame:
    """Every edge out of a method at less than `depth` hops, classed against the root's service; duplicates stay.

    internal: within a service that is the root's; outbound: out of it; external_chain: from any other service.
    seen: what reach() gives for the same roots and depth, where it is known already.
    """
    seen = reach(roots, edges, depth) if seen is None else seen
    own = seen.where(F.col("bfs_depth") < depth).select("root", F.col("method").alias("caller"), F.col("bfs_depth").alias("depth"))
    out = own.join(edges.where("kind = 'CALL'").select("caller", "callee"), "caller")
    home, a, b = X.service_of(F.col("root")), X.service_of(F.col("caller")), X.service_of(F.col("callee"))
    kind = F.when((a == home) & (b == home), "internal").when(a == home, "outbound").otherwise("external_chain")
    return out.select("root", "caller", "callee", kind.alias("class"), "depth")


def call_paths(roots: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """For each root: its reachable methods, services and depth, and how many calls of each class it has."""
    seen = reach(roots, edges, depth)
    graph = call_graph(roots, edges, depth, seen)
    size = seen.groupBy("root").agg(
        F.count("*").alias("total_reachable"),
        F.max("bfs_depth").alias("call_depth"),
        F.array_sort(F.collect_set(X.service_of(F.col("method")))).alias("services_involved"),
    )
    calls = graph.groupBy("root").agg(*(F.count_if(F.col("class") == k).alias(f"n_{k}") for k in ("internal", "outbound", "external_chain")))
    return size.join(calls, "root", "left").na.fill(0, ["n_internal", "n_outbound", "n_external_chain"])


def leaf_candidates(roots: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Roots whose bounded call graph has no call within their service."""
    return call_paths(roots, edges, depth).where("n_internal = 0").select("root")


def callers(edges: DataFrame) -> DataFrame:
    calls = edges.where("kind = 'CALL'")
    return calls.select(
        F.col("callee").alias("method"),
        "caller",
        (X.service_of(F.col("caller")) != X.service_of(F.col("callee"))).alias("is_external"),
    )
