"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Words are summed by source and hash bucket. Per source, running sums over its buckets find the bucket in which the
budget runs out; only that bucket is refined by the next bits of the hash, until single hashes are left. A document is
taken if its hash is below its source's threshold: no sort of documents, and larger budgets take supersets.

Defined results: null and blank texts have size 0; a null source is a source of its own, ranked last; rows that share a
doc_id share a hash and are taken together; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, drop_tables, materialize

WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words, and how often a source may be repeated.
SHARE, REPEATS = 1.5, 2.0
#: The hash has BITS bits; each level of the histograms splits a bucket by the next STEP of them.
BITS, STEP = 60, 15
#: Up to so many sources their thresholds are sent to all executors; more are joined by a shuffle.
SMALL = 200_000


def size_of(text: Column) -> Column:
    """Words of a text: its pieces between white space, less empty ones at either end."""
    pieces = F.size(F.split(F.coalesce(text, F.lit("")), SPACE))
    at_start = F.coalesce(text, F.lit("")).rlike(r"^[\x20\x09-\x0D]").cast("int")
    at_end = F.coalesce(text, F.lit("")).rlike(r"[\x20\x09-\x0D]\z").cast("int")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 0).otherwise(pieces - at_start - at_end).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(frame: DataFrame, key: str) -> DataFrame:
    """frame, a table of distinct keys, with `rank` from 0 by code point, null last: counts of key ranges, then within them."""
    ranges = materialize(
        frame.repartitionByRange(
            int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            F.col(key).asc_nulls_last(),
        ).withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    before = W.partitionBy().orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = ranges.groupBy("range").agg(F.count("*").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    within = F.row_number().over(W.partitionBy("range").orderBy(F.col(key).asc_nulls_last()))
    return ranges.join(
        F.broadcast(counts.select("range", "before")),
        "range",
    ).withColumn("rank", F.col("before") + within - 1).drop("range", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """source, source_size, target: weighted shares of the budget, where a source's excess over `repeats` times its size
    goes to the others by weight, until none is above. Each round is a sum over the sources; two numbers reach the driver."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    known = materialize(ranked(sources, "source").withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats), "sources")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = total * share, None, -1
    while True:
        above = F.lit(False) if level is None else F.col("most") <= F.col("weight") * F.lit(level[0]) / F.lit(level[1])
        rest, held, n = known.select(
            F.when(~above, F.col("weight")).alias("w"),
            F.when(above, F.col("most")).alias("m"),
        ).agg(F.sum("w"), F.sum("m"), F.count("m")).first()
        if n == full or not rest:
            level = level if rest else (1.0, 0)
            break
        level, full = (budget - (held or 0.0), rest), n
    if not level[1]:
        return known.select("source", "source_size", F.col("most").alias("target"))
    open_share = F.col("weight") * F.lit(float(level[0])) / F.lit(level[1])
    return known.select(
        "source",
        "source_size",
        F.when(F.col("most") <= open_share, F.col("most")).otherwise(open_share).cast("double").alias("target"),
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold, partial: documents with a hash below the threshold fit the budget; so do those at it if partial.

    sizes: source, hash, size. budgets: source, budget. The document at the edge is taken if that comes nearer.
    """
    inside = sizes
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(STEP, BITS + 1, STEP):
        bucket = F.shiftright("hash", BITS - level)
        rows = inside.join(_small(state, inside), inside["source"].eqNullSafe(state["source"])).drop(state["source"])
        if level > STEP:
            rows = rows.where(F.shiftright("hash", BITS - level + STEP) == F.col("prefix"))
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("own"), F.first("left").alias("left"))
        run = F.sum("own").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        edge = sums.withColumn("run", run).where("run > left").groupBy("source").agg(F.min_by(
            F.struct("bucket", "own", "run", "left"),
            "bucket",
        ).alias("x"))
        found = edge.select(
            "source",
            (F.col("x.left") - (F.col("x.run") - F.col("x.own"))).alias("left"),
            F.col("x.bucket").alias("prefix"),
            F.col("x.own").alias("own"),
        )
        state = found if level == BITS else materialize(found.drop("own"), "edge")
    return state.select("source", F.col("prefix").alias("threshold"), (F.col("left") * 2 >= F.col("own")).alias("partial"))


def _small(frame: DataFrame, other: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.limit(SMALL + 1).count() <= SMALL else frame


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row: `taken` words, repeats counted, go into the mix.

    A source with a target of f whole passes and a rest is taken f times, and once more below its threshold.
    """
    sizes = materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size_of(F.col("text").cast("string")).alias("size"),
        ).withColumn("hash", hash_of(F.col("doc_id"))),
        "sizes",
    )
    wanted = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    wanted = materialize(
        wanted.withColumn(
            "passes",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        ).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")),
        "targets",
    )
    edges = materialize(thresholds(sizes, wanted.where("budget > 0").select("source", "budget")), "thresholds")
    per = wanted.alias("w").join(edges.alias("e"), F.col("w.source").eqNullSafe(F.col("e.source")), "left").select(
        "w.source",
        "source_size",
        "target",
        "passes",
        F.col("budget") > 0,
        "threshold",
        "partial",
    ).toDF("s", "source_size", "target", "passes", "more", "threshold", "partial")
    per = materialize(per, "passes")
    below = F.col("more") & (
        F.col("threshold").isNull() | (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("partial"))
    )
    out = sizes.join(_small(per, sizes), F.col("source").eqNullSafe(F.col("s")))
    drop_tables(documents.sparkSession, edges, wanted)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + below.cast("long"))).alias("taken"))
