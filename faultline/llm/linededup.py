"""Line dedup; DataFrame functions only. A suffix array over the sequences of line ids is built by distributed prefix
doubling: ranks of w lines and of the w lines after them rank 2w lines, until only suffixes that end alike share a rank.
Longest common prefixes of neighbours in that order, looked up by halving widths, give for every suffix the longest run of
lines that occurs elsewhere too; those that no longer one contains are the maximal repeated runs. All but the first copy
of a run of `least` lines or more is deleted: suffixes that share so many lines are one LCP interval, the first of which
stays. `least` is a power of two.

Defined results: a line is what \\n separates; one without a word is blank, is no part of a run and stays. The first copy
is that of the least doc_id (null last), then of the first line. Rows that share a doc_id and a text are one document and
are cut alike. A null text stays null. Columns of documents other than text stay as they are. An empty table gives one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Tables, drop_tables, materialize, store

LEAST = 2
_PLACE = ["doc_id", "print", "nth"]


def line_ids(documents: DataFrame) -> DataFrame:
    """doc_id, print (of the text), nth (among lines that aren't blank), line (among all) and id of each line."""
    each = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    ids = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.when(x.rlike(WORD), F.xxhash64(x)).alias("id")))
    own = F.filter(ids, lambda x: x["id"].isNotNull())
    rows = each.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(own).alias("nth", "x"))
    return rows.select("doc_id", "print", "nth", F.col("x.line").alias("line"), F.col("x.id").alias("id"))


def _same_place(doc_id: str, mark: str, nth: Column) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("print") == F.col(mark)) & (F.col("nth") == nth)


def _at(ranks: DataFrame, tag: str, *more: str) -> DataFrame:
    """Ranks by place, with names of their own for a join."""
    return ranks.select(*(F.col(c).alias(c + tag) for c in (*_PLACE, "rank", *more)))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Of distinct (a, b) with n suffixes each: next, a plus the number of suffixes with this a and a smaller b.

    A range partitioning sorts the pairs, so a rank that very many suffixes share is split; what goes before a range, and
    where a rank that spans ranges begins, is known from one row for each range.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(pairs.repartitionByRange(parts, "a", "b").withColumn("range", F.spark_partition_id()), "ranges")
    order = W.partitionBy("range").orderBy("a", "b")
    inner = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = ranges.withColumn("inner", inner).withColumn("begin", F.first("inner").over(W.partitionBy("range", "a").orderBy("b")))
    heads = inner.groupBy("range").agg(F.sum("n").alias("own"), F.max(F.struct("a", "begin")).alias("last"))
    heads = heads.withColumn("before", F.coalesce(F.sum("own").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    carried = heads.groupBy(F.col("last.a").alias("a")).agg(F.min(F.col("before") + F.col("last.begin")).alias("early"))
    out = inner.join(F.broadcast(heads.select("range", "before")), "range").join(F.broadcast(carried), "a", "left")
    base = F.least(F.col("before") + F.col("begin"), F.coalesce("early", F.col("before") + F.col("begin")))
    return out.select("a", "b", "n", (F.col("a") + F.col("before") + F.col("inner") - base).alias("next"))


class Suffixes:
    """Suffixes of the lines that occur twice or more; a line that occurs once ends them, as a text's end does.

    levels: by k, the ranks of suffixes that share 2^k whole lines with another. final: doc_id, print, nth, line, left
    (lines to the suffix's end), rank and k of every suffix. Ranks sort like suffixes, and equal ones are equal to the end;
    2^k lines but not 2^(k+1) are common with the rank before (null: none).
    """

    def __init__(self, lines: DataFrame) -> None:
        spark = lines.sparkSession
        often = materialize(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "often")
        firsts = _ranked(often.select(
            F.lit(0).cast("long").alias("a"),
            F.col("id").alias("b"),
            "n",
        )).select(F.col("b").alias("id"), F.col("next").alias("rank"))
        own = lines.join(materialize(firsts, "first-ranks"), "id")
        # neighbouring lines make an island; its end is that of its suffixes
        island = F.col("nth") - F.row_number().over(W.partitionBy("doc_id", "print").orderBy("nth"))
        own = own.withColumn("island", island).withColumn("left", F.max("nth").over(W.partitionBy("doc_id", "print", "island")) - F.col("nth") + 1)
        first = own.select(
            *(*_PLACE, "line", "left", "rank"),
            F.lit(None).cast("int").alias("k"),
            F.lit(2).cast("long").alias("n"),
            F.lit(1).alias("depth"),
            F.lit(0).alias("level"),
        )
        read = lambda paths: spark.read.schema(first.schema).parquet(*paths)
        # depth and level are data, and earlier tables one scan, so that all rounds have the same plan and compiled code
        ends = (F.col("n") == 1) | (F.col("left") < F.col("depth"))
        paths, self.levels = [store(first, "suffixes")], []
        while True:
            last = read(paths[-1:])
            active = last.where(~ends)
            if active.isEmpty():
                break
            self.levels.append(active.select(*_PLACE, "line", "rank", "depth"))
            every = last.unionByName(read(paths[:-1] or paths).where(ends))
            joined = active.join(_at(every, "_2"), _same_place("doc_id_2", "print_2", F.col("nth_2") - F.col("depth")), "left")
            both = materialize(
                joined.select(*_PLACE, "line", "left", "k", "depth", "level", F.col("rank").alias("a"), F.coalesce("rank_2", F.lit(-1)).alias("b")),
                "pairs",
            )
            counted = _ranked(both.groupBy("a", "b").agg(F.count("*").alias("n")))
            now = both.join(counted, ["a", "b"]).select(
                *(*_PLACE, "line", "left"),
                F.col("next").alias("rank"),
                F.when(F.col("next") > F.col("a"), F.col("level")).otherwise(F.col("k")).alias("k"),
                "n",
                (F.col("depth") * 2).alias("depth"),
                (F.col("level") + 1).alias("level"),
            )
            paths.append(store(now, "suffixes"))
            drop_tables(spark, both)
        self.final = read(paths).where(ends).select(*_PLACE, "line", "left", "rank", "k")

    def common(self) -> DataFrame:
        """rank, n, and lcp, the lines that a suffix of this rank has in common with one of the rank before."""
        groups = self.final.groupBy("rank").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.min(F.struct(*_PLACE)).alias("x"))
        parts = int(self.final.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        groups = materialize(groups.repartitionByRange(parts, "rank").withColumn("range", F.spark_partition_id()), "groups")
        last = groups.groupBy("range").agg(F.max(F.struct("rank", "x")).alias("last"))
        last = last.select("range", F.lag("last.x").over(W.orderBy("range")).alias("early"))
        order = W.partitionBy("range").orderBy("rank")
        pairs = groups.join(F.broadcast(last), "range").withColumn("y", F.coalesce(F.lag("x").over(order), "early"))
        pairs = materialize(pairs.select("rank", "n", "k", "x", "y", F.coalesce(F.expr("shiftleft(1, k)"), F.lit(0)).alias("lcp")), "neighbours")
        now = None
        for k in reversed(range(len(self.levels) - 1)):
            entered = pairs.where(F.col("k") == k + 1)
            now = entered if now is None else now.unionByName(entered)
            for side in "xy":
                level = _at(self.levels[k], "_" + side, "depth")
                here = F.col(f"{side}.doc_id").eqNullSafe(F.col(f"doc_id_{side}")) & (F.col(f"{side}.print") == F.col(f"print_{side}")) & (
                    F.col(f"{side}.nth") + F.col("lcp") == F.col(f"nth_{side}")
                )
                now = now.join(level, here, "left").drop(*(f"{c}_{side}" for c in _PLACE))
            longer = F.when(F.col("rank_x") == F.col("rank_y"), F.col("depth_x")).otherwise(0)
            now = now.withColumn("lcp", F.col("lcp") + longer).drop("rank_x", "rank_y", "depth_x", "depth_y")
            now = now if k % 3 else materialize(now, "neighbours")  # stored now and then, as plans grow
        rest = pairs.where("k is null or k = 0")
        return (rest if now is None else rest.unionByName(now)).select("rank", "n", "lcp")

    def longest(self) -> DataFrame:
        """doc_id, print, nth, line and most: the lines of the longest run from there on that occurs elsewhere too."""
        parts = int(self.final.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranks = materialize(self.common().repartitionByRange(parts, "rank").withColumn("range", F.spark_partition_id()), "lcp")
        head = ranks.groupBy("range").agg(F.min(F.struct("rank", "lcp")).alias("head"))
        head = head.select("range", F.lead("head.lcp").over(W.orderBy("range")).alias("late"))
        after = F.coalesce(F.lead("lcp").over(W.partitionBy("range").orderBy("rank")), "late", F.lit(0))
        near = ranks.join(F.broadcast(head), "range").select("rank", "n", F.greatest("lcp", after).alias("near"))
        out = self.final.join(materialize(near, "nearest"), "rank")
        return out.select(*_PLACE, "line", F.when(F.col("n") > 1, F.col("left")).otherwise(F.col("near")).alias("most"))


def _maximal(longest: DataFrame, least: int) -> DataFrame:
    order = W.partitionBy("doc_id", "print").orderBy("nth")
    longest = longest.withColumn(
        "inside",
        F.coalesce((F.lag("nth").over(order) == F.col("nth") - 1) & (F.lag("most").over(order) > F.col("most")), F.lit(False)),
    )
    return longest.where((F.col("most") >= least) & ~F.col("inside")).select(*_PLACE, "line", F.col("most").alias("n_lines"))


def repeated_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, line (its first, among all lines) and n_lines (that aren't blank) of every maximal repeated run of `least`
    lines or more: it occurs elsewhere too, in the same text or another, and no longer one contains it there."""
    with Tables(documents.sparkSession) as made:
        suffixes = Suffixes(materialize(line_ids(documents).distinct(), "lines"))
        return made.keep(_maximal(suffixes.longest(), least).select("doc_id", "line", "n_lines"), "repeated-runs")


def findings(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, print, gone (lines that are in a later copy of a repeated run), n_runs and longest_run of documents that
    have a repeated run."""
    if least & (least - 1) or least < 1:
        raise ValueError("least is a power of two")
    lines = materialize(line_ids(documents).distinct(), "lines")
    suffixes = Suffixes(lines)
    runs = _maximal(suffixes.longest(), least)
    none = F.lit(None).cast("int")
    found = runs.select("doc_id", "print", F.col("n_lines").alias("run"), none.alias("gone"))
    depth = least.bit_length() - 1
    if depth < len(suffixes.levels):
        shared = suffixes.levels[depth]
        # of level 0, all; stored, so that a rank that very many suffixes share is split in the join
        first = materialize(shared.groupBy("rank").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), *_PLACE)).alias("first")), "firsts")
        later = shared.join(first, "rank").where(F.struct(F.col("doc_id").isNull().alias("last"), *_PLACE) > F.col("first"))
        covered = later.select(
            F.col("doc_id").alias("d"),
            F.col("print").alias("p"),
            F.explode(F.sequence(F.col("nth"), F.col("nth") + least - 1)).alias("k"),
        ).distinct()
        gone = covered.join(lines, _same_place("d", "p", F.col("k"))).select("doc_id", "print", none.alias("run"), F.col("line").alias("gone"))
        found = found.unionByName(gone)
    return found.groupBy("doc_id", "print").agg(
        F.collect_set("gone").alias("gone"),
        F.count("run").alias("n_runs"),
        F.max("run").alias("longest_run"),
    )


def dedup_lines(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without the later copies of repeated runs of `least` lines or more, with n_lines (before), n_deleted,
    and the number and greatest length of the maximal repeated runs that they had (first copies included)."""
    with Tables(documents.sparkSession) as made:
        found = made.keep(findings(documents, least), "runs")
    found = found.select(
        F.col("doc_id").alias("__id"),
        F.col("print").alias("__print"),
        F.col("gone").alias("__gone"),
        F.col("n_runs").alias("__runs"),
        F.col("longest_run").alias("__longest"),
    )
    # always a shuffle: the plan is the same at every size, and skew is split at run time
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__print"))
    out = documents.join(found.hint("merge"), same, "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    left = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(stays, lambda i: F.get(x, i)), "\n")), 1)
    cut = F.col("__gone").isNotNull() & (F.size("__gone") > 0)
    out = out.withColumns(
        {
            "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
            "n_deleted": F.when(cut, F.size("__gone")).otherwise(0).cast("long"),
            "n_runs": F.coalesce("__runs", F.lit(0)).cast("long"),
            "longest_run": F.coalesce("__longest", F.lit(0)).cast("long"),
            "__text": F.when(cut, left).otherwise(F.col("text")),
        }
    )
    return out.withColumn("text", F.col("__text")).drop("__id", "__print", "__gone", "__runs", "__longest", "__text")
