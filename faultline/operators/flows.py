"""Error windows, execution flows and the layout of timelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import small
from .graph import cut
from .ordering import RANGE, numbered, places, ranged, running

#: Arrows look ahead within blocks of so many events, and some more from the block after.
BLOCK = 10_000
#: Connections: places in order of a stretch, keys that a flow's calls of a method are dealt over at most, and tasks a core.
STRETCH, SHARES, TASKS = 8192, 16, 8
#: Calls that the blocks within stretches hold at once, about.
PIECE = 1 << 20


def error_window(calls: DataFrame, window: float = 10.0, clamp: bool = True) -> DataFrame:
    """Calls within `window` seconds of the first error, with start_ts and end_ts; all calls if there is no error."""
    first = calls.agg(F.min(F.when(F.col("is_error"), F.col("timestamp"))).alias("e"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    start = F.col("e") - window
    start = F.greatest(start, F.col("lo")) if clamp else start
    bounds = first.select(F.coalesce(start, "lo").alias("start_ts"), F.coalesce(F.col("e") + window, "hi").alias("end_ts"))
    return calls.crossJoin(F.broadcast(bounds)).where("timestamp between start_ts and end_ts")


def window_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.count("*").alias("total_calls"),
        F.count_if("is_error").alias("error_count"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.min(F.when(F.col("is_error"), F.struct("timestamp", "row_id")))["row_id"].alias("first_error_row"),
    )


def time_sessions(rows: DataFrame, gap: float = 2.0) -> DataFrame:
    """rows with `session`, numbered from 0 in time order: a new one begins after more than `gap` seconds.

    Rows are stored by ranges of time of about equal numbers of rows; gaps are found within ranges, and between them from
    one row for each.
    """
    held = ranged(rows, "timestamp", "row_id")
    ends = held.groupBy(RANGE).agg(F.max("timestamp").alias("hi"))
    ends = ends.select(RANGE, F.lag("hi").over(W.orderBy(RANGE)).alias("__before"))
    previous = F.coalesce(F.lag("timestamp").over(W.partitionBy(RANGE).orderBy("timestamp", "row_id")), "__before")
    held = held.join(F.broadcast(ends), RANGE).withColumn("__previous", previous)
    new = F.when(F.col("__previous").isNull() | (F.col("timestamp") - F.col("__previous") > gap), 1).otherwise(0)
    return running(held, new, "session", "timestamp", "row_id").withColumn("session", F.col("session") - 1).drop("__before", "__previous", RANGE)


def flows(calls: DataFrame, edges: DataFrame, gap: float = 2.0) -> DataFrame:
    """calls with `flow`, from 0. Time alone never splits what is within `gap`; structure only joins a session to the flow
    before it, if its first call has an edge, either way, with a call of that flow. So sessions are folded, not calls, and
    a session whose first call has no edge begins a flow whatever came before it: the sessions from one such to the next
    are a piece. Pieces are folded in parallel, each streams through a task that holds one flow's members.
    """
    parts = cut(time_sessions(calls, gap))
    sessions = parts.groupBy("session").agg(
        F.min_by("qualified_name", F.struct("timestamp", "row_id")).alias("first"),
        F.collect_set("qualified_name").alias("members"),
    )
    pairs = edges.where("kind = 'CALL'").select("caller", "callee")
    near = pairs.unionByName(pairs.select(
        F.col("callee").alias("caller"),
        F.col("caller").alias("callee"),
    )).distinct().groupBy(F.col("caller").alias("first")).agg(F.collect_set("callee").alias("linked"))
    held = ranged(sessions.join(small(near), "first", "left").select("session", "members", "linked"), "session")
    pieces = running(held, F.when(F.col("linked").isNull(), 1).otherwise(0), "piece", "session")
    pieces = pieces.select("piece", "session", "members", "linked").repartition("piece").sortWithinPartitions("piece", "session")

    def fold(batches: Iterator) -> Iterator:
        import pandas as pd

        now, members = None, set()
        for frame in batches:
            out = []
            for piece, session, own, linked in zip(frame["piece"], frame["session"], frame["members"], frame["linked"], strict=True):
                begins = piece != now or linked is None or members.isdisjoint(linked)
                if begins:
                    now, members = piece, set()
                members.update(own)
                out.append((session, int(begins)))
            yield pd.DataFrame(out, columns=["session", "begins"])

    held = ranged(pieces.mapInPandas(fold, "session long, begins int"), "session")
    folded = running(held, F.col("begins"), "flow", "session").select("session", (F.col("flow") - 1).alias("flow"))
    return parts.join(folded, "session").drop("session")


def flow_table(calls: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row for each flow of calls (`flow`): services, time range, errors; with edges also its root and leaf calls."""
    out = calls.groupBy("flow").agg(
        F.count("*").alias("n_calls"),
        F.array_sort(F.collect_set("service")).alias("services_involved"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        (F.max("timestamp") - F.min("timestamp")).alias("duration"),
        F.bool_or("is_error").alias("has_error"),
        F.count_if("is_error").alias("error_count"),
    )
    if edges is not None:
        pairs = small(edges.where("kind = 'CALL'").select("caller", "callee").distinct())
        members = calls.select("flow", "qualified_name").distinct()
        inner = members.withColumnRenamed("qualified_name", "caller").join(pairs, "caller").join(
            members.withColumnRenamed("qualified_name", "callee"),
            ["flow", "callee"],
        )
        for name, key in (("root_methods", "callee"), ("leaf_methods", "caller")):
            bare = calls.join(inner.select("flow", F.col(key).alias("qualified_name")).distinct(), ["flow", "qualified_name"], "left_anti")
            ends = bare.groupBy("flow").agg(F.transform(
                F.array_sort(F.collect_list(F.struct("timestamp", "row_id", "qualified_name"))),
                lambda x: x["qualified_name"],
            ).alias(name))
            out = out.join(ends, "flow", "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<string>)")))
    return out.withColumn("flow_id", F.format_string("flow_%04d", "flow")).drop("flow")


def _later(stretch: int) -> Callable[[Iterator], Iterator]:
    """Blocks of one call of `own` and all calls of `other` after it, by places (n) of one stretch; both are in order."""

    def blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("own"), batch.column("other")
            x, y, rows = a.flatten(), b.flatten(), np.arange(batch.num_rows)
            of, lengths = np.repeat(rows, a.value_lengths().to_numpy()), b.value_lengths().to_numpy()
            own, other = (s.field("n").to_numpy() % stretch + r * stretch for s, r in ((x, of), (y, np.repeat(rows, lengths))))
            start = np.searchsorted(other, own, "right")
            count = np.cumsum(lengths, dtype=np.int64)[of] - start
            some = np.flatnonzero(count)
            for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(count[some]) // PIECE)) + 1):
                ends = np.concatenate(([0], np.cumsum(count[part])))
                index = np.arange(ends[-1]) + np.repeat(start[part] - ends[:-1], count[part])
                lists = [(np.arange(len(part) + 1), x.field("row_id").take(pa.array(part))), (ends, y.field("row_id").take(pa.array(index)))]
                first, second = (pa.ListArray.from_arrays(pa.array(o, pa.int32()), values) for o, values in lists)
                flow, cross = (batch.column(c).take(pa.array(of[part])) for c in ("flow", "cross_service"))
                yield pa.RecordBatch.from_arrays([flow, first, second, cross], names=["flow", "from", "to", "cross_service"])

    return blocks


def flow_connections(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of calls of a flow that an edge connects, either way: calls meet through the edges, never all with all.

    Calls have their places in order, and each method's are stored by stretches of STRETCH places. A stretch meets later ones
    whole, so no pair is made only to be dropped; only within one are places compared. A flow of many stretches is dealt by
    them over up to SHARES keys for each method, however few methods it has.

    What meets stays in blocks: all of a block's calls `from` come before all of its calls `to`. Blocks become pairs last, in two
    loops that are compiled with what reads the pairs.
    """
    pairs = edges.where("kind = 'CALL'").select("caller", "callee")
    either = small(pairs.unionByName(pairs.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))).distinct())
    slim = places(calls.select("flow", "row_id", "timestamp", "qualified_name"), "n", "timestamp", "row_id")
    held = cut(slim.groupBy("flow", "qualified_name", F.floor(F.col("n") / STRETCH).alias("stretch")).agg(
        F.array_sort(F.collect_list(F.struct("n", "row_id"))).alias("own"),
    ))
    cross = (X.service_of(F.col("qualified_name")) != X.service_of(F.col("callee"))).alias("cross_service")
    left = held.join(either.withColumnRenamed("caller", "qualified_name"), "qualified_name").select("flow", "callee", "stretch", "own", cross)
    right = held.select("flow", F.col("qualified_name").alias("callee"), "stretch", F.col("own").alias("other"))
    # the number of partitions is given, as the few bytes that go in would be put into one task, whatever comes out
    context = calls.sparkSession.sparkContext
    parts = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS * context.defaultParallelism)

    def meet(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        return a.repartition(parts, *keys).join(b.repartition(parts, *keys).hint("shuffle_merge"), list(keys))

    shares = held.groupBy("flow").agg(F.least(F.lit(SHARES), F.max("stretch") - F.min("stretch") + 1).alias("shares"))
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    apart = meet(
        left.join(shares, "flow").select("flow", "callee", F.col("stretch").alias("i"), F.col("own.row_id").alias("from"), "cross_service", share),
        right.join(shares, "flow").select("flow", "callee", F.col("stretch").alias("j"), F.col("other.row_id").alias("to"), (F.col("stretch") % F.col("shares")).alias("share")),
        "flow",
        "callee",
        "share",
    ).where("i < j")
    apart = apart.select("flow", "from", "to", "cross_service")
    inside = meet(left, right, "flow", "callee", "stretch").select("flow", "cross_service", "own", "other")
    blocks = apart.unionByName(inside.mapInArrow(_later(STRETCH), apart.schema))
    blocks = blocks.select("flow", F.explode("from").alias("from_row"), "to", "cross_service")
    return blocks.select("flow", "from_row", F.explode("to").alias("to_row"), "cross_service")


def arrows(events: DataFrame, edges: DataFrame, reach: float = 2.0, ahead: int = 19, order: list[str] | None = None) -> DataFrame:
    """(from_row, to_row): event i calls event j, one of the next `ahead` events in order, within `reach` seconds.

    Events are numbered, and dealt into blocks by number; a block also gets the first events of the next one to look at.
    """
    if ahead > BLOCK:
        raise ValueError(f"at most {BLOCK} events ahead")
    slim = numbered(
        events.select("row_id", "timestamp", "qualified_name", *(c for c in order or [] if c not in ("row_id", "timestamp"))),
        "n",
        *(order or ["row_id"]),
    )
    block = F.floor(F.col("n") / BLOCK)
    dealt = slim.withColumn("own", block).withColumn(
        "block",
        F.explode(F.when((F.col("n") % BLOCK < ahead) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))),
    )
    frame = W.partitionBy("block").orderBy("n").rowsBetween(1, ahead)
    near = dealt.withColumn("next", F.collect_list(F.struct("row_id", "timestamp", "qualified_name")).over(frame)).where("own = block")
    near = near.select(
        F.col("row_id").alias("from_row"),
        F.col("timestamp").alias("t"),
        F.col("qualified_name").alias("caller"),
        F.explode("next").alias("n"),
    ).where(F.abs(F.col("n.timestamp") - F.col("t")) <= reach)
    pairs = small(edges.where("kind = 'CALL'").select("caller", "callee").distinct())
    out = near.select(
        "from_row",
        F.col("n.row_id").alias("to_row"),
        "caller",
        F.col("n.qualified_name").alias("callee"),
    ).join(pairs, ["caller", "callee"], "left_semi")
    return out.withColumn("cross_service", X.service_of(F.col("caller")) != X.service_of(F.col("callee")))


def method_labels(events: DataFrame) -> DataFrame:
    """Each method's label (service label and number by first appearance), calls, and what its first call was. The window is
    over methods. The times of all its calls are rows of their own: call_times()."""
    first = F.min_by(F.struct("timestamp", "is_error", "message", "score"), "row_id").alias("x")
    own = events.groupBy("service", "method", "qualified_name").agg(F.min("row_id").alias("first_row"), first, F.count("*").alias("total_calls"))
    number = F.row_number().over(W.partitionBy("service").orderBy("first_row"))
    own = own.withColumn("label", F.concat(X.service_label(F.col("service")), F.lit("-"), number.cast("string")))
    shown = ["service", "method", "qualified_name", "first_row", "label", "total_calls"]
    return own.select(
        *shown,
        F.col("x.timestamp").alias("first_timestamp"),
        X.clock_text(F.col("x.timestamp")).alias("first_time_str"),
        "x.is_error",
        "x.message",
        "x.score",
    )


def call_times(events: DataFrame) -> DataFrame:
    """qualified_name, row_id and the time of day of each call."""
    return events.select("qualified_name", "row_id", X.clock_text(F.col("timestamp")).alias("time_str"))


def lanes(events: DataFrame, alphabetical: bool = False) -> DataFrame:
    """Each service's lane and height, first lane on top: by first event, or by name. The windows are over services."""
    own = events.groupBy("service").agg(F.min(F.struct("timestamp", "row_id")).alias("first"))
    lane = F.row_number().over(W.orderBy("service" if alphabetical else "first")) - 1
    return own.withColumn("lane", lane).withColumn("y", (F.count("*").over(W.partitionBy()) - 1 - F.col("lane")) * 2.5).select("service", "lane", "y")


def stacking(events: DataFrame, width: float = 0.15) -> DataFrame:
    """Events with their time bucket (towards zero), place in it and how many share it."""
    start = events.agg(F.min("timestamp").alias("__start"))
    rows = events.crossJoin(F.broadcast(start)).withColumn("rel", F.col("timestamp") - F.col("__start")).withColumn("bucket", (F.col("rel") / width).cast("int"))
    by = W.partitionBy("service", "bucket")
    return rows.withColumn("nth", F.row_number().over(by.orderBy("row_id")) - 1).withColumn("in_bucket", F.count("*").over(by)).drop("__start")


def ticks(events: DataFrame, most: int = 30) -> DataFrame:
    """Evenly spaced axis ticks over the events' time range."""
    span = events.agg((F.max("timestamp") - F.min("timestamp")).alias("range"))
    n = F.least(F.lit(most), F.floor("range").cast("int") + 1)
    return span.select(F.explode(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(n > 1, F.col("range") * i / (n - 1)).otherwise(0.0),
    )).alias("tick"))
