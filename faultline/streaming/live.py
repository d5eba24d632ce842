"""The column functions over a stream of logs: an extension, since batch tools have nothing to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import normalize as N
from ..functions import text as X


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet log files with row_id, timestamp, service and message; ts is the event time."""
    rows = spark.readStream.schema("row_id long, timestamp double, service string, message string").parquet(path)
    return rows.withColumn("ts", X.moment(F.col("timestamp")))


def classified(logs: DataFrame, late: str = "30 seconds") -> DataFrame:
    m = F.col("message")
    rows = logs.withWatermark("ts", late).withColumn("error_type", E.category(m)).where("error_type is not null")
    return rows.withColumns({
        "severity": E.severity(F.col("error_type")),
        "signature": N.signature(N.normalized(m, "mine"), F.col("error_type"), F.col("service"), "mine", E.exception_type(m)),
    })


def activity(logs: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Logs by service and second."""
    return logs.withWatermark("ts", late).groupBy(F.window("ts", "1 second"), "service").agg(F.count("*").alias("count")).select(
        F.col("window.start").alias("second"),
        "service",
        "count",
    )


def pattern_counts(logs: DataFrame) -> DataFrame:
    """Errors by signature and minute."""
    return classified(logs).groupBy(F.window("ts", "1 minute"), "signature", "error_type").agg(F.count("*").alias("count")).select(
        F.col("window.start").alias("minute"),
        "signature",
        "error_type",
        "count",
    )


def sessions(logs: DataFrame, gap: str = "2 seconds", late: str = "30 seconds") -> DataFrame:
    """Flows by time alone, for each service."""
    return logs.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "service").agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("start"),
        F.col("session_window.end").alias("end"),
        "service",
        "n",
    )


def structural_flows(calls: DataFrame, links: list[tuple[str, str]], gap: float = 2.0, key: str = "service") -> DataFrame:
    """row_id, key, flow of a stream of calls (row_id, timestamp, qualified_name and the key): within a key, a call begins a
    flow if more than `gap` seconds are behind it and no link, either way, joins it with a call of the flow before.

    links: pairs of qualified names, a call graph's. A key's state is its last time and the members of one flow; calls that
    come in a later batch than calls after them are taken as they come.
    """
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def fold(keys, frames, state):
        import pandas as pd

        flow, last, members = state.get if state.exists else (-1, None, [])
        held = set(members)
        for frame in frames:
            out = []
            for row in frame.sort_values(["timestamp", "row_id"]).itertuples():
                apart = last is None or row.timestamp - last > gap
                if apart and held.isdisjoint(near.get(row.qualified_name, ())):
                    flow, held = flow + 1, set()
                held.add(row.qualified_name)
                last = row.timestamp
                out.append((row.row_id, keys[0], flow))
            yield pd.DataFrame(out, columns=["row_id", key, "flow"])
        state.update((flow, last, sorted(held)))

    shown = calls.select(key, "row_id", "timestamp", "qualified_name")
    return shown.groupBy(key).applyInPandasWithState(
        fold,
        f"row_id long, {key} string, flow long",
        "flow long, last double, members array<string>",
        "append",
        "NoTimeout",
    )
