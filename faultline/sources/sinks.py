"""Writers: documents and tables that other tools read, and the Parquet cache with its manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import mining
from ..operators.ordering import numbered


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_document(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON document with a list of rows for each part, in the order of the column __nth where a part has it.

    Rows are lines of one file: one task sorts them, on disk where they are many, and never holds a part in memory.
    """
    lines = None
    for k, (name, frame) in enumerate(parts.items()):
        nth = F.col("__nth").cast("long") if "__nth" in frame.columns else F.monotonically_increasing_id()
        shown = [c for c in frame.columns if c != "__nth"]
        rows = frame.select(
            F.lit(2 * k + 1).alias("part"),
            nth.alias("nth"),
            F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("value"),
        )
        head = frame.sparkSession.createDataFrame(
            [(2 * k, -1, ("{" if k == 0 else "],") + json.dumps(name) + ":["), (2 * k + 2, -2, "]}" if k == len(parts) - 1 else None)],
            "part int, nth long, value string",
        )
        rows = rows.unionByName(head.where("value is not null"))
        lines = rows if lines is None else lines.unionByName(rows)
    # a comma before each row but the first of its part; one file is one task, which sorts and reads rows in order
    before = F.lag("part").over(W.orderBy("part", "nth"))
    text = F.when((F.col("part") % 2 == 1) & (before == F.col("part")), F.concat(F.lit(","), "value")).otherwise(F.col("value"))
    lines.select("part", "nth", text.alias("value")).orderBy("part", "nth").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_errors_csv(errors: DataFrame, path: str, cut: int = 200) -> None:
    out = errors.select(
        "timestamp",
        "timestamp_str",
        "service",
        "error_type",
        "severity",
        F.substring("message", 1, cut).alias("message"),
        "has_traceback",
        F.coalesce("exception_type", F.lit("")).alias("exception_type"),
        F.coalesce("error_location", F.lit("")).alias("error_location"),
    )
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_patterns_csv(patterns: DataFrame, path: str, cut: int = 200) -> None:
    out = patterns.select(
        "signature",
        "error_type",
        "count",
        F.array_join("services_affected", ",").alias("services_affected"),
        "first_seen",
        "last_seen",
        F.substring("message_template", 1, cut).alias("message_template"),
        F.array_join("exception_types", ",").alias("exception_types"),
    )
    out.orderBy(F.desc("count"), "signature").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report(errors: DataFrame, most: int = 10) -> str:
    """A text report: summary and ranked tables."""
    s = mining.summary(errors).first()
    lines = [
        f"Errors: {s.total_errors}, with stack trace: {s.errors_with_traceback}",
        f"From {s.start} to {s.end} ({s.duration_seconds:.1f} s)",
        f"Exceptions: {', '.join(s.unique_exceptions) or 'none'}",
    ]
    for key in ("error_type", "service"):
        lines += [
            "",
            f"By {key}:",
            *(f"  {r[key]:<24} {r['count']:>10} {r['percent']:6.1f} %" for r in mining.counts(errors, key).limit(most).collect()),
        ]
    return "\n".join(lines)


def write_report(errors: DataFrame, path: str) -> None:
    """The report with each error's details after it, in order, as text files: the first one begins with the summary."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    shown = F.concat_ws(
        "\n",
        F.concat(F.lit("Error #"), (F.col("n") + 1).cast("string")),
        line("Time", F.col("timestamp_str")),
        line("Service", F.col("service")),
        F.concat(line("Type", F.col("error_type")), F.lit(" (severity: "), F.col("severity").cast("string"), F.lit("/10)")),
        line("Exception", F.col("exception_type")),
        line("Location", F.col("error_location")),
        line("Message", F.col("message")),
        F.when(
            F.size("traceback_lines") > 0,
            F.concat(F.lit("Traceback ("), F.size("traceback_lines").cast("string"), F.lit(" lines):\n  "), F.array_join("traceback_lines", "\n  ")),
        ),
        F.lit("=" * 80),
    )
    details = numbered(errors, "n", "row_id").select("n", shown.alias("value"))
    head = errors.sparkSession.createDataFrame([(-1, report(errors) + "\n\n" + "=" * 80)], "n long, value string")
    head.unionByName(details).repartitionByRange("n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def pattern_report(found: DataFrame, most: int = 10) -> str:
    """A text summary of patterns: how many, and the most frequent."""
    total = found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    rows = found.orderBy(F.desc("count"), "first_seen").limit(most).collect()
    lines = [f"Errors: {total.n}, patterns: {total.k}"]
    return "\n".join([*lines, *(f"  {r['count']:>8}  {r.error_type:<18} {', '.join(r.services_affected)}: {r.message_template[:100]}" for r in rows)])


def table_report(title: str, frame: DataFrame, most: int = 10) -> str:
    """The first rows of a table as text."""
    rows = frame.limit(most).collect()
    return "\n".join([title, *("  " + ", ".join(f"{c} {r[c]}" for c in frame.columns) for r in rows)])


def cache_key(source: str, modified: float, services_dir: str) -> str:
    return hashlib.md5(f"{source}:{modified}:{services_dir}".encode()).hexdigest()


def save_cache(tables: dict[str, DataFrame], path: str, key: str) -> None:
    """Tables as Parquet beside a manifest that is written last, so that a broken save isn't valid."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(
        [(json.dumps({"key": key, "tables": sorted(tables)}),)],
        "value string",
    ).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_cache(spark: SparkSession, path: str, key: str) -> dict[str, DataFrame] | None:
    """The tables of a cache with this key; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except AnalysisException:
        return None
    return {t: spark.read.parquet(f"{path}/{t}") for t in manifest["tables"]} if manifest["key"] == key else None
