"""Readers of logs and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a CSV reader takes for nulls.
NULLS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

ERROR = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("timestamp_str", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("has_traceback", T.BooleanType()),
    T.StructField("traceback_lines", T.ArrayType(T.StringType())),
    T.StructField("exception_type", T.StringType()),
    T.StructField("error_location", T.StringType()),
])


def _known(column: Column) -> Column:
    return F.when(~column.isin(NULLS), column)


def clean(raw: DataFrame, strip_service: bool = True) -> DataFrame:
    """row_id, timestamp, service, message: rows without a numeric timestamp go, a missing service is `unknown`, a
    missing message is empty. Header names are trimmed; other columns are ignored. row_id follows the order of the file.
    """
    named = raw.toDF(*(c.strip() for c in raw.columns))
    service = F.coalesce(_known(F.col("container_name")), F.lit("unknown"))
    service = F.regexp_replace(service, r"(?U)^\s+|\s+$", "") if strip_service else service
    number = F.when(F.col("timestamp").rlike(_NUMBER), F.expr("try_cast(trim(timestamp) as double)"))
    rows = named.select(
        F.monotonically_increasing_id().alias("row_id"),
        number.alias("timestamp"),
        service.alias("service"),
        F.coalesce(_known(F.col("message")), F.lit("")).alias("message"),
    )
    return rows.where("timestamp is not null")


def read_csv(spark: SparkSession, path: str, strip_service: bool = True, plain: bool = False) -> DataFrame:
    """Logs of a CSV file with quoted line breaks and doubled quotes: each file is one task, as such a break may be anywhere.
    plain: no value has a line break, so large files are split. Convert large logs once, with to_parquet()."""
    raw = spark.read.option("header", True).option("multiLine", not plain).option("escape", '"').option("inferSchema", False).csv(path)
    return clean(raw, strip_service)


def to_parquet(spark: SparkSession, path: str, out: str, plain: bool = False) -> DataFrame:
    """The logs of a CSV file, written to `out` as Parquet once, and read from there."""
    read_csv(spark, path, plain=plain).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def scan_metrics(logs: DataFrame) -> DataFrame:
    """One row on logs as read: rows, services, rows without a message, and the time range."""
    return logs.agg(
        F.count("*").alias("rows"),
        F.count_distinct("service").alias("services"),
        F.count_if(F.col("message") == "").alias("empty_messages"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


def read_errors_json(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a document's `errors` list."""
    whole = spark.read.schema(T.StructType([T.StructField("errors", T.ArrayType(ERROR))])).option("multiLine", True).json(path)
    return whole.select(F.posexplode(F.coalesce("errors", F.array().cast(T.ArrayType(ERROR)))).alias("row_id", "x")).select(
        F.col("row_id").cast("long").alias("row_id"),
        "x.*",
    )


def read_errors_csv(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.mining import detect

    return detect(read_csv(spark, path))


def services_with_graph(spark: SparkSession, services_dir: str, logs: DataFrame) -> DataFrame:
    """service, path of each service of the logs that has an export.dot."""
    files = spark.read.format("binaryFile").load(f"{services_dir}/*/export.dot").select("path")
    named = files.select(F.regexp_extract("path", r"([^/]+)/export\.dot$", 1).alias("service"), "path")
    return named.join(logs.select("service").distinct(), "service", "left_semi").orderBy("service")
