"""A training corpus from documents: five operators in a row, each working on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm import decontaminate, linededup, mixing, neardup, quality
from faultline.llm.common import Tables, drop_tables, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or blank text is rejected. Repeated rows are judged alike. A null doc_id is judged as others are. Columns other
    than those of documents go. Without labels only the base rules reject.
    """
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    # an exploded flag and not a filter: a filter would be pushed below and work out all counts a second time
    return judged.select(*COLUMNS, F.explode(F.filter(F.array("kept"), lambda x: x)).alias("__kept")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and so do documents that have no word but in such copies.

    A null or blank text has no run and stays as it is. Repeated rows (of doc_id and text) are cut alike. Rows with a null
    doc_id come last, so theirs are the later copies.
    """
    cut = linededup.dedup_lines(docs)
    return cut.where((cut["n_deleted"] == 0) | cut["text"].rlike(r"[^\x20\x09-\x0D]")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: word shingles of five, similarity 0.8.

    A null or blank text is like no other and stays, as does every row with a null doc_id. Of rows that share a doc_id, one
    stays: that whose text has the least hash (null first), of equal texts any.
    """
    judged = neardup.near_duplicates(docs, n=5).where("doc_id is not null")
    odd = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")).where("n > 1 or not kept")
    odd = materialize(odd, "copies-and-repeated-ids")
    # texts are shuffled only if very many ids are copies or repeated, and then once
    single = docs.join(neardup.few(odd.select("doc_id")), "doc_id", "left_anti").select(COLUMNS)
    twice = docs.join(neardup.few(odd.where("kept").select("doc_id")), "doc_id", "left_semi").select(COLUMNS)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.when(F.col("text").isNotNull(), F.xxhash64("text")).asc_nulls_first()))
    return single.unionByName(twice.withColumn("__nth", first).where("__nth = 1").select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a benchmark passage go.

    A null or blank text has none. Rows that share a doc_id go together, rows with a null doc_id each for itself. Items
    without words are ignored; without items nothing goes.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, by its source's target: doc_id, source, size, source_size, target and taken.

    A null text has size 0. A null source is a source, the last in order. Repeated rows are each a document.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", source_mix),
]

#: None: the multinomials of the quality rules and the latent space of the decontamination aren't SQL. The tests hold
#: run() against a plain version of the five stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. A stage's table is deleted when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Tables(spark) as made:
            docs = made.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop_tables(spark, last)
        last = docs
    return docs
