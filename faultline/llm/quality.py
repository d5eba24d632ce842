"""Quality rules; DataFrame functions only. Hashed words and word pairs have a log-likelihood ratio between multinomials
of trusted documents and of the raw corpus; a document's mean ratio is held against those that trusted documents have when
their own words are left out of the target, so the threshold fits the corpus and the labels at every size.

Base rules come first: too few words, or too many in word windows that repeat within the text.

Defined results: a null or blank text has no words and fails the base rules. Labels of ids that no document has are
ignored, as are null labels; without any trusted document every ratio is 0, and with fewer than two that pass the base
rules none is rejected by its ratio. Repeated rows are judged alike and count
each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize, words
from .neardup import few

#: Hash buckets of the multinomials, a power of two.
BUCKETS = 1 << 16
#: The target is smoothed by so many words for each of its own that are distributed like the raw corpus: at every size, ratios are log(PRIOR / (1 + PRIOR)) at least.
PRIOR = 0.1
#: A document is kept if its mean log-ratio is not below that which this share of trusted documents stays below when left out
#: of the target. Each trusted document is left out in turn.
LOST = 0.01
FEWEST, MOST_REPEATED, GRAM = 10, 20, 5
_SYMBOLS = "#*$%&|<>"
_BIG = "cast(array() as array<bigint>)"


def hashed(found: Column) -> Column:
    """The hash of each of a text's words."""
    return F.transform(found, lambda x: F.xxhash64(x))


def paired(h: Column) -> Column:
    """The hash of each pair of neighbouring words, from the words' hashes."""
    # the last word has no next one, and what it gets is cut off
    return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1))), 1, F.greatest(F.size(h) - 1, F.lit(0)))


def both(text: Column, body) -> Column:
    """body(w, h, p) of a text's words, their hashes and those of its pairs, each worked out once."""
    return let(words(text), lambda w: let(hashed(w), lambda h: let(paired(h), lambda p: body(w, h, p))))


def bucket(x: Column) -> Column:
    """The bucket of a hash."""
    return x.bitwiseAND(F.lit(BUCKETS - 1))


def repeated(h: Column, p: Column) -> Column:
    """Words in GRAM-word windows that are found twice or more in the text, from the hashes of words and pairs."""

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            at,
            start,
            lambda acc,
            i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(GRAM), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def twins(s: Column) -> Column:
        flagged = F.transform(
            s,
            lambda x,
            i: F.when(
                F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)),
                x["p"],
            ).otherwise(-1),
        )
        return F.sort_array(F.filter(flagged, lambda p: p >= 0))

    def inside(g: Column) -> Column:
        found = let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), twins)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(found))

    # two pairs and the last word are a window; what begins too late for one is cut off
    grams = F.slice(F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(h, i + 4))), 1, F.greatest(F.size(h) - GRAM + 1, F.lit(0)))
    return F.when(F.size(h) > GRAM, let(grams, inside)).otherwise(0).cast("long")


def trusted(labels: DataFrame) -> DataFrame:
    """t: ids of all trusted documents."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("t")).distinct()


def counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, raw and target, how often all documents and the trusted ones have it, and the sums all_raw and all_target. Each task adds up its own."""
    flagged = documents.select(
        F.col("doc_id").cast("long").alias("d"),
        F.col("text").cast("string").alias("text"),
    ).join(few(trusted(labels)), F.col("d") == F.col("t"), "left")
    # a column of its own, as an explode of lambdas isn't compiled; outer, as else a filter is inferred that works it out a second time
    each = flagged.select(F.col("t").isNotNull().alias("trusted"), both(F.col("text"), lambda w, h, p: F.concat(h, p)).alias("x"))
    each = each.select("trusted", F.explode_outer("x").alias("x")).select("trusted", bucket(F.col("x")).cast("int").alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    every = documents.sparkSession.range(0, BUCKETS, 1, 4).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").na.fill(0)
    every = materialize(every, "buckets")
    sums = every.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    return every.crossJoin(F.broadcast(sums))


def ratios(every: DataFrame) -> DataFrame:
    """One row: `table`, the log-ratio of each bucket, smoothed towards 0."""
    share = F.col("raw") / F.col("all_raw")
    ratio = F.when(
        (F.col("raw") > 0) & (F.col("all_target") > 0),
        F.log((F.col("target") + PRIOR * F.col("all_target") * share) / ((1 + PRIOR) * F.col("all_target")) / share),
    ).otherwise(0.0)
    return every.select("bucket", ratio.alias("ratio")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("bucket", "ratio"))),
        lambda x: x["ratio"],
    ).alias("table"))


def threshold(documents: DataFrame, labels: DataFrame, every: DataFrame) -> DataFrame:
    """One row: `least`, the mean log-ratio that a share LOST of trusted documents stays below when the target is without
    their own words; null for fewer than two. Rows that share a doc_id and a text are one document here, whose words are left
    out as often as it has rows. Each document is scored from its own row: no text or word is shuffled."""
    text = F.col("text").cast("string")
    own = documents.select(F.col("doc_id").cast("long").alias("d"), text.alias("text"), F.xxhash64(text).alias("print")).join(
        few(trusted(labels)),
        F.col("d") == F.col("t"),
        "left_semi",
    )
    again = materialize(own.groupBy("d", "print").agg(F.count("*").alias("rows")).where("rows > 1"), "again")
    # of each bucket how often trusted documents have it, one over its share of all, and the term of a document that has it once
    prior = PRIOR * F.col("all_target")
    each = every.select("bucket", "all_target", F.col("target").cast("double").alias("target"), F.when(F.col("raw") > 0, F.col("all_raw") / F.col("raw")).otherwise(0.0).alias("spread"))
    each = each.withColumn("once", F.log(F.greatest(F.col("target") - 1, F.lit(0.0)) * F.col("spread") + prior))
    whole = each.groupBy("all_target").agg(F.array_sort(F.collect_list(F.struct("bucket", "target", "spread", "once"))).alias("x"))
    whole = whole.select((F.col("all_target") + prior).alias("all"), prior.alias("prior"), *(F.col(f"x.{c}").alias(c) for c in ("target", "spread", "once")))
    whole = materialize(whole, "left-out")
    own = own.join(few(again), ["d", "print"], "left").select("d", "print", "text", F.coalesce("rows", F.lit(1)).alias("rows"))

    def of_run(x: Column, n: Column) -> Column:
        left = F.get(F.col("__target"), x) - n * F.col("rows")
        several = n * F.log(left * F.get(F.col("__spread"), x) + F.col("__prior"))
        return F.when((n == 1) & (F.col("rows") == 1), F.get(F.col("__once"), x)).otherwise(several)

    # not a filter: it would be pushed below the join and work out all documents' words
    own = own.withColumn("b", both(
        F.col("text"),
        lambda w, h, p: F.when(~failed(F.size(h), repeated(h, p)), F.transform(F.concat(h, p), bucket)),
    )).drop("text")
    # outside of lambdas sorting is compiled, and of numbers; of each run of a bucket, how far it goes
    own = own.withColumn("b", F.sort_array("b"))
    at = F.sequence(F.lit(1), F.size("b"))
    ends = F.when(F.size("b") > 0, F.filter(at, lambda i: F.coalesce(F.get("b", i) != F.get("b", i - 1), F.lit(True))))
    # each is used once below, so these columns never are: a row would get a copy of the whole tables
    own = own.withColumns({"ends": ends, **{f"__{c}": whole.select(c).scalar() for c in whole.columns}})
    begins = lambda e: F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1))
    runs = let(F.col("ends"), lambda e: F.zip_with(e, begins(e), lambda x, y: of_run(F.get("b", x - 1), x - y)))
    mean = F.aggregate(runs, F.lit(0.0), lambda acc, x: acc + x) / F.size("b") - F.log(F.col("__all") - F.size("b") * F.col("rows"))
    scores = own.select("d", "print", "rows", mean.alias("score"))
    # one of equal rows counts; those that have none like them need no comparison
    scores = scores.where("rows = 1").select("score").unionByName(scores.where("rows > 1").dropDuplicates(["d", "print"]).select("score"))
    return scores.agg(F.when(F.count("score") > 1, F.percentile("score", F.lit(LOST))).alias("least"))


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Whether the base rules reject a text."""
    return (n_words < FEWEST) | (n_repeat_words * 100 > n_words * MOST_REPEATED)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' columns, and of each: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score (mean log-ratio) and kept. Columns of documents with these names are replaced."""
    every = counts(documents, labels)
    table = materialize(ratios(every), "ratios")
    least = materialize(threshold(documents, labels, every), "threshold")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def found(w: Column, h: Column, p: Column) -> Column:
        # the table is used once, so it never is a column, which would be copied for each row
        total = F.aggregate(F.concat(h, p), F.lit(0.0), lambda acc, x: acc + F.get(F.col("__table"), bucket(x)))
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated(h, p).alias("n_repeat_words"),
            (total / F.greatest(F.lit(1), F.size(h) * 2 - 1)).alias("score"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    own = documents.withColumns({"__table": table.scalar(), "__least": least.scalar()})
    own = own.withColumns({
        "__x": both(text, found),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{_SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    own = own.withColumns({
        "n_words": F.col("__x.n_words"),
        "word_chars": F.col("__x.word_chars"),
        "n_repeat_words": F.col("__x.n_repeat_words"),
        "score": F.col("__x.score"),
    }).drop("__table", "__x")
    own = own.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    return own.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("__least"), F.lit(True))).drop("__least")
