"""URL filters; DataFrame functions only. A blocked Bloom filter of rule keys and listed canonical URLs passes possible
hits on to an exact hash join, which removes false positives. Every step works on distinct URLs.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is allowed. Repeated
rows get equal results. Other columns are ignored. An empty or null list blocks nothing; without pages there is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A block is one 64-bit word; each key sets BITS of its bits. There are about PER bits a key, up to MOST blocks (8 MB),
#: so the filter that all executors get never grows beyond that: with more keys it passes more to the join.
BITS, PER, MOST = 4, 16, 1 << 20

# Fixed values: (verdict, host, path) of the rules that every page is judged by.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """One name for a page: host without www. and port, path without trailing slashes; scheme, query and fragment go."""
    return F.when(
        host != "",
        F.concat(F.regexp_replace(F.regexp_replace(host, r":[0-9]*\z", ""), r"^www\.", ""), F.regexp_replace(path, r"/+\z", "")),
    )


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(BITS):
        # the shift is a column, so by expression
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom(keys: DataFrame) -> DataFrame:
    """One row: `bits`, an array with each block's word."""
    n = keys.count()
    blocks = 1 << max(4, min(MOST.bit_length() - 1, (n * PER // 64).bit_length()))
    own = keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))
    every = keys.sparkSession.range(blocks).withColumnRenamed("id", "block").join(own, "block", "left").select(
        "block",
        F.coalesce("word", F.lit(0)).alias("word"),
    )
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "word"))), lambda x: x["word"]).alias("bits"))


def may_have(bits: Column, key: Column) -> Column:
    mask = _mask(key)
    return F.element_at(bits, (F.pmod(F.xxhash64(key), F.size(bits)) + 1).cast("int")).bitwiseAND(mask) == mask


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each page. listed: a table of blocked URLs (`url`).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Without a rule, a page
    is blocked if its canonical URL is that of a listed one.
    """
    spark = pages.sparkSession
    names = spark.createDataFrame(
        [(f"r {h} {p}", h + p, v, len(h) + len(p)) for v, h, p in rules],
        "key string, rule string, verdict string, long int",
    )
    names = names.groupBy("key").agg(F.max_by(F.struct("rule", "verdict", "long"), "rule").alias("x")).select("key", "x.*")
    blocked = listed.select(
        canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("c")
    ).where("c is not null").select(F.concat(F.lit("u "), "c").alias("key")).distinct()
    keys = materialize(names.unionByName(blocked, allowMissingColumns=True), "url-keys")
    seen = pages.select("url").where("url is not null").distinct().select(
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    )
    lengths = F.array(*(F.lit(n) for n in sorted({len(p) for _, _, p in rules}))) if rules else F.lit(None).cast("array<int>")
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.filter(lengths, lambda n: F.length("path") >= n), lambda n: F.substring(F.col("path"), F.lit(1), n))
    fits = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(F.lit("r "), h, F.lit(" "), p))))
    tried = F.array_compact(F.array_append(
        F.coalesce(fits, F.expr("cast(array() as array<string>)")),
        F.concat(F.lit("u "), canonical(F.col("host"), F.col("path"))),
    ))
    bits = bloom(keys)
    hits = seen.select("url", tried.alias("tried"), bits.scalar().alias("bits"))
    hits = hits.select("url", F.explode(F.filter("tried", lambda k: may_have(F.col("bits"), k))).alias("key"))
    exact = hits.join(keys, "key").groupBy("url").agg(
        F.max_by(F.struct("rule", "verdict"), F.when(F.col("rule").isNotNull(), F.struct("long", F.length("rule"), "key"))).alias("r"),
        F.max(F.col("rule").isNull()).alias("in_list"),
    )
    out = pages.select("page_id", "url").join(exact, "url", "left")
    return out.select(
        "page_id",
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("in_list"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("in_list", F.lit(False)).alias("listed"),
    )
