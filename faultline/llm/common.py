"""Pieces that the corpus operators share: tables in the shared folder, word hashing on Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The tables that materialize() writes within a `with` block. When it ends, those that aren't kept are deleted: what the
    block returns may only read kept ones. Inner blocks have tables of their own."""

    open: list[Tables] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        Tables.open.append(self)
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """materialize(), into the block around this one."""
        return materialize(df, label, Tables.open[-2] if len(Tables.open) > 1 else None)

    def __exit__(self, *_) -> None:
        Tables.open.pop()
        delete(self.spark, *self.paths)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame, label: str, within: Tables | bool | None = True) -> str:
    """Write df to a new folder of the shared one, and give its path."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    block = (Tables.open[-1] if Tables.open else None) if within is True else within
    if block:
        block.paths.append(path)
    return path


def materialize(df: DataFrame, label: str, within: Tables | bool | None = True) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps survive a lost executor and never recompute it."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label, within))


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing lazy reads any more."""
    for df in frames:
        delete(spark, *(path.rpartition("/")[0] for path in df.inputFiles()[:1]))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for those that haven't got it installed."""
    context = spark.sparkContext
    if getattr(context, "_faultline_shipped", False):
        return
    context._faultline_shipped = True
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="faultline-code-")) / "faultline.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- words as hashes, on Arrow batches -------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its rows in them (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n, buffers = len(column), column.buffers()
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes, so that memory doesn't follow the batch (one row at least)."""
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """All words of some texts, in order: hash, byte span, and where each text's words begin."""

    def __init__(self, column: pa.Array, blank: np.ndarray = _BLANK, fold: bool = True) -> None:
        data, offsets = string_buffers(column)
        starts, ends, hashes = [], [], []
        at, size = 0, len(data)
        while at < size:
            end = min(size, at + _PIECE)
            while end < size and not blank[data[end]]:  # a cut only where no word is cut: at a blank or a text's end
                nxt = offsets[np.searchsorted(offsets, end, "left")]
                gap = np.flatnonzero(blank[data[end : min(end + 4096, size)]])
                end = min(int(nxt), end + int(gap[0]) if len(gap) else min(end + 4096, size))
                if end == nxt:
                    break
            s, e, h = self._piece(data[at:end], offsets[(offsets > at) & (offsets < end)] - at, blank, fold)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = end
        none = np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.hash = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        self.data = data
        self.first = np.searchsorted(self.start, offsets, "left")  # of each text, and the end
        self.offsets = offsets

    @staticmethod
    def _piece(data: np.ndarray, cuts: np.ndarray, blank: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        _Powers.reach(n + 1)
        inside = ~blank[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        if len(cuts):
            begin[cuts] = inside[cuts]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        if len(cuts):
            stop[cuts - 1] = inside[cuts - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(((_FOLD[data] if fold else data).astype(np.uint64) + np.uint64(1)) * _Powers.up[:n], out=sums[1:])
        return s, e, mix((sums[e] - sums[s]) * _Powers.down[s] + (e - s).astype(np.uint64))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows within texts, and where each text's begin. A text with fewer words has one, of them all."""
        count = np.diff(self.first)
        own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        at = np.concatenate(([0], np.cumsum(own)))
        rolled = self.rolled(n)
        if not len(own) or not at[-1]:
            return np.zeros(0, np.uint64), at
        where = np.repeat(self.first[:-1] - at[:-1], own) + np.arange(at[-1])
        out = rolled[np.minimum(where, max(0, len(rolled) - 1))] if len(rolled) else np.zeros(at[-1], np.uint64)
        for k in np.flatnonzero((count > 0) & (count < n)):
            a, b = self.first[k], self.first[k + 1]
            out[at[k]] = combine(self.hash[a:b])
        return out, at

    def rolled(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on, whatever text they are in."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(m, np.uint64)
        for j, c in enumerate(_constants(n)):
            total += self.hash[j : j + m] * c
        return mix(total)


def _constants(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(n)) | np.uint64(1)


def combine(hashes: np.ndarray) -> np.uint64:
    return mix(np.array([(hashes * _constants(len(hashes))).sum(dtype=np.uint64)], np.uint64))[0]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


# --- connected components --------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (a, b): component is the smallest node that can be reached.

    Large-star and small-star rounds: stars shrink towards the smallest node, in a number of rounds that grows with
    the logarithm of the graph; they go on until one changes nothing. Only two sums per round reach the driver. A hub's
    edges are split by the join.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        big = materialize(big, "large-star")
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small, "small-star")
        row = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_tables(edges.sparkSession, now, big)
        now = small
        if (seen := tuple(row)) == mark:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        mark = seen
