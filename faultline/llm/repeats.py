"""Suffix-array dedup: sparse suffix arrays over the words of all documents.

Suffixes are kept at content-selected minimiser positions only: in any SHORTEST equal words the same word is selected.
They are sorted, neighbours are compared, and a match is extended right and left; matches of SHORTEST words or more are
repeated passages, and overlapping ones of a document are one span.

Defined results: null, blank and shorter texts have no span. Rows that share a doc_id and a text are one document;
words are compared with A-Z lower-cased. A passage that repeats within one document counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_tables, materialize, mix, ship, text_slices

#: A passage's words, the words that a suffix is keyed by, and so the keys among which the smallest is selected.
SHORTEST, KEY = 50, 11
CHOICE = SHORTEST - KEY + 1
#: A key that at least this part (one in so many) of all suffixes have is joined without a shuffle.
HOT = 1000
#: The suffixes of such keys are sorted in ranges of about so many rows; the sample that sets the ranges follows their number.
RANGE = 200_000
#: Suffixes are compared so far right (from their first word on) and left.
RIGHT, LEFT = SHORTEST, CHOICE - 1


def minimisers(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions and their keys: of each CHOICE keys in a row within a text, the smallest (first of ties)."""
    keys = w.rolled(KEY)
    spans = len(w.hash) - SHORTEST + 1
    if spans <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, reach = np.arange(len(keys)), 1
    while reach < CHOICE:
        shift = min(reach, CHOICE - reach)
        a, b = best[: len(best) - shift], best[shift:]
        best = np.where(keys[a] <= keys[b], a, b)
        reach += shift
    best = best[:spans]
    last = np.repeat(w.first[1:], np.diff(w.first))[:spans]  # the end of each word's text
    best = best[np.arange(spans) + SHORTEST <= last]
    best = best[np.concatenate(([True], best[1:] != best[:-1]))] if len(best) else best
    return best, keys[best]


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).where("text is not null").withColumn("print", F.xxhash64("text"))


def _anchors(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                w = Words(part.column(1))
                at, keys = minimisers(w)
                text = np.searchsorted(w.first, at, "right") - 1
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        part.column(2).take(rows),
                        pa.array((at - w.first[text]).astype(np.int32)),
                        pa.array(keys.view(np.int64)),
                    ],
                    names=["doc_id", "print", "pos", "key"],
                )

    return documents.mapInArrow(run, "doc_id long, print long, pos int, key long")


def _suffixes(joined: DataFrame) -> DataFrame:
    """key, doc_id, print, pos, and the words around as bytes that sort like the words: right of it, and left of it backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, most=1 << 20):
                w = Words(part.column(1))
                places = part.column(3)
                text = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                pos = places.flatten().to_numpy()
                at = w.first[text] + pos
                keys = w.rolled(KEY)[at]
                code = np.concatenate((np.zeros(LEFT, ">u4"), (w.hash >> np.uint64(33)).astype(">u4") + 1, np.zeros(RIGHT, ">u4")))
                far = np.minimum(w.first[text + 1] - at, RIGHT)
                back = np.minimum(at - w.first[text], LEFT)
                right = code[at[:, None] + LEFT + np.arange(RIGHT)[None, :]] * (np.arange(RIGHT)[None, :] < far[:, None])
                left = code[at[:, None] + LEFT - 1 - np.arange(LEFT)[None, :]] * (np.arange(LEFT)[None, :] < back[:, None])
                packed = np.concatenate((right.astype(">u4"), left.astype(">u4")), axis=1)
                size = packed.shape[1] * 4
                data = pa.Array.from_buffers(
                    pa.binary(),
                    len(pos),
                    [None, pa.py_buffer((np.arange(len(pos) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())],
                )
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), part.column(0).take(rows), part.column(2).take(rows), pa.array(pos.astype(np.int32)), data],
                    names=["key", "doc_id", "print", "pos", "around"],
                )

    return joined.mapInArrow(run, "key long, doc_id long, print long, pos int, around binary")


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words of each row are equal, and are words."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _windows(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix: hashes of the SHORTEST words from each of its LEFT + 1 first words on, and which are whole."""
    line = np.concatenate((around[:, RIGHT:][:, ::-1], around[:, :RIGHT]), axis=1).astype(np.uint64)
    c = mix(np.arange(1, SHORTEST + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(line), LEFT + 1), np.uint64)
    for j in range(SHORTEST):
        out += line[:, j : j + LEFT + 1] * c[j]
    whole = np.cumsum(line == 0, axis=1)
    whole = np.concatenate((np.zeros((len(line), 1), whole.dtype), whole), axis=1)
    return mix(out), whole[:, SHORTEST:][:, : LEFT + 1] == whole[:, : LEFT + 1]


def _around(part: pa.RecordBatch) -> np.ndarray:
    buffers, skip, n = part.column(4).buffers(), part.column(4).offset, part.num_rows
    offsets = np.frombuffer(buffers[1], np.int32)[skip : skip + n + 1]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]].view(">u4").reshape(n, RIGHT + LEFT)


_MATCH = pa.schema([
    ("kind", pa.int32()),
    ("doc_id", pa.int64()),
    ("print", pa.int64()),
    ("start", pa.int32()),
    ("end", pa.int32()),
    ("other", pa.int64()),
    ("key", pa.int64()),
    ("window", pa.int64()),
    ("around", pa.binary()),
])
_MATCH_DDL = "kind int, doc_id long, print long, start int, end int, other long, key long, window long, around binary"
#: Kinds of rows: a match; a window that no neighbour has, but another suffix may have; the first and last suffix of a task.
FOUND, OPEN, EDGE = 0, 1, 2


def _rows(n: int, kind: int, **columns) -> pa.RecordBatch:
    given = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays(
        [
            pa.array(given[f.name]).cast(f.type) if f.name in given and not isinstance(given[f.name], pa.Array) else given.get(f.name, pa.nulls(n, f.type)) for f in _MATCH
        ],
        schema=_MATCH,
    )


def _neighbours(part: pa.RecordBatch, low: int, high: int, loose: tuple[bool, bool] = (False, False)) -> Iterator[pa.RecordBatch]:
    """What the rows low to high of sorted suffixes share with the ones before and after them.

    Sorted, no other suffix shares more words to the right than a neighbour does; so only windows that end within that
    reach can be elsewhere. loose: the first or the last row has a neighbour in another task, of unknown reach.
    """
    n = part.num_rows
    key, mark, pos = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
    around = _around(part)
    same = key[:-1] == key[1:]
    right = np.concatenate(([0], np.where(same, _equal(around[:-1, :RIGHT], around[1:, :RIGHT]), 0), [0]))
    left = np.concatenate(([0], np.where(same, _equal(around[:-1, RIGHT:], around[1:, RIGHT:]), 0), [0]))
    i = np.arange(low, high)
    start, end = pos[i].copy(), pos[i].copy()
    for side, it in ((i, i - 1), (i + 1, i + 1)):
        hit = np.flatnonzero(right[side] + left[side] >= SHORTEST)
        me = i[hit]
        start[hit], end[hit] = np.minimum(start[hit], pos[me] - left[side][hit]), np.maximum(end[hit], pos[me] + right[side][hit])
        if len(me):
            yield _rows(
                len(me),
                FOUND,
                doc_id=part.column(1).take(pa.array(me)),
                print=mark[me],
                start=pos[me] - left[side][hit],
                end=pos[me] + right[side][hit],
                other=part.column(1).take(pa.array(it[hit])),
            )
    reach = np.maximum(right[i], right[i + 1])
    if loose[0] and low == 0:
        reach[0] = RIGHT
    if loose[1] and high == n:
        reach[-1] = RIGHT
    first = pos[i][:, None] - LEFT + np.arange(LEFT + 1)[None, :]
    free = (np.arange(LEFT + 1)[None, :] - LEFT + SHORTEST <= reach[:, None]) & ~((first >= start[:, None]) & (first + SHORTEST <= end[:, None]))
    some = np.flatnonzero(free.any(axis=1))
    if len(some):
        hashes, whole = _windows(around[i[some]])
        r, c = np.nonzero(free[some] & whole)
        me = i[some][r]
        if len(me):
            yield _rows(
                len(me),
                OPEN,
                doc_id=part.column(1).take(pa.array(me)),
                print=mark[me],
                start=first[some][r, c],
                end=first[some][r, c] + SHORTEST,
                key=key[me],
                window=hashes[r, c].view(np.int64),
            )


def _edge(part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    row = part.slice(k, 1)
    return _rows(1, EDGE, doc_id=row.column(1), print=row.column(2), start=row.column(3), key=row.column(0), around=row.column(4))


def _once(part: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted suffixes without repeated rows: those of documents that are the same by id and text."""
    given = part.column(1).is_valid().to_numpy(zero_copy_only=False)
    columns = (part.column(0).to_numpy(), part.column(1).fill_null(0).to_numpy(), given, part.column(2).to_numpy(), part.column(3).to_numpy())
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return part if new.all() else part.filter(pa.array(new))


def _compared(ends: bool):
    """Over one task's sorted suffixes: matches and open windows. ends: keys go on in other tasks, so the first and the last
    suffix are given too, and what they share with others is not known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        begun = False
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                part = whole.slice(at, 8192)
                if held is None and ends:
                    yield _edge(part, 0)
                part = _once(pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0] if held is not None else part)
                if part.num_rows > 1:
                    # held are the last two; the first of them is done
                    yield from _neighbours(part, 1 if begun else 0, part.num_rows - 1, (ends, False))
                    begun = True
                    held = part.slice(part.num_rows - 2)
                else:
                    held = part
        if held is not None:
            yield from _neighbours(held, held.num_rows - 1, held.num_rows, (ends, ends))
            if ends:
                yield _edge(held, held.num_rows - 1)

    return run


def _compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows > 1:
            for row in _neighbours(part, 0, part.num_rows):
                yield row.filter(pa.compute.equal(row.column(0), FOUND))


def _all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last place of each window of a batch. Suffixes of one key come together, so of a passage that very
    many documents have few rows are left to be counted."""
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            part = whole.slice(at, 8192)
            hashes, good = _windows(_around(part))
            r, c = np.nonzero(good)
            window, start = hashes[r, c], part.column(3).to_numpy()[r] - LEFT + c
            given = part.column(1).is_valid().to_numpy(zero_copy_only=False)
            doc_id, mark = part.column(1).fill_null(0).to_numpy(), part.column(2).to_numpy()
            order = np.lexsort((start, mark[r], doc_id[r], given[r], window))
            change = window[order][1:] != window[order][:-1]
            ends = np.unique(np.concatenate((
                np.flatnonzero(np.concatenate(([True], change))),
                np.flatnonzero(np.concatenate((change, [True]))),
            ))) if len(order) else order
            keep = order[ends]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1).take(pa.array(r[keep])),
                    part.column(2).take(pa.array(r[keep])),
                    pa.array(start[keep].astype(np.int32)),
                    pa.array(window[keep].view(np.int64)),
                ],
                names=["doc_id", "print", "start", "window"],
            )


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_words, other: each maximal span of words of a document that is covered by passages of SHORTEST
    words or more that occur elsewhere too, and the smallest doc_id of a neighbour that has one of them.
    """
    ship(documents.sparkSession)
    spark = documents.sparkSession
    docs = _documents(documents)
    anchors = materialize(_anchors(docs), "anchors")
    again = materialize(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "again")
    # keys that so large a share of all suffixes have are HOT at most; their suffixes stay where they are
    hot = materialize(again.where(F.col("n") * HOT >= anchors.count()).select("key", "n"), "hot")
    often = F.broadcast(hot.select("key"))
    kept = anchors.join(often, "key", "left_semi").unionByName(anchors.join(often, "key", "left_anti").join(again.select("key"), "key", "left_semi"))
    places = kept.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    joined = docs.join(
        places.withColumnsRenamed({"doc_id": "d", "print": "p"}),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")),
    ).select("doc_id", "text", "print", "places")
    suffixes = materialize(_suffixes(joined), "suffixes")
    drop_tables(spark, anchors, again)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "around", "doc_id", "print", "pos"]
    # only suffixes of one key are compared: all of a key meet in one task
    rare = suffixes.join(often, "key", "left_anti").repartition(parts, "key").sortWithinPartitions(*order)
    # but for keys that very many have: their suffixes are dealt by ranges of so many rows, whatever the key
    some = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(2, -(-some // RANGE))
    many = suffixes.join(often, "key", "left_semi").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    matches = materialize(rare.mapInArrow(_compared(False), _MATCH_DDL).unionByName(many.mapInArrow(_compared(True), _MATCH_DDL)), "matches")
    # neighbours in two tasks: the two outer suffixes of each range meet in one small one
    edges = matches.where(F.col("kind") == EDGE).select("key", "doc_id", "print", F.col("start").alias("pos"), "around").distinct()
    edges = edges.coalesce(1).sortWithinPartitions(*order).mapInArrow(_compare_edges, _MATCH_DDL)
    # matches with suffixes that aren't neighbours: windows within reach, looked up among those of the same keys
    free = matches.where(F.col("kind") == OPEN).select("key", "doc_id", "print", "start", "end", "window")
    # stored, and always a shuffle: a key that very many suffixes have is split at run time
    wanted = materialize(free.select("key").distinct(), "open-keys")
    every = suffixes.join(wanted.hint("merge"), "key", "left_semi").select("key", "doc_id", "print", "pos", "around")
    every = every.sortWithinPartitions("key").mapInArrow(
        _all_windows,
        "doc_id long, print long, start int, window long",
    ).join(free.select("window").distinct(), "window", "left_semi")
    place = F.struct("doc_id", "print", "start")
    twice = every.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select(
        "window",
        F.col("a.doc_id").alias("x"),
        F.col("b.doc_id").alias("y"),
    )
    late = free.join(twice, "window").select(
        "doc_id",
        "print",
        "start",
        "end",
        F.when(F.col("x") == F.col("doc_id"), F.col("y")).otherwise(F.col("x")).alias("other"),
    )
    found = matches.where(F.col("kind") == FOUND).unionByName(edges, allowMissingColumns=True).select("doc_id", "print", "start", "end", "other").unionByName(late)
    spans = found.groupBy("doc_id", "print").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("all"),
        F.min(F.when(F.col("other") != F.col("doc_id"), F.col("other"))).alias("other"),
    )
    merged = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc,
        x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return spans.select("doc_id", F.coalesce("other", "doc_id").alias("other"), F.explode(merged).alias("x")).select(
        "doc_id",
        F.col("x.start").cast("long").alias("start"),
        (F.col("x.end") - F.col("x.start")).cast("long").alias("n_words"),
        "other",
    )
