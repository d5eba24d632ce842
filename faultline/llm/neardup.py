"""MinHash near-dedup: bottom-k sketches from one hash function.

Inverted lists of retained values generate overlapping pairs, a union-sketch estimate filters them, and the exact
Jaccard similarity of the full shingle sets confirms links. Components of the links are the groups.

Defined results: a null or blank text has an empty set and is linked with nothing. Rows that share a doc_id are one
document. A row without doc_id is in no group: its component is null and it is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, Words, components, drop_tables, list_array, materialize, mix, ship, text_slices

#: Values kept of each set for estimates, and the smallest of them that have inverted lists. Two sets of similarity s
#: share each of the RETRIEVE smallest values of their union with probability s; at 0.8 fewer than SHARED of 16 are
#: common with probability 3e-6, so of each sketch the RETRIEVE - SHARED + 1 rarest values are listed (prefix filter).
KEPT, RETRIEVE, SHARED = 64, 16, 5
#: Pairs whose estimate is more than so many standard errors below the threshold aren't compared: at 0.8, 2e-8 of them.
ERRORS = 6
#: Lists up to LIST are paired in full; longer ones with PIVOTS of their members first. What is still apart then is dealt into
#: shorter lists by the smallest values under so many further hashes of the sketch at once, as often as a link must be to
#: come together at least once but with probability LOST; lists of up to PAIRED are paired in full across what is apart, and
#: longer ones are dealt again by more hashes.
LIST, PIVOTS, JOINT, PAIRED, LOST = 24, 3, (6, 14), 64, 1e-7
#: Up to so many ids are sent to all executors (some 20 MB) where only their rows are wanted; beyond, the join shuffles.
FEW = 200_000
#: What is apart is compared in blocks of so many members, by their DEEP smallest values: all with all once, as soon as it is
#: WHOLE members at most, and before that list by list what no joint values split. Values that more than COMMON members
#: of two blocks have are counted by matrix products, others by their members, CELLS at a time.
BLOCK, DEEP, WHOLE, COMMON, CELLS = 1024, 512, 16_384, 64, 1 << 22

SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("fp1", T.LongType()),
    T.StructField("fp2", T.LongType()),
    T.StructField("sketch", T.ArrayType(T.LongType())),
])
SETS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("fp1", T.LongType()),
    T.StructField("fp2", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for part in text_slices(batch):
        values, at = Words(part.column(part.schema.get_field_index("text"))).shingles(n)
        yield part, [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _prints(one: np.ndarray) -> tuple[int, int]:
    """Two 64-bit prints of a set: sums of two hashes of its members."""
    return int(
        mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
    ), int(mix(one + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, two prints of the set and its KEPT smallest values, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, n):
                prints = [_prints(x) for x in sets]
                low = [x[:KEPT] for x in sets]
                columns = [
                    part.column(part.schema.get_field_index("doc_id")),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                ]
                columns.append(list_array(
                    _signed(np.concatenate(low)) if low else np.zeros(0, np.int64),
                    np.concatenate(([0], np.cumsum([len(x) for x in low]))),
                ))
                yield pa.RecordBatch.from_arrays(columns, names=SKETCH.names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def full_sets(documents: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """id, prints, size and the shingle set as 64-bit hashes (or its `most` smallest) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, n):
                prints, lengths = [_prints(x) for x in sets], np.array([len(x) for x in sets], np.int64)
                low = [x[:most] for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array(lengths),
                        list_array(
                            _signed(np.concatenate(low)) if low else np.zeros(0, np.int64),
                            np.concatenate(([0], np.cumsum([len(x) for x in low]))),
                        ),
                    ],
                    names=SETS.names,
                )

    return documents.mapInArrow(run, SETS)


def _estimates(sa: pa.Array, sb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sketches: the similarity in the smallest values of their union, and how many values that is."""
    rows, widths, flat = len(sa), [], []
    for x in (sa, sb):
        widths.append(np.diff(x.offsets.to_numpy()))
        flat.append(x.flatten().to_numpy().view(np.uint64))
    full = np.full((rows, 2 * KEPT), np.iinfo(np.uint64).max, np.uint64)
    for k in (0, 1):
        inside = np.arange(KEPT)[None, :] < widths[k][:, None]
        full[:, k * KEPT : (k + 1) * KEPT][inside] = flat[k]
    full.sort(axis=1)
    seen = np.minimum(np.maximum(widths[0], widths[1]), KEPT)
    again = np.zeros(full.shape, bool)
    again[:, 1:] = (full[:, 1:] == full[:, :-1]) & (full[:, 1:] != np.iinfo(np.uint64).max)
    rank = np.cumsum(~again, axis=1)
    return (again & (rank <= seen[:, None])).sum(axis=1) / np.maximum(seen, 1), seen


def _floor(t: float, seen: np.ndarray) -> np.ndarray:
    return t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(seen, 1)) - 1e-9


def few(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if they are FEW at most."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def _close(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) that the sketches don't rule out: sizes and the union-sketch estimate allow similarity t."""
    needed = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct(), "needed")
    known = classes.join(few(needed), "cid", "left_semi")
    left, right = (known.select(F.col("cid").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b").where(
        (F.col("na") >= t * F.col("nb")) & (F.col("nb") >= t * F.col("na"))
    ).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                guess, seen = _estimates(part.column(2), part.column(3))
                yield part.select([0, 1]).filter(pa.array(guess >= _floor(t, seen)))

    return joined.mapInArrow(run, "a long, b long")


def _sets_of(needed: DataFrame, documents: DataFrame, classes: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """The sets of the classes `needed` (cid): all values, or the `most` smallest. Only their texts are read again."""
    needed = materialize(classes.select("cid", F.col("fp1").alias("p1"), F.col("fp2").alias("p2")).join(needed, "cid", "left_semi"), "needed")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(few(needed.select(F.col("cid").alias("doc_id"))), "doc_id", "left_semi")
    sets = full_sets(texts, n, most).join(
        few(needed),
        (F.col("id") == F.col("cid")) & (F.col("fp1") == F.col("p1")) & (F.col("fp2") == F.col("p2")),
        "left_semi",
    )
    return sets.dropDuplicates(["id"])


def _linked(pairs: DataFrame, documents: DataFrame, classes: DataFrame, n: int, t: float) -> DataFrame:
    """Those of the pairs whose full sets have similarity t at least. Only texts that are in a pair are read again."""
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = materialize(_sets_of(needed, documents, classes, n), "sets")
    joined = pairs.join(
        sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")),
        "a",
    ).join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib")), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    percent = F.lit(round(t * 100))
    links = materialize(
        joined.select("a", "b", "na", "nb", shared.alias("both")).where(
            F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))
        ).select("a", "b"),
        "links",
    )
    drop_tables(pairs.sparkSession, sets)
    return links


def _often(t: float, joint: int) -> int:
    """How often members must be dealt by `joint` values for two of similarity t to miss each other with LOST at most."""
    return int(np.ceil(np.log(LOST) / np.log1p(-(t**joint))))


def _dealt(members: DataFrame, joint: int, times: int) -> DataFrame:
    """value, cid: lists of members (cid, sketch) whose sketches have `joint` smallest values in common, `times` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, joint + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sketch = part.column(1)
                begin = sketch.offsets.to_numpy()[:-1] - sketch.offsets.to_numpy()[0]
                flat = sketch.flatten().to_numpy().view(np.uint64)
                for k in range(times):
                    value = np.full(part.num_rows, k, np.uint64)
                    for j in range(joint):
                        seed = mix(np.array([k * joint + j + 1], np.uint64))[0]
                        value += np.minimum.reduceat(mix(flat ^ seed), begin) * weights[j]
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(mix(value))), part.column(0)], names=["value", "cid"])

    return members.mapInArrow(run, "value long, cid long")


def _star(long: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members (value, cid, label) with PIVOTS of them, but none within a component (label)."""
    # the order of members is the same in all lists, so that lists of one group agree on pivots
    pivots = long.groupBy("value").agg(*(F.min_by(F.struct("cid", "label"), F.xxhash64("cid", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)))
    met = long.join(materialize(pivots, "pivots"), "value")
    others = F.filter(F.array(*(f"p{k}" for k in range(PIVOTS))), lambda p: p["label"] != F.col("label"))
    # lists of one group give a member the same pivots again and again: once is enough, and before they are made rows
    met = met.select("cid", F.array_sort(F.array_distinct(F.transform(others, lambda p: p["cid"]))).alias("others")).where("size(others) > 0").distinct()
    out = met.select("cid", F.explode("others").alias("p"))
    return out.select(F.greatest("cid", "p").alias("a"), F.least("cid", "p").alias("b"))


def _still_apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """value, cid, label of the lists (value, cid) whose members aren't all of one component."""
    member = lists.select("value", "cid").join(
        labels.withColumnRenamed("node", "cid"),
        "cid",
        "left",
    ).withColumn("label", F.coalesce("component", "cid"))
    split = member.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("value")
    return member.select("value", "cid", "label").join(materialize(split, "split"), "value")


def _refined(long: DataFrame, links: DataFrame, documents: DataFrame, classes: DataFrame, n: int, t: float) -> DataFrame:
    """Components of the links and of those across what is still apart in long lists (value, cid)."""
    labels = materialize(components(links), "labels")
    apart = materialize(_still_apart(long, labels), "apart")
    for joint in JOINT:
        if apart.isEmpty():
            return labels
        label = materialize(apart.select("cid", "label").distinct(), "members")
        if label.count() <= WHOLE:
            apart = label.select(F.lit(0).cast("long").alias("value"), "cid", "label")
            break
        members = materialize(classes.select("cid", "n_shingles", "sketch").join(few(label), "cid"), "members")
        lists = _dealt(members.select("cid", "sketch").repartition("cid"), joint, _often(t, joint))
        lists = materialize(lists.join(few(members.select("cid", "label", "n_shingles")), "cid"), "lists")
        sizes = materialize(
            lists.groupBy("value").agg(
                F.count("*").alias("m"),
                F.min("label").alias("lo"),
                F.max("label").alias("hi"),
            ).where("lo <> hi").select("value", "m"),
            "sizes",
        )
        lists = lists.join(sizes, "value")
        short = lists.where(F.col("m") <= PAIRED)
        left, right = (short.select("value", F.col("cid").alias(k), F.col("label").alias(f"l{k}"), F.col("n_shingles").alias(f"n{k}")) for k in "ab")
        pairs = left.join(right, "value").where(
            (F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & (F.col("na") >= t * F.col("nb")) & (F.col("nb") >= t * F.col("na"))
        )
        more = lists.where(F.col("m") > PAIRED).select("value", "cid", "label")
        pairs = materialize(pairs.select("a", "b").unionByName(_star(more)).distinct(), "pairs")
        found = _linked(materialize(_close(pairs, classes, t), "close"), documents, classes, n, t)
        links = links.unionByName(found)
        labels = materialize(components(links), "labels")
        apart = materialize(_still_apart(more, labels), "apart")
    rest = None if apart.isEmpty() else materialize(_apart(apart, documents, classes, n, t), "rest")
    if rest is None or rest.isEmpty():
        return labels
    return components(links.unionByName(_linked(rest, documents, classes, n, t)))


def _apart(member: DataFrame, documents: DataFrame, classes: DataFrame, n: int, t: float) -> DataFrame:
    """Pairs across what is apart in lists (value, cid, label), if they may be or are links.

    Members are dealt into blocks, and each pair of blocks is one task of bounded size. In it, sets of up to DEEP
    values are compared exactly, so pairs that a found link joins are left out; larger ones by their DEEP smallest.
    """
    split = member.groupBy("value").agg(F.count("*").alias("m"))
    member = materialize(
        member.join(split, "value").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn(
            "block",
            F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"),
        ),
        "members",
    )
    low = materialize(_sets_of(member.select("cid").distinct(), documents, classes, n, DEEP), "deep")
    member = member.join(low.select(F.col("id").alias("cid"), "n", "items"), "cid")
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "value",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "cid",
        "label",
        "n",
        "items",
    )

    def compare(frame):
        import pandas as pd

        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        own = [np.asarray(x, np.int64).view(np.uint64) for x in frame["items"]]
        width, flat = np.array([len(x) for x in own]), np.concatenate(own)
        # what one set alone has is in no intersection
        vocabulary, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(own)), width)
        column = np.cumsum(count > COMMON) - 1
        often, seldom = count[place] > COMMON, (count[place] > 1) & (count[place] <= COMMON)
        n_often = int((count > COMMON).sum())
        block, label, ids, size = (frame[c].to_numpy().copy() for c in ("block", "label", "cid", "n"))

        def spans(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return place[kept], np.searchsorted(owner[kept], np.arange(len(own) + 1))

        (place_often, at_often), (place_seldom, at_seldom) = spans(often), spans(seldom)

        def grid(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), n_often), np.float32)
            for k, r in enumerate(rows):
                out[k, column[place_often[at_often[r] : at_often[r + 1]]]] = 1
            return out

        y = np.flatnonzero(block == j)
        in_y = np.full(len(own), -1)
        in_y[y] = np.arange(len(y))
        # of each seldom value its members in y
        mine = np.flatnonzero(seldom & (in_y[owner] >= 0))
        mine = mine[np.argsort(place[mine], kind="stable")]
        members, begin = in_y[owner[mine]], np.searchsorted(place[mine], np.arange(len(vocabulary) + 1))

        def add_seldom(rows: np.ndarray, common: np.ndarray) -> None:
            for k, r in enumerate(rows):
                values = place_seldom[at_seldom[r] : at_seldom[r + 1]]
                for at in range(0, len(values), CELLS // COMMON):
                    part = values[at : at + CELLS // COMMON]
                    n = begin[part + 1] - begin[part]
                    where = np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    common[k] += np.bincount(members[where], minlength=len(y))

        out = []

        def keep(a: int, b: int) -> None:
            out.append((max(ids[a], ids[b]), min(ids[a], ids[b])))

        tall = np.flatnonzero(block == i)
        right = [(k, grid(y[k : k + 128])) for k in range(0, len(y), 128)]
        for x in (tall[k : k + 128] for k in range(0, len(tall), 128)):
            na, nb, wa, wb = size[x][:, None], size[y][None, :], width[x][:, None], width[y][None, :]
            apart = (label[x][:, None] != label[y][None, :]) & (np.minimum(na, nb) >= t * np.maximum(na, nb))
            if not apart.any():
                continue
            left = grid(x)
            common = np.concatenate([left @ g.T for _, g in right], axis=1)
            add_seldom(x, common)
            whole = (na == wa) & (nb == wb)
            seen = np.maximum(wa, wb)
            links = apart & whole & (common * 100 >= round(t * 100) * (na + nb - common))
            # one link joins two components; the next ones between them say nothing new
            for p in np.flatnonzero(links.any(axis=1)):
                a = x[p]
                for q in np.flatnonzero(links[p] & (label[y] != label[a])):
                    if label[a] != label[y[q]]:
                        keep(a, y[q])
                        label[label == label[y[q]]] = label[a]
            maybe = apart & ~whole & (common >= _floor(t, seen) * seen) & (label[x][:, None] != label[y][None, :])
            for p, q in zip(*np.nonzero(maybe), strict=True):
                if i == j and y[q] < x[p]:
                    continue
                a, b = own[x[p]], own[y[q]]
                union = np.union1d(a, b)[: max(len(a), len(b))]
                near = np.isin(a, b, assume_unique=True) & (a <= union[-1])
                if near.sum() / len(union) >= _floor(t, np.array(len(union))):
                    keep(x[p], y[q])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("value", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents.

    Equal sets are one class from the start, so copies are never paired. component_id is the smallest doc_id that
    can be reached over links; kept marks the document with that id.
    """
    ship(documents.sparkSession)
    with Tables(documents.sparkSession) as made:
        own = materialize(sketches(documents, n), "sketches")
        classes = own.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(
            F.min("doc_id").alias("cid"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        )
        classes = materialize(classes, "classes")
        spark = documents.sparkSession

        low = F.slice("sketch", 1, RETRIEVE)
        values = classes.select("cid", F.size(low).alias("have"), F.explode(low).alias("value"))
        # counts are stored before they are joined, so that a value that very many sets have is split in the join
        often = materialize(values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1"), "often")
        listed = values.join(often, "value").groupBy("cid").agg(
            F.first("have").alias("have"),
            F.array_sort(F.collect_list(F.struct("often", "value"))).alias("all"),
        )
        # values that no other set has come first in the order, so that many of the listed places are taken already
        need = F.when(F.col("have") < RETRIEVE, F.ceil(t * F.col("have")).cast("int")).otherwise(SHARED)
        room = F.greatest(F.lit(0), F.size("all") - F.greatest(F.lit(0), need - 1))
        listed = materialize(
            listed.select("cid", F.explode(F.slice("all", F.lit(1), room)).alias("x")).select("cid", F.col("x.value").alias("value")),
            "listed",
        )
        many = materialize(listed.groupBy("value").agg(F.count("*").alias("m")).where("m > 1"), "many")
        lists = materialize(listed.join(many, "value"), "lists")

        short = lists.where(F.col("m") <= LIST)
        pairs = short.select("value", F.col("cid").alias("a")).join(
            short.select("value", F.col("cid").alias("b")),
            "value",
        ).where("a > b").select("a", "b")
        long = lists.where(F.col("m") > LIST)
        pairs = materialize(pairs.unionByName(_star(long.withColumn("label", F.col("cid")))).distinct(), "pairs")
        links = _linked(materialize(_close(pairs, classes, t), "close"), documents, classes, n, t)
        same = own.where("n_shingles > 0 and doc_id is not null").select("doc_id", "fp1", "fp2").join(
            classes.select("fp1", "fp2", "cid"),
            ["fp1", "fp2"],
        )
        # one doc_id with several sets joins their classes
        twice = same.groupBy("doc_id").agg(F.min("cid").alias("b"), F.max("cid").alias("a")).where("a <> b").select("a", "b")
        links = links.unionByName(twice)
        labels = components(links) if long.isEmpty() else _refined(long, links, documents, classes, n, t)
        labels = classes.select("fp1", "fp2", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
            "fp1",
            "fp2",
            F.coalesce("component", "cid").alias("component"),
        )
        out = made.keep(
            own.select("doc_id", "n_shingles", "fp1", "fp2").join(labels, ["fp1", "fp2"], "left").select("doc_id", "n_shingles", "component"),
            "groups",
        )
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn(
        "component_id",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
