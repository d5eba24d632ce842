"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages are projected by a distributed randomised SVD; cosine search of every document window against every
benchmark passage gives candidates; the longest common subsequence of words and a check of the passage's last sentence
(its answer) confirm them, so passages with a few words changed, dropped or inserted are found too. A long passage is
searched by its pieces; any of them that is found has the whole passage verified around it.

Defined results: null or blank texts on either side match nothing; equal benchmark items are each reported; rows that
share a doc_id are judged one by one and reported once per (doc_id, item_id), best match first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, ship, text_slices

#: Pieces of benchmark passages held at once; a larger benchmark is searched in blocks of so many, one pass over the documents each.
ITEMS = 4096
RANK, OVERSAMPLE, POWER, FEATURES = 64, 16, 2, 1 << 14
#: Windows of so many words, at a quarter's distance: a piece is searched with the smallest that holds it whole in one.
WIDTHS = (16, 32, 64, 128, 256, 512)
#: Longer passages are cut into equal pieces of so many words at most, which the widest windows hold whole.
PIECE = WIDTHS[-1] * 3 // 4
#: Weights are inverse document frequencies to this power. A candidate's cosine at least, and the share at least of the
#: piece's length in latent space that its window reaches in the piece's direction. Of a match at least: the share of the passage's words in a common subsequence with the
#: window, the same share of its last sentence, and the share of its inverse document frequencies that the window has.
SHARP, COSINE, REACH, LCS, ANSWER, MASS = 1.5, 0.5, 0.4, 0.7, 0.5, 0.6

_STOP = frozenset((46, 33, 63))


def _lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one machine word operation per many positions of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        u = row & where.get(x, 0)
        row = (row + u) | (row - u)
    return len(a) - (row & full).bit_count()


def _sums(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each line of `index` the sum of the rows that it names, from left to right; the last row is the one for none.

    In pieces that the cache holds, column by column: reduceat adds so short rows some times slower.
    """
    out = np.empty((len(index), rows.shape[1]), rows.dtype)
    held = np.empty((2048, rows.shape[1]), rows.dtype)
    for at in range(0, len(index), len(held)):
        part = index[at : at + len(held)]
        own, buffer = out[at : at + len(part)], held[: len(part)]
        np.take(rows, part[:, 0], axis=0, out=own, mode="clip")
        for k in range(1, index.shape[1]):
            own += np.take(rows, part[:, k], axis=0, out=buffer, mode="clip")
    return out


class Benchmark:
    """Passages as word hashes, their vocabulary, where each one's last sentence begins, and their pieces: (passage, first word, end)."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        w = Words(pa.array([t for _, t in rows], pa.string()))
        self.ids = [i for i, _ in rows]
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.answer = []
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            ends = [k - a + 1 for k in range(a, b - 1) if int(w.data[w.end[k] - 1]) in _STOP]
            self.answer.append(next((e for e in reversed(ends) if b - a - e >= 3), max(0, (b - a) - max(3, (b - a) // 4))))
        self.pieces = [
            (i, len(x) * k // n, len(x) * (k + 1) // n) for i,
            x in enumerate(self.words) for n in [max(1, -(-len(x) // PIECE))] for k in range(n)
        ]
        self.vocabulary = np.unique(w.hash)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.feature = (self.vocabulary % np.uint64(FEATURES)).astype(np.int32) if len(self.vocabulary) > FEATURES else np.arange(len(self.vocabulary), dtype=np.int32)
        self.n_features = min(len(self.vocabulary), FEATURES)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place in the vocabulary of each word, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        good = self.vocabulary[place] == hashes[maybe]
        out[maybe[good]] = place[good]
        return out

    def piece(self, k: int) -> np.ndarray:
        i, a, b = self.pieces[k]
        return self.words[i][a:b]

    def matrix(self, idf: np.ndarray, which: np.ndarray) -> np.ndarray:
        """TF-IDF rows of length one of some pieces."""
        out = np.zeros((len(which), self.n_features), np.float32)
        for k, i in enumerate(which):
            place = self.find(self.piece(i))
            np.add.at(out[k], self.feature[place], idf[place])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def document_frequencies(documents: DataFrame, bench: Benchmark) -> tuple[np.ndarray, int]:
    """Over all documents: how many have each word of the benchmark, and how many documents there are."""
    size = len(bench.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in text_slices(batch):
                w = Words(part.column(0))
                place = bench.find(w.hash)
                text = np.repeat(np.arange(part.num_rows), np.diff(w.first))
                got = np.unique(text[place >= 0] * size + place[place >= 0])
                count += np.bincount(got % size, minlength=size)
                rows += part.num_rows
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(count[found], rows))], names=["place", "n"])

    out, total = np.zeros(size, np.int64), 0
    # one row per word of a bounded benchmark block comes back
    for place, n in documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if place < 0:
            total = n
        else:
            out[place] = n
    return out, total


def randomised_svd(spark: SparkSession, bench: Benchmark, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors (features x rank) of the pieces' TF-IDF matrix A.

    Executors multiply their rows: A' (A Q) is a sum over rows, so each round sends back one bounded sum.
    """
    rng = np.random.default_rng(7)
    basis = rng.standard_normal((bench.n_features, min(RANK + OVERSAMPLE, bench.n_features))).astype(np.float32)
    parts = max(1, min(64, len(bench.pieces) // 256))
    rows = spark.range(len(bench.pieces)).repartition(parts, "id") if parts > 1 else spark.range(0, len(bench.pieces), 1, 1)

    for _ in range(POWER + 1):
        q, _ = np.linalg.qr(basis)

        def run(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape, np.float32)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for at in range(0, len(ids), 128):
                    a = bench.matrix(idf, ids[at : at + 128])
                    total += a.T @ (a @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        basis = np.zeros(q.shape, np.float32)
        for row in rows.mapInArrow(run, "part binary").toLocalIterator():
            basis += np.frombuffer(row[0], np.float32).reshape(q.shape)
    u, _, _ = np.linalg.svd(basis, full_matrices=False)
    return np.ascontiguousarray(u[:, :RANK].astype(np.float32))


class Index:
    """Pieces in latent space by the width of their windows, and the search of documents against them."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, right: np.ndarray) -> None:
        self.bench, self.idf = bench, idf
        self.table = np.vstack([right[bench.feature] * idf[:, None], np.zeros((1, right.shape[1]))]).astype(np.float32)  # the last: other words
        self.mass = [float(idf[bench.find(w)].sum()) for w in bench.words]
        self.groups = []
        lengths = np.array([b - a for _, a, b in bench.pieces])
        for k, width in enumerate(WIDTHS):
            low, high = (WIDTHS[k - 1] * 3 // 4 if k else 0), width * 3 // 4
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(own):
                latent = bench.matrix(idf, own) @ right
                self.groups.append((
                    width,
                    own,
                    np.ascontiguousarray((latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).T),
                    np.array([REACH * np.linalg.norm(self.table[bench.find(bench.piece(i))].sum(axis=0)) for i in own], np.float32),
                ))

    def search(self, w: Words) -> Iterator[tuple[int, int, int, int, float, float]]:
        """(text, passage, first word, words, cosine, share of the passage found) for the texts' words."""
        count = np.diff(w.first)
        place = self.bench.find(w.hash)
        finest = self.groups[0][0] // 4
        blocks = -(-count // finest)
        base = np.concatenate(([0], np.cumsum(blocks)))
        if not base[-1]:
            return
        tried: set[tuple[int, int, int]] = set()
        text = np.repeat(np.arange(len(count)), blocks)
        words = np.full(len(text) * finest, len(self.table) - 1, np.int64)
        words[np.arange(w.first[0], w.first[-1]) + np.repeat(base[:-1] * finest - w.first[:-1], count)] = np.where(place < 0, len(self.table) - 1, place)
        # the last row: beyond a text's end
        fine = np.vstack([_sums(self.table, words.reshape(-1, finest)), np.zeros((1, self.table.shape[1]), np.float32)])
        for width, own, latent, reach in self.groups:
            step = width // 4
            blocks = -(-count // step)
            text = np.repeat(np.arange(len(count)), blocks)
            nth = np.arange(len(text)) - np.concatenate(([0], np.cumsum(blocks)))[text]
            start = w.first[text] + nth * step
            parts = (base[text] + nth * (step // finest))[:, None] + np.arange(step // finest)
            sums = fine[:-1] if step == finest else _sums(fine, np.where(parts < base[text + 1][:, None], parts, len(fine) - 1))
            window = sums.copy()
            for k in range(1, 4):
                if len(text) > k:
                    window[:-k] += sums[k:] * (text[k:] == text[:-k])[:, None]
            norm = np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
            for at in range(0, len(window), 8192):
                dot = window[at : at + 8192] @ latent
                cosine = dot / norm[at : at + 8192]
                near = (dot >= reach) & (cosine >= COSINE)
                for i, j in zip(*np.nonzero(near), strict=True):
                    item, begin, end = self.bench.pieces[own[j]]
                    one, long = text[at + i], len(self.bench.words[item])
                    if end - begin == long:
                        a, b = start[at + i] - step, start[at + i] + max(width, long * 5 // 4) + step
                    else:  # around the passage's likely first word, from multiples of a quarter, so pieces share what is verified
                        a = w.first[one] + (start[at + i] - begin - long // 4 - w.first[one]) // (long // 4) * (long // 4)
                        b = a + long // 4 * 7 + width
                        if (one, item, a) in tried:
                            continue
                        tried.add((one, item, a))
                    a, b = max(w.first[one], a), min(w.first[one + 1], b)
                    if found := self.verify(item, w.hash[a:b], place[a:b]):
                        yield int(one), int(item), int(a - w.first[text[at + i]]), int(b - a), float(cosine[i, j]), found

    def verify(self, item: int, hashes: np.ndarray, place: np.ndarray) -> float | None:
        own = self.bench.words[item]
        here = np.isin(own, hashes)
        if here.sum() < LCS * len(own) or self.idf[self.bench.find(own[here])].sum() < MASS * self.mass[item]:
            return None
        passage, window = own.tolist(), hashes[place >= 0].tolist()
        share = _lcs(passage, window) / len(passage)
        last = passage[self.bench.answer[item] :]
        return share if share >= LCS and _lcs(last, window) >= ANSWER * len(last) else None


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, cosine, share: documents that have a benchmark passage, and where."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    block: list[tuple[int, str]] = []
    held = 0
    found = []

    def search(rows: list[tuple[int, str]]) -> None:
        bench = Benchmark(rows)
        if not len(bench.vocabulary):
            return
        count, total = document_frequencies(docs, bench)
        idf = (np.log((1 + total) / np.minimum(1 + count, 1 + total)) ** SHARP).astype(np.float32) + np.float32(1e-3)
        index = Index(bench, idf, randomised_svd(spark, bench, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, most=1 << 20):
                    best: dict[tuple[int, int], tuple] = {}
                    for text, item, first, n, cosine, share in index.search(Words(part.column(0))):
                        if share > best.get((text, item), (0, 0, 0, 0))[3]:
                            best[text, item] = (first, n, cosine, share)
                    rows = [(part.column(1)[t].as_py(), bench.ids[i], *x) for (t, i), x in best.items()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(c), k) for c,
                            k in zip(
                                zip(*rows, strict=True) if rows else [[]] * 6,
                                (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()),
                                strict=True,
                            )
                        ],
                        names=["doc_id", "item_id", "first_word", "n_words", "cosine", "share"],
                    )

        found.append(docs.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, cosine double, share double"))

    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        own = max(1, -(-len(row[1].split()) // PIECE))
        if block and held + own > ITEMS:
            search(block)
            block, held = [], 0
        block.append((row[0], row[1]))
        held += own
    if block:
        search(block)
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, first_word long, n_words long, cosine double, share double")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    best = F.max(F.struct("share", F.col("first_word"), "n_words", "cosine")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.first_word", "x.n_words", "x.cosine", "x.share")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that leaks() finds, with the columns of documents. A row without doc_id is known by the
    hash of its text."""
    name = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    bad = leaks(documents.select(name.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return documents.join(bad, name == F.col("__leak"), "left_anti")
