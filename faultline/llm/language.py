"""Language ID: a byte convolutional network in numpy.

Byte embeddings, filters of several widths, maximum over a fixed-length window and softmax. It is trained on a bounded
sample of labelled rows and applied in batches to all windows of whole texts; a text's label is that of the windows'
mean log-probability, weighted by their bytes.

Defined results: a text that is null or has no letter is "und" with score 0; with no labelled row at all, every text is.
Rows are judged one by one, so repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, string_buffers, text_slices

#: The training sample: at most so many labelled documents, and windows of each, spread over it. Languages take turns, each
#: with the documents of least hashed id, so that a rare one has all of its own in it (with SAMPLE languages at most).
SAMPLE, EACH = 4000, 4
WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE = 4, 128, 4e-3


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts (the last of each padded with zeros), the text of each, and its bytes."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    first = np.concatenate(([0], np.cumsum(n)))
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    flat[np.repeat(first[:-1] * WINDOW - offsets[:-1], size) + np.arange(len(data))] = data
    text = np.repeat(np.arange(len(size)), n)
    left = size[text] - (np.arange(len(text)) - first[text]) * WINDOW
    return flat.reshape(-1, WINDOW), text, np.minimum(left, WINDOW)


class ByteNet:
    """The network's weights, their training, and tables for fast use."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {
            "embed": rng.normal(0, 0.3, (256, DEPTH)).astype(np.float32),
            "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
            "bias": np.zeros(len(labels), np.float32),
        }
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, (1 / (k * DEPTH)) ** 0.5, (k * DEPTH, FILTERS)).astype(np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                grads = self._gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        rows, at = np.arange(len(x)), np.arange(FILTERS)
        e = self.w["embed"][x]
        peaks, kept = [], []
        for k in WIDTHS:
            n = WINDOW - k + 1
            z = np.zeros((len(x), n, FILTERS), np.float32)
            for j in range(k):
                z += e[:, j : j + n] @ self.w[f"f{k}"][j * DEPTH : (j + 1) * DEPTH]
            where = z.argmax(axis=1)
            top = np.take_along_axis(z, where[:, None], 1)[:, 0]
            kept.append((where, top > 0))
            peaks.append(np.maximum(top, 0))
        h = np.concatenate(peaks, axis=1)
        p = h @ self.w["out"] + self.w["bias"]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p /= len(x)
        grads = {"out": h.T @ p, "bias": p.sum(axis=0), "embed": np.zeros_like(self.w["embed"])}
        back = p @ self.w["out"].T
        for i, k in enumerate(WIDTHS):
            where, alive = kept[i]
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * alive
            own = np.zeros_like(self.w[f"f{k}"])
            for j in range(k):
                byte = x[rows[:, None], where + j]
                part = slice(j * DEPTH, (j + 1) * DEPTH)
                own[part] = np.einsum("bf,bfd->df", g, self.w["embed"][byte])
                np.add.at(grads["embed"], byte, g[:, :, None] * self.w[f"f{k}"][part].T[None, at])
            grads[f"f{k}"] = own
        return grads

    def compile(self) -> None:
        """Tables of what pairs of bytes add to each filter, so that a width takes two look-ups at most."""
        self.tables = {}
        for k in WIDTHS:
            one = [self.w["embed"] @ self.w[f"f{k}"][j * DEPTH : (j + 1) * DEPTH] for j in range(k)]
            pairs = [(j, (one[j][:, None] + one[j + 1][None, :]).reshape(-1, FILTERS)) for j in range(0, k - 1, 2)]
            self.tables[k] = pairs, [(k - 1, one[k - 1])] if k % 2 else []

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            peaks = []
            for k in WIDTHS:
                n = WINDOW - k + 1
                twos, ones = self.tables[k]
                z = twos[0][1].take(pair[:, :n], axis=0)
                for j, t in twos[1:]:
                    z += t.take(pair[:, j : j + n], axis=0)
                for j, t in ones:
                    z += t.take(part[:, j : j + n], axis=0)
                peaks.append(np.maximum(z.max(axis=1), 0))
            p = np.concatenate(peaks, axis=1) @ self.w["out"] + self.w["bias"]
            p -= p.max(axis=1, keepdims=True)
            out[at : at + 256] = p - np.log(np.exp(p).sum(axis=1, keepdims=True))
        return out


def held_out(doc_id: Column) -> Column:
    """True for the ids that training never sees; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(documents: DataFrame) -> list[tuple[str, bytes]]:
    """(label, window) of at most SAMPLE labelled documents that aren't held out, EACH windows or fewer of each.

    Only ids are ranked; the texts of the chosen ones are cut into windows where they are. Of rows that share an id, the
    least text stands for all.
    """
    usable = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # a rank that is bounded is taken before the shuffle too, so no task gets all rows of a language
    turns = usable.select("doc_id", "lang").distinct().withColumn("turn", turn).where(F.col("turn") <= SAMPLE)
    ids = turns.orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id").distinct()
    one = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "x.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                x, text, size = windows(*string_buffers(part.column(1)))
                n = np.bincount(text, minlength=part.num_rows)
                nth = np.arange(len(text)) - np.concatenate(([0], np.cumsum(n)))[text]
                chosen = (size >= WINDOW // 4) | (n[text] == 1)
                chosen = np.flatnonzero(chosen & ((nth * EACH // n[text]) != ((nth - 1) * EACH // n[text])))
                rows = pa.array(text[chosen])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(2).take(rows), pa.array([x[k].tobytes() for k in chosen], pa.binary())],
                    names=["doc_id", "lang", "window"],
                )

    return [(r[1], bytes(r[2])) for r in sorted(one.mapInArrow(run, "doc_id long, lang string, window binary").collect())]


def train(documents: DataFrame) -> ByteNet | None:
    """A network trained on the sample; None if there is no labelled row."""
    ship(documents.sparkSession)
    rows = _sample(documents)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    net = ByteNet(labels)
    net.train(np.stack([np.frombuffer(w, np.uint8) for _, w in rows]), np.array([labels.index(lang) for lang, _ in rows]))
    return net


def identify(documents: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of documents."""
    ship(documents.sparkSession)
    frame = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string")).alias("text"),
    )
    if net is None:
        return frame.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.compile()
        names = pa.array([*net.labels, "und"])
        for batch in batches:
            for part in text_slices(batch, most=1 << 20):
                column = part.column(2)
                x, text, size = windows(*string_buffers(column))
                total = np.zeros((part.num_rows, len(net.labels)))
                known = np.zeros(part.num_rows, bool)
                if len(x):
                    np.add.at(total, text, net.log_probabilities(x) * size[:, None])
                    known[text] = True
                    total /= np.maximum(np.bincount(text, size, part.num_rows), 1)[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                score = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
                best = np.where(known, total.argmax(axis=1), len(net.labels))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), names.take(pa.array(best)), pa.array(np.where(known, score, 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return frame.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
