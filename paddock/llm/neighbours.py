"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Texts become hashed counts of three-byte strings and counts of a few marks of form (words that
repeat the one before, words in repeated pairs, repeated lines, capitals, symbols, bars), damped
and weighted by inverse document frequency over all documents.  A truncated singular value decomposition of a bounded sample of
labelled texts gives the latent space; the sample's vectors are broadcast, every document is
compared with all of them in blocks, and its nearest ones vote, weighted by similarity and by
how many labelled rows of their class each stands for.

Bounds: ``per_class`` labelled rows of each class (a documented bound on what is fitted),
``DIMS`` counts, ``RANK`` dimensions; the model holds 2 * per_class * RANK + DIMS * RANK
floats, whatever the corpus size.  Document frequencies come from all documents.  There is one
scan for them, one for the sample and one to score; only ``DIMS`` sums are shuffled.

Defined results: a null or empty text, or one shorter than three bytes, resembles nothing and
gets the share of label 1 among learning rows; so does every text when no label can be learned
from at all (then 0.5).  If only one class has labels, the score is that class.  Repeated rows
get equal scores; a null doc_id stays null and is not held out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import labelled
from paddock.llm import textbytes as tb

HASHED, FORMS, RANK, NEIGHBOURS, SHARPNESS = 2048, 6, 64, 15, 4
DIMS = HASHED + FORMS
#: What a mark of form weighs beside one three-byte string.
FORM_WEIGHT = 6.0
PER_CLASS = 3000
BLOCK = 2048


def _byte_set(marks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(marks)] = True
    return out


_NEWLINE, _CAPITAL, _SYMBOL, _BAR = map(_byte_set, (b"\n", bytes(range(0x41, 0x5B)), b"#*$%&!", b"|<>"))


def _again(keys: np.ndarray) -> np.ndarray:
    """Flags of keys that occur more than once."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def _forms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of the marks of form, a row for each text."""
    texts = len(offs) - 1
    prefix = tb.prefix_hash(data)
    start, end, doc = tb.spans(data, offs, tb.SPACE)
    words = tb.span_hash(prefix, start, end, data)
    next_too = tb.same_text(doc, 2)
    salt = tb.mix(np.arange(texts, dtype=np.uint64) + np.uint64(1))
    follows = np.flatnonzero(next_too & (words[1:] == words[:-1])) if len(words) else np.zeros(0, int)
    pairs = np.flatnonzero(next_too)
    pairs = pairs[_again(tb.gram_hash(words, doc, 2)[pairs] ^ salt[doc[pairs]])]
    from_, to, of = tb.spans(data, offs, _NEWLINE)
    lines = of[_again(tb.span_hash(prefix, from_, to, data) ^ salt[of])]
    marks = [np.bincount(at, minlength=texts) for at in (doc[follows], doc[pairs], lines)]
    marks += [tb.per_text(flags[data], offs) for flags in (_CAPITAL, _SYMBOL, _BAR)]
    return np.stack(marks, 1).astype(np.float32)


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed three-byte counts and marks of form, a row for each text."""
    texts = len(offs) - 1
    if len(data) < 3:
        return np.zeros((texts, DIMS), np.float32)
    wide = data.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - (HASHED - 1).bit_length())
    length = np.maximum(np.diff(offs) - 2, 0)
    keep = np.zeros(len(data) + 1, np.int32)  # which starts lie inside a text
    np.add.at(keep, offs[:-1], 1)
    np.add.at(keep, offs[:-1] + length, -1)
    inside = np.cumsum(keep[: len(code)]) > 0
    row = np.repeat(np.arange(texts), length)
    hashed = np.bincount(row * HASHED + code[inside], minlength=texts * HASHED).reshape(texts, HASHED)
    return np.concatenate([hashed.astype(np.float32), _forms(data, offs)], 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed string occurs, and how many texts there are."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DIMS + 1, np.int64), 0
        for _, data, offs in tb.pieces(batches, "text"):
            total[:DIMS] += (counts(data, offs) > 0).sum(0)
            total[DIMS] += len(offs) - 1
            seen += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(total)], ["bucket", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(add_up, "bucket int, n bigint")
    out = np.zeros(DIMS + 1, np.int64)
    for bucket, n in sums.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out[:DIMS], int(out[DIMS])


def _latent_axes(x: np.ndarray) -> np.ndarray:
    """The first right singular vectors, by randomised subspace iteration."""
    rank = min(RANK, *x.shape)
    basis = x @ np.random.default_rng(8).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(basis)
        basis = x @ (x.T @ basis)
    basis, _ = np.linalg.qr(basis)
    return np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T


class Voter:
    """Latent space and labelled vectors; small enough to send to every task."""

    def __init__(self, x: np.ndarray, label: np.ndarray, sizes: dict[int, int], idf: np.ndarray):
        self.idf = idf
        self.prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
        self.axes = self.vectors = None
        if len(x):
            x = self._weigh(x)
            self.axes = _latent_axes(x)
            self.vectors = _unit(x @ self.axes)
            held = np.bincount(label, minlength=2)
            self.label = label.astype(np.float64)
            self.weight = np.array([sizes.get(c, 0) / max(held[c], 1) for c in (0, 1)])[label]

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        x = np.log1p(x) * self.idf
        x[:, HASHED:] *= FORM_WEIGHT
        return _unit(x)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        some = x.any(1)
        if self.axes is None or not some.any():
            return out
        mine = _unit(self._weigh(x[some]) @ self.axes)
        near, who = np.zeros((len(mine), 0), np.float32), np.zeros((len(mine), 0), np.int64)
        for at in range(0, len(self.vectors), BLOCK):
            cosine = mine @ self.vectors[at : at + BLOCK].T
            k = min(NEIGHBOURS, cosine.shape[1])
            best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near = np.concatenate([near, np.take_along_axis(cosine, best, 1)], 1)
            who = np.concatenate([who, best + at], 1)
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        near, who = np.take_along_axis(near, best, 1), np.take_along_axis(who, best, 1)
        power = np.maximum(near.astype(np.float64), 1e-6) ** SHARPNESS * self.weight[who]
        out[some] = np.round(np.clip((power * self.label[who]).sum(1) / power.sum(1), 0, 1), 9)
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Voter:
    rows, sizes = labelled.sample(docs, labels, label, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            x = np.minimum(counts(data, offs), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [tb.column(part, "doc_id"), tb.column(part, "label"), pa.array([r.tobytes() for r in x], pa.binary())],
                ["doc_id", "label", "x"],
            )

    held = sorted(map(tuple, rows.mapInArrow(count, "doc_id bigint, label int, x binary").collect()))
    frequency, texts = _frequencies(docs)
    idf = np.log((1 + texts) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    x = np.array([np.frombuffer(r[2], np.uint16) for r in held]).astype(np.float32).reshape(len(held), DIMS)
    keep = x.any(1)
    return Voter(x[keep], np.array([r[1] for r in held], int)[keep], sizes, idf)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, per_class: int = PER_CLASS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, per_class))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            score = model.value.score(counts(data, offs))
            yield pa.RecordBatch.from_arrays(
                [*(tb.column(part, c) for c in ("doc_id", "held_out")), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", labelled.held_out(F.col("doc_id")))
    return rows.mapInArrow(judge, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, per_class: int = PER_CLASS, text: str = "text"
) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, per_class))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, text):
            yield part.filter(pa.array(model.value.score(counts(data, offs)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
