"""Benchmark decontamination by size-partitioned MinHash containment.

A document is contaminated by a test item if it holds at least ``percent`` of the item's
distinct five-word shingles, wherever they stand.  Comparing signatures of whole sets would
lose short items in long documents, so the search works from the items: items are partitioned
by the size of their set, and each partition has its own sketch length m, such that a document
with the asked share must hold one of the m smallest hashes of the item (m is one more than the
shingles that may be missing).  A document is a candidate for the items of which it holds a
sketch hash - none can be missed - and is then verified by exact containment on the whole sets.

The items are the stated query set.  They are taken in blocks of at most ``BLOCK_HASHES``
shingles (or one item), which bounds what is collected and broadcast; each block is one scan of
the documents, without a shuffle.

Defined results: an item or document with fewer than five words, empty or null has no shingle
and matches nothing.  Words are lower-cased in A-Z and split at white space.  Items with equal
texts each match.  Repeated rows of documents give repeated rows; null ids stay null.  Extra
columns of the items are ignored; those of documents stay in ``without_items``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb

WORDS, PERCENT = 5, 80
BLOCK_HASHES = 1 << 21


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their text numbers."""
    low = tb.LOWER[data]
    start, end, doc = tb.spans(low, offs, tb.SPACE)
    grams = tb.gram_hash(tb.span_hash(tb.prefix_hash(low), start, end, low), doc, WORDS)
    inside = tb.same_text(doc, WORDS)
    return grams[inside], doc[: len(grams)][inside]


def sketch_length(size: int, percent: int) -> int:
    """Sketch length of the size partition (powers of two) that ``size`` belongs to."""
    top = (1 << int(size).bit_length()) - 1
    return top - -(-top * percent // 100) + 1


class Block:
    """Sets and sketches of some items, as flat sorted arrays."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        sketches = [s[: sketch_length(len(s), percent)] for s in sets]  # a set is in ascending order
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
        hashes = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.owner = owner[order]
        self.last = np.append(self.first[1:], len(self.owner))

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(text number, item number, shared shingles) of all texts that hold an item."""
        if not len(self.hashes):
            return []
        grams, doc = _grams(data, offs)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == grams)
        out = []
        bounds = np.searchsorted(doc, np.arange(len(offs)))
        for text in np.unique(doc[hit]):
            places = np.unique(at[hit[doc[hit] == text]])
            items = np.unique(np.concatenate([self.owner[self.first[p] : self.last[p]] for p in places]))
            own = np.unique(grams[bounds[text] : bounds[text + 1]])
            for item in items:
                shared = int(np.isin(self.sets[item], own, assume_unique=True).sum())
                if 100 * shared >= self.percent * len(self.sets[item]):
                    out.append((int(text), int(item), shared))
        return out


def item_blocks(items: DataFrame, percent: int) -> Iterator[Block]:
    """The items with at least one shingle, in bounded blocks."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            grams, doc = _grams(data, offs)
            bounds = np.searchsorted(doc, np.arange(len(offs)))
            found = [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [tb.column(part, "item_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                ["item_id", "n", "shingles"],
            )

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(sets, "item_id bigint, n bigint, shingles binary").where("n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = 1 + 2 * int(total) // BLOCK_HASHES
    for k in range(parts if total else 0):
        held = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(parts)) == k)
        got = sorted(((r["item_id"], bytes(r["shingles"])) for r in held.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if got:
            yield Block([r[0] for r in got], [np.frombuffer(r[1], np.uint64) for r in got], percent)


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) of every document and item it holds."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, percent):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, data, offs in tb.pieces(batches, "text"):
                found, b = sent.value.matches(data, offs), sent.value
                ids = tb.column(part, "doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([b.ids[f[1]] for f in found], pa.int64()),
                        pa.array([len(b.sets[f[1]]) for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "n_item_shingles", "n_shared"],
                )

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for block in item_blocks(items, percent):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, data, offs in tb.pieces(batches, text):
                keep = np.ones(part.num_rows, bool)
                keep[[f[0] for f in sent.value.matches(data, offs)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
