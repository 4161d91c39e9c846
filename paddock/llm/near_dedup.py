"""Near duplicates by one-permutation MinHash.

The set of a document is its distinct word shingles.  One hash of each shingle picks a bin and
a value; the smallest value of each bin is the signature, and an empty bin borrows from a bin
drawn by a hash of its own number until that one is filled (optimal densification), the same
way for every set.  Bands of the signature are buckets.  Documents of one bucket are linked to
its centre only (a star), and every candidate edge is confirmed on the two full sets.

How the whole job is done without all pairs:

* Documents with equal sets are one node from the start, so copies cost nothing.
* The centre of a bucket is the node that shares most buckets with others: of many edited
  copies that is the text they come from.
* After components are formed, buckets that still hold several components get a new centre,
  drawn by hash, and its edges to nodes of other components are tested.  Then again.
* Nodes whose buckets are then still divided are compared where they are in different
  components and share one of the rarest shingles of each, which linked sets must.  That is the
  exact way for the rest: a passage shared by many otherwise different texts is never rare.

With 48 bands of 5 bins a pair at similarity 0.8 meets in no bucket with probability 6e-9.

Work: one scan for signatures, one for the sets of documents that share a bucket.  Shuffled are
16 bytes for each distinct document and band, twice, and those sets.

Defined results: a null or empty text, or white space only, has no shingle, is linked with
nothing and kept.  A text of fewer words than a shingle has its whole word sequence as its only
shingle.  A row is known by its doc_id and the hash of its text: rows that repeat a doc_id with
another text are judged for themselves, equal rows alike.  A component is named by its smallest
doc_id and keeps the row of the smallest (doc_id, hash).  A row without doc_id is linked with
nothing, has a null component_id and is kept.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb
from paddock.llm.components import components
from paddock.scratch import Scratch, materialise

BANDS, WIDTH = 48, 5
BINS = BANDS * WIDTH
CENTRE_ROUNDS = 2
_donors: list[np.ndarray] = []


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = tb.LOWER[data]
    start, end, doc = tb.spans(low, offs, tb.SPACE)
    hashes = tb.span_hash(tb.prefix_hash(low), start, end, low)
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    grams = tb.gram_hash(hashes, doc, words)
    out = []
    for at, n in zip(first, count):
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            out.append(tb.gram_hash(hashes[at : at + n], doc[at : at + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _donor(attempt: int) -> np.ndarray:
    while len(_donors) <= attempt:
        bins = np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * (len(_donors) + 1))
        _donors.append((tb.mix(bins) % np.uint64(BINS)).astype(np.int64))
    return _donors[attempt]


def bucket_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket of each band, a row for each set; sets must not be empty."""
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = row * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(slot), bool)  # values ascend within a set, and so do its bins
    first[1:] = slot[1:] != slot[:-1]
    least = np.zeros(len(sets) * BINS, np.uint64)
    filled = np.zeros(len(sets) * BINS, bool)
    least[slot[first]], filled[slot[first]] = values[first], True
    open_ = np.flatnonzero(~filled)
    attempt = 0
    while len(open_):
        giver = open_ - open_ % BINS + _donor(attempt)[open_ % BINS]
        has = filled[giver]
        least[open_[has]] = least[giver[has]]
        open_ = open_[~has]
        attempt += 1
    least = least.reshape(len(sets), BANDS, WIDTH)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for k in range(WIDTH):
        out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
    return out


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            sets = shingle_sets(data, offs, words)
            some = [s for s in sets if len(s)]
            keys = iter(bucket_keys(some).view(np.int64)) if some else iter(())
            digest = np.array([[tb.mix(s).sum(), tb.mix(s ^ np.uint64(0x5DEECE66D)).sum()] for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    tb.column(part, "doc_id"),
                    tb.column(part, "k2"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(digest[:, k].view(np.int64) if len(sets) else [], pa.int64()) for k in (0, 1)),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "k2", "n_shingles", "d1", "d2", "buckets"],
            )

    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            sets = shingle_sets(data, offs, words)
            yield pa.RecordBatch.from_arrays(
                [tb.column(part, "node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the size of the union and whether they are linked; the hub is b."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return found.select("a", "b", (100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).alias("linked"))


def _sharing_rare(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share one of the rarest shingles of each.

    Two linked sets differ in so few shingles that they share one of the n - ceil(n * percent / 100) + 1
    rarest of either, so no link is lost; texts that only share a passage do not meet.  Where they
    first meet in the order of rarity, no more shingles can follow than remain: pairs that cannot
    reach the similarity from there are not formed.
    """
    rows = sets.join(nodes, "node").select("node", "component", "n", F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))  # as many rows as the set
    rare = rows.join(common, "s").withColumn("place", place)
    rare = rare.where((F.col("df") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    several = rare.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("s")
    rare = rare.join(several, "s").select("s", F.col("node").alias("a"), "component", "n", "place")
    other = rare.select("s", F.col("a").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb"))
    enough = (100 + percent) * most >= percent * (F.col("n") + F.col("nb"))
    return rare.join(other, "s").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("cb")) & enough)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _judged(docs: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    """(doc_id, k2, n_shingles, component_id, kept) of every row; k2 is the hash of its text."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), _text_key(docs[text]).alias("k2"), docs[text].cast("string").alias("text"))
    node = F.xxhash64("doc_id", "k2")
    with Scratch(spark, "near") as tmp:
        sketch = tmp.write(rows.mapInArrow(_sketch(words), "doc_id bigint, k2 bigint, n_shingles bigint, d1 bigint, d2 bigint, buckets array<bigint>"))
        named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
        same = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "k2", "n_shingles", "buckets")).alias("r"))
        same = same.select("d1", "d2", "r.*", F.xxhash64("r.doc_id", "r.k2").alias("node"))
        placed = same.select("node", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
        shared = placed.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
        placed = tmp.write(placed.join(shared, "bucket").select("node", "n", "bucket", "held"))
        nodes = placed.groupBy("node").agg(F.sum("held").alias("popular"))
        nodes = tmp.write(nodes)
        sets = rows.where("doc_id IS NOT NULL").select(node.alias("node"), "text").join(nodes.select("node"), "node")
        sets = tmp.write(sets.mapInArrow(_full(words), "node bigint, shingles array<bigint>").dropDuplicates(["node", "shingles"]))
        tested = links = None
        home = nodes.select("node", F.col("node").alias("component"), "popular")
        for turn in range(CENTRE_ROUNDS + 1):
            here = placed.join(home, "node")
            if turn < CENTRE_ROUNDS:
                rank = F.col("popular") if turn == 0 else F.xxhash64("node", F.lit(turn))
                centre = here.groupBy("bucket").agg(
                    F.min("component").alias("lo"), F.max("component").alias("hi"),
                    F.max(F.struct(rank.alias("rank"), (-F.col("node")).alias("minus"), "component", "n")).alias("c"),
                ).where("lo < hi").select("bucket", (-F.col("c.minus")).alias("b"), F.col("c.component").alias("cb"), F.col("c.n").alias("nb"))
                pairs = here.join(centre, "bucket").where("component <> cb").select(F.col("node").alias("a"), "b", "n", "nb")
            else:
                mixed = here.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
                open_ = here.join(mixed.select("bucket"), "bucket").select("node", "component", "n").distinct()
                pairs = _sharing_rare(open_, sets, percent)
            pairs = pairs.where(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")).select("a", "b").distinct()
            if tested is not None:
                done = tested.select("a", "b").union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            now = tmp.write(_confirm(pairs, sets, percent).groupBy("a", "b").agg(F.max("linked").alias("linked")))
            tested = now if tested is None else tested.unionByName(now)
            if not now.where("linked").isEmpty():
                found = now.where("linked").select("a", "b")
                links = found if links is None else links.unionByName(found)
                named_by = components(links, tmp).withColumnRenamed("id", "node")
                home = tmp.write(
                    nodes.join(named_by, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "popular")
                )
        group = same.select("d1", "d2", "doc_id", "k2", "node")
        group = group.join(home.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = group.groupBy("component").agg(F.min(F.struct("doc_id", "k2")).alias("first"))
        group = group.select("d1", "d2", "component").join(first, "component").select("d1", "d2", "first")
        alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
        out = sketch.select("doc_id", "k2", "n_shingles", "d1", "d2").join(group, ["d1", "d2"], "left")
        out = out.select(
            "doc_id", "k2", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
            (alone | (F.struct("doc_id", "k2") == F.col("first"))).alias("kept"),
        )
        return materialise(out, "near-result")


def near_duplicates(
    docs: DataFrame, words: int = 2, percent: int = 80, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; a row is kept if its id is its component's."""
    found = _judged(docs, words, percent, text, key)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns; rows without id or shingles stay.

    It is the first by id, and among rows of that id by a hash of the text; of equal ones one stays.
    """
    found = _judged(docs, words, percent, text, key)
    id_, k2 = docs[key].cast("bigint"), _text_key(docs[text])

    def of(rows: DataFrame) -> Column:
        return (id_ == rows["_id"]) & (k2 == rows["_k2"])

    names = [F.col("doc_id").alias("_id"), F.col("k2").alias("_k2")]
    gone = found.where("NOT kept").select(*names).distinct()
    left = docs.join(gone, of(gone), "left_anti")
    twice = found.where("doc_id IS NOT NULL AND n_shingles > 0 AND kept").groupBy("doc_id", "k2").count().where("count > 1").select(*names)
    if twice.isEmpty():
        return left
    single, again = left.join(twice, of(twice), "left_anti"), left.join(twice, of(twice), "left_semi")
    lowest = again.groupBy(key, text).agg(F.min(F.struct(*[F.lit(0).alias("_"), *(c for c in docs.columns if c not in (key, text))])).alias("_row"))
    return single.unionByName(lowest.select(*[F.col(c) if c in (key, text) else F.col(f"_row.{c}").alias(c) for c in docs.columns]))
