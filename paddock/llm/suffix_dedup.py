"""Removal of repeated strings by a distributed difference-cover suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else.  Whether
a string repeats shows in suffix order: suffixes with the same first ``length`` bytes stand
together, so each need only be compared with its neighbour.  The steps are those of the
difference-cover algorithm, with two changes that keep the work near the repeated text:

1. *Candidates.*  Of the ``GRAM``-byte strings inside every ``length`` bytes the one with the
   smallest hash is noted.  Where it occurs once in the corpus the ``length`` bytes cannot repeat;
   nothing else is left out.  All later steps see candidate stretches only.
2. *Sampled suffixes.*  The cover is defined by content instead of position modulo three:
   positions whose ``ANCHOR``-byte hash is the least of some ``REACH`` positions in a row.  Equal
   strings have equal samples wherever they start, and no gap exceeds ``REACH``.  Samples are
   named by the rank of the bytes that fix the next sample.
3. *Triples.*  Names of three samples in a row are sorted and numbered; the numbers are the next
   names, and the step repeats on them (three samples, nine) until every name that occurs
   twice spans what step 4 needs.  That is the order of sampled suffixes, as far as needed.
4. *Remaining suffixes* are merged by (bytes before the next content-defined sample, rank of that
   sample's suffix), sorted, and their prefixes of ``length`` bytes compared with the neighbour's.
   First the suffixes that start ``REACH`` - 1 bytes before a sample: between two of them that
   repeat, all bytes are covered, and the gap is settled.  Then all other candidate positions in
   gaps that are not.  Their partners may lie in settled gaps, which then take part too: those
   that end in the same bytes as an open gap does, one of each set of gaps with equal bytes.

Names and prefixes are sorted as distinct values with counts, so a text copied into a third of
all documents is one value; only joins meet all its rows, and joins can be split.  Sorts are
range-partitioned; names are partition number and row number of the sorted table.  Tasks lay the
texts of a piece end to end, so the arrays are as long as a piece or one longer text.  Prefixes are
compared by 64-bit hashes within equal 64-bit hashes of the bytes before the sample.

Defined results: a null or empty text has no bytes and keeps nothing (the hash of no bytes); a
text shorter than ``length`` keeps all.  Rows with equal id and text are documents of their own,
so all their strings of ``length`` bytes go.  Null ids are allowed.  Extra columns are ignored,
and stay in ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb
from paddock.scratch import Scratch, materialise

LENGTH = 400


class Sizes:
    """Lengths that follow from the length of repeated strings."""

    def __init__(self, length: int):
        self.length = length
        self.gram = length * 4 // 5
        self.anchor = min(32, length // 10)
        self.reach = (length - self.anchor) * 3 // 10
        # Order counts this far behind a sample, as the bytes before it are compared for themselves.
        self.needed = length - self.reach + 1
        # Bytes that fix the next sample; and nine samples in a row, however dense, span what is needed.
        self.fixes = max(2 * self.reach + self.anchor + 1, self.needed - 8)
        if self.reach < 2 or 3 * self.reach + self.anchor > length:
            raise ValueError("length is too short")


def _least(values: np.ndarray, width: int, how=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = how(out[:-step], out[step:])
        have += step
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _keys(docs: DataFrame) -> DataFrame:
    """Rows with (k1, k2): id and hash of the text, equal only for equal rows."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _notes(sizes: Sizes):
    """Noted hashes of documents with the starts they stand for, twice if several positions in a row have the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            count = len(data) - sizes.gram + 1
            if count <= sizes.length - sizes.gram:
                continue
            h = tb.window_hash(tb.prefix_hash(data), sizes.gram)
            width = sizes.length - sizes.gram + 1
            least = _least(h, width)  # for each start of a string of ``length`` bytes
            fits = np.flatnonzero(np.diff(offs) >= sizes.length)
            valid = _covered(offs[fits], offs[fits + 1] - sizes.length + 1, len(least))
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
            new[offs[fits]] = True
            lo = np.flatnonzero(new & valid)
            ends = np.flatnonzero(np.append((new | ~valid)[1:], True) & valid)
            doc = _text_of(lo, offs)
            # A position is noted if it is the least of some valid window; windows in a row with equal leasts are one row.
            least[~valid] = 0
            pad = np.zeros(width - 1, np.uint64)
            at = np.flatnonzero(h == _least(np.concatenate([pad, least, pad]), width, np.maximum))
            own = _text_of(at, offs)
            at = at[(np.diff(offs) >= sizes.length)[own] & (at + sizes.gram <= offs[own + 1])]
            own = _text_of(at, offs)
            first = np.flatnonzero(np.append(True, (h[at[1:]] != h[at[:-1]]) | (own[1:] != own[:-1]))) if len(at) else at
            row = np.repeat(np.arange(len(lo)), np.minimum(np.diff(np.append(first, len(at))), 2))
            note, lo, ends, doc = least[lo[row]], lo[row], ends[row], doc[row]
            place = [tb.column(part, k).take(pa.array(doc)) for k in ("k1", "k2")]
            place += [pa.array((x - offs[doc]).astype(np.int32)) for x in (lo, ends)]
            place = pa.StructArray.from_arrays(place, ["k1", "k2", "lo", "hi"])
            yield pa.RecordBatch.from_arrays([pa.array(note.view(np.int64)), place], ["note", "place"])

    return run


def _samples(data: np.ndarray, offs: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of texts laid end to end, and the running hash."""
    prefix = tb.prefix_hash(data)
    if len(data) < sizes.anchor + sizes.reach - 1:
        return np.zeros(0, np.int64), prefix
    h = tb.window_hash(prefix, sizes.anchor)
    least = _least(h, sizes.reach)
    # Windows that leave their text count for nothing.
    span = sizes.anchor + sizes.reach - 1
    fits = np.diff(offs) >= span
    least[~_covered(offs[:-1][fits], offs[1:][fits] - span + 1, len(data))[: len(least)]] = 0
    pad = np.zeros(sizes.reach - 1, np.uint64)
    at = np.flatnonzero(h == _least(np.concatenate([pad, least, pad]), sizes.reach, np.maximum))
    doc = _text_of(at, offs)
    return at[fits[doc] & (at + sizes.anchor <= offs[doc + 1])], prefix


def _text_of(at: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, "right") - 1


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Flags of the ``n`` positions that lie in any [lo, hi)."""
    return np.cumsum(np.bincount(lo, minlength=n + 1)[:n] - np.bincount(hi, minlength=n + 1)[:n]) > 0


def _rows(batch: pa.RecordBatch):
    """(row number, bytes of the text) of a batch."""
    data, offs = tb.flat(tb.column(batch, "text"))
    for k in range(batch.num_rows):
        yield k, data[offs[k] : offs[k + 1]]


def _ints(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.asarray(tb.column(batch, name)[k].values.to_numpy(zero_copy_only=False), np.int64)


def _flat_ints(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column, and the row of each."""
    lists = tb.column(batch, name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in tb.pieces(batches, "text"):
        yield part


def _lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Lists of ``values``, which stand in the order of their rows."""
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values).cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), flat)


def _candidates(part: pa.RecordBatch, offs: np.ndarray, more: int = 1) -> np.ndarray:
    """Flags of candidate starts; of all bytes that ``more`` bytes from them on cover."""
    (lo, row), (hi, _) = _flat_ints(part, "lo"), _flat_ints(part, "hi")
    return _covered(lo + offs[row], hi + more + offs[row], int(offs[-1]))


def _sampled(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, sizes: Sizes):
    """Samples in candidate stretches, their texts, the hashes of the bytes that name them, and the running hash."""
    at, prefix = _samples(data, offs, sizes)
    at = at[_candidates(part, offs, sizes.length)[at]]
    doc = _text_of(at, offs)
    return at, doc, tb.block_hash(prefix, at, np.minimum(at + sizes.fixes, offs[doc + 1])), prefix


def _parse(sizes: Sizes):
    """Samples of each document's candidate stretches, their bytes' hashes, and the first suffixes to test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            at, doc, word, prefix = _sampled(part, data, offs, sizes)
            before = np.maximum(at - sizes.reach + 1, offs[doc])
            head = tb.span_hash(prefix, before, at, data)
            test = np.flatnonzero((before == at - sizes.reach + 1) & _candidates(part, offs)[before])
            p, row = before[test], doc[test]
            gap = np.zeros(len(p), np.uint64)
            on = np.flatnonzero(row[1:] == row[:-1])
            gap[on] = tb.block_hash(prefix, p[on], p[on + 1] + sizes.length)
            of = test - np.searchsorted(doc, row)
            rows, small, big = part.num_rows, pa.int32(), pa.int64()
            cols = [
                tb.column(part, "seq"), _lists(at - offs[doc], doc, rows, small), _lists(word, doc, rows, big), _lists(head, doc, rows, big),
                _lists(of, row, rows, small), _lists(tb.block_hash(prefix, p, p + sizes.length), row, rows, big), _lists(gap, row, rows, big),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["seq", "at", "word", "head", "of", "digest", "gap"])

    return run


def _words(sizes: Sizes):
    """Distinct bytes behind the samples of a piece of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            at, doc, word, _ = _sampled(part, data, offs, sizes)
            word, first = np.unique(word, return_index=True)
            ends = np.minimum(at + sizes.fixes, offs[doc + 1])[first]
            raw = data.tobytes()
            found = [raw[a:b] for a, b in zip(at[first].tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(found, pa.binary())], ["word", "bytes"])

    return run


def _numbered(df: DataFrame, *by: str) -> DataFrame:
    """Adds ``name``, ascending in ``by``; valid once written."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() + 1)


def _in_order(rows: DataFrame, *cols: str) -> DataFrame:
    """Arrays of ``cols`` of each sequence, in the order of ``j``."""
    held = F.sort_array(F.collect_list(F.struct("j", *cols)))
    return rows.groupBy("seq").agg(held.alias("r")).select("seq", *(F.col(f"r.{c}").alias(c) for c in cols))


def _suffix_ranks(parse: DataFrame, words: DataFrame, sizes: Sizes, tmp: Scratch) -> DataFrame:
    """(seq, at, name): samples of each document with the ranks of their suffixes."""
    names = tmp.write(_numbered(words.groupBy("word").agg(F.first("bytes").alias("bytes")), "bytes").select("word", "name"))
    rows = parse.select("seq", F.posexplode(F.arrays_zip("at", "word")).alias("j", "r")).select("seq", "j", "r.at", "r.word")
    now = tmp.write(_in_order(rows.join(names.hint("shuffle_hash"), "word"), "at", "name"))
    tmp.drop(names)
    step = 1
    while True:

        def later(column: str, by: int) -> str:
            return f"concat(slice({column}, {by + 1}, size({column})), array_repeat(cast(0 as {'int' if column == 'at' else 'bigint'}), least({by}, size({column}))))"

        zipped = F.arrays_zip(
            F.col("at"), F.col("name").alias("a"), F.expr(later("name", step)).alias("b"), F.expr(later("name", 2 * step)).alias("c"),
            F.expr(later("at", 3 * step - 1)).alias("last"),
        )
        rows = now.select("seq", F.posexplode(zipped).alias("j", "r")).select("seq", "j", "r.at", "r.a", "r.b", "r.c", "r.last")
        # A sequence that ends inside the triple differs from any that goes on: it spans enough.
        reach = F.when(F.col("last") == 0, F.lit(1 << 30)).otherwise(F.col("last") + sizes.fixes - F.col("at"))
        triples = rows.withColumn("reach", reach).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("reach").alias("reach"))
        triples = tmp.write(_numbered(triples, "a", "b", "c"))
        rows = rows.select("seq", "j", "at", "a", "b", "c").join(triples.select("a", "b", "c", "name").hint("shuffle_hash"), ["a", "b", "c"])
        after = tmp.write(_in_order(rows, "at", "name"))
        done = triples.where((F.col("n") > 1) & (F.col("reach") < sizes.needed)).isEmpty()
        tmp.drop(now)
        tmp.drop(triples)
        now, step = after, 3 * step
        if done:
            return now


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, those whose prefix the one before or after has too; and the first and last of the task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: tuple[int, int, bool] | None = None  # the last row so far: head, digest, already given
    first: tuple[int, int] | None = None

    def given(head: list, digest: list, edge: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        cols = (head, digest, edge, [part] * len(head))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["head", "digest", "edge", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        head, digest, n = (tb.column(batch, c).to_numpy() for c in ("head", "digest", "n"))
        if first is None:
            first = (int(head[0]), int(digest[0]))
        same = (head[1:] == head[:-1]) & (digest[1:] == digest[:-1])
        found = n > 1
        found[1:] |= same
        found[:-1] |= same
        out = []
        if held is not None and held[:2] == (head[0], digest[0]):
            found[0] = True
            out = [held]
        at = np.flatnonzero(found)
        yield given([*(h[0] for h in out), *head[at].tolist()], [*(h[1] for h in out), *digest[at].tolist()], [0] * (len(at) + len(out)))
        held = (int(head[-1]), int(digest[-1]), bool(found[-1]))
    if first is not None:
        yield given([first[0], held[0]], [first[1], held[1]], [1, 2])


def _repeated(tests: DataFrame, partners: DataFrame, tmp: Scratch) -> DataFrame:
    """(seq, starts): starts of tested suffixes (seq, p, head, rank, digest) whose prefix occurs twice among all partners."""
    values = partners.groupBy("head", "rank", "digest").agg(F.count("*").alias("n"))
    order = values.repartitionByRange("head", "rank").sortWithinPartitions("head", "rank", "digest")
    found = tmp.write(order.mapInArrow(_neighbours, "head bigint, digest bigint, edge int, part int"))
    edges = sorted((r["part"], r["edge"], r["head"], r["digest"]) for r in found.where("edge > 0").collect())  # two for each task of the sort
    across = [(a[2], a[3]) for a, b in zip(edges, edges[1:]) if a[1] == 2 and b[1] == 1 and a[2:] == b[2:]]
    twice = found.where("edge = 0").select("head", "digest")
    if across:
        twice = twice.union(tests.sparkSession.createDataFrame(across, "head bigint, digest bigint"))
    hit = tests.select("seq", "p", "head", "digest").join(twice.distinct().hint("shuffle_hash"), ["head", "digest"])
    out = tmp.write(hit.groupBy("seq").agg(F.sort_array(F.collect_set("p")).alias("starts")))
    tmp.drop(found)
    return out


def _open_starts(part: pa.RecordBatch, offs: np.ndarray, sizes: Sizes):
    """Flags of candidate starts in open gaps; tested starts and their rows, which gaps behind them are settled, and samples."""
    starts = _candidates(part, offs)
    at, doc = _flat_ints(part, "at")
    at += offs[doc]
    of, row = _flat_ints(part, "of")
    tested = at[of + np.searchsorted(doc, row)] - sizes.reach + 1
    p, of_start = _flat_ints(part, "starts")
    known = np.zeros(len(starts), bool)
    known[p + offs[of_start]] = True
    hit = known[tested]
    settled = hit[:-1] & hit[1:] & (np.diff(tested) <= sizes.length) & (row[:-1] == row[1:])
    i = np.flatnonzero(settled)
    starts &= ~_covered(tested[i], tested[i + 1], len(starts))
    starts[tested] = False
    return starts, tested, row, settled, at


def _by_length(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows whose candidate stretches end within ``PIECE_BYTES`` bytes in all (or one row), and where each row begins."""
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        hi, row = _flat_ints(batch, "hi")
        np.maximum.at(n, row, hi + sizes.length)
        offs = np.concatenate([[0], np.cumsum(n)])
        k = 0
        while k < batch.num_rows:
            to = max(k + 1, int(np.searchsorted(offs, offs[k] + tb.PIECE_BYTES, "right")) - 1)
            yield batch.slice(k, to - k), offs[k : to + 1] - offs[k]
            k = to


def _gaps(sizes: Sizes):
    """What open gaps end in (kind 0: head), and the settled gaps (kind 1: each head, hash of the gap, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offs in _by_length(batches, sizes):
            starts, tested, row, settled, at = _open_starts(part, offs, sizes)
            head, doc = _flat_ints(part, "head")
            ends = np.unique(np.searchsorted(at, np.flatnonzero(starts) + sizes.reach - 1))
            # The starts in a gap end in any sample up to the gap's last.
            of, i = _flat_ints(part, "of")[0], np.flatnonzero(settled)
            i = np.repeat(i, of[i + 1] - of[i])
            ending = np.arange(len(i)) - np.searchsorted(i, i) + of[i] + 1 + np.searchsorted(doc, row[i])
            none = np.zeros(len(ends), np.int64)
            seq = tb.column(part, "seq").to_numpy()
            cols = (
                np.repeat([0, 1], [len(ends), len(i)]), np.append(head[ends], head[ending]), np.append(none, _flat_ints(part, "gap")[0][i]),
                np.append(seq[doc[ends]], seq[row[i]]), np.append(none, i - np.searchsorted(row, row[i])),
            )
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) for c, t in zip(cols, types)], ["kind", "head", "gap", "seq", "i"])

    return run


def _beside(sizes: Sizes, partners: bool):
    """Suffixes at the candidate starts of open gaps, and of the settled gaps that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            starts, tested, row, _, at = _open_starts(part, offs, sizes)
            if partners:
                i, of_gap = _flat_ints(part, "gaps")
                i += np.searchsorted(row, of_gap)
                starts |= _covered(tested[i] + 1, tested[i + 1], len(starts))
            p = np.flatnonzero(starts)
            doc, of = _text_of(p, offs), np.searchsorted(at, p + sizes.reach - 1)
            prefix = tb.prefix_hash(data)
            cols = (
                tb.column(part, "seq").to_numpy()[doc], p - offs[doc], tb.span_hash(prefix, p, at[of], data).view(np.int64),
                _flat_ints(part, "name")[0][of], tb.block_hash(prefix, p, p + sizes.length).view(np.int64),
            )
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) for c, t in zip(cols, kinds)], ["seq", "p", "head", "rank", "digest"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, starts): sorted starts of repeated strings, for the documents that have any.

    Between the starts listed, others may repeat; they add no byte to the strings at the listed ones.
    """
    sizes = Sizes(length)
    rows = _keys(docs)
    with Scratch(docs.sparkSession, "suffix") as tmp:
        schema = "note bigint, place struct<k1: bigint, k2: bigint, lo: int, hi: int>"
        notes = rows.select("k1", "k2", "text").mapInArrow(_notes(sizes), schema).repartition("note")
        # Counted from the very columns that are joined, so Spark reads the texts and moves the notes once for both.
        often = notes.groupBy("note").agg(F.count("place").alias("n")).where("n > 1")
        ranges = notes.join(often.select("note").hint("shuffle_hash"), "note").select("place.*")
        ranges = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
        ranges = tmp.write(ranges.select("k1", "k2", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")))
        held = tmp.write(rows.drop("doc_id").join(ranges, ["k1", "k2"]).withColumn("seq", F.monotonically_increasing_id()))
        tmp.drop(ranges)
        text = held.select("seq", "text", "lo", "hi")
        schema = "seq bigint, at array<int>, word array<bigint>, head array<bigint>, of array<int>, digest array<bigint>, gap array<bigint>"
        parse = tmp.write(text.mapInArrow(_parse(sizes), schema))
        words = text.mapInArrow(_words(sizes), "word bigint, bytes binary")
        ranks = _suffix_ranks(parse.select("seq", "at", "word"), words, sizes, tmp)

        def of_sample(column: str):
            return F.transform("of", lambda i: F.get(column, i))

        first = parse.join(ranks.select("seq", "name"), "seq").select(
            "seq",
            F.explode(
                F.arrays_zip(of_sample("at").alias("s"), of_sample("head").alias("head"), of_sample("name").alias("rank"), "digest")
            ).alias("r"),
        )
        first = first.select("seq", (F.col("r.s") - sizes.reach + 1).alias("p"), "r.head", "r.rank", "r.digest")
        starts = _repeated(first, first, tmp)
        no = F.array().cast("array<int>")
        known = parse.join(starts, "seq", "left").withColumn("starts", F.coalesce("starts", no))
        gaps = known.select("seq", "at", "head", "of", "gap", "starts").join(held.select("seq", "lo", "hi"), "seq")
        gaps = tmp.write(gaps.mapInArrow(_gaps(sizes), "kind int, head bigint, gap bigint, seq bigint, i int"))
        asked = gaps.where("kind = 0").select("head").distinct()
        taking = gaps.where("kind = 1").join(asked.hint("shuffle_hash"), "head", "left_semi").groupBy("gap").agg(F.min(F.struct("seq", "i")).alias("r"))
        taking = taking.groupBy("r.seq").agg(F.collect_list("r.i").alias("gaps"))
        known = known.select("seq", "at", "of", "starts").join(ranks.select("seq", "name"), "seq").join(taking, "seq", "left")
        known = tmp.write(known.withColumn("gaps", F.coalesce("gaps", no)))
        for old in (gaps, ranks, parse):
            tmp.drop(old)
        beside = text.join(known, "seq")
        schema = "seq bigint, p int, head bigint, rank bigint, digest bigint"
        others = _repeated(beside.mapInArrow(_beside(sizes, False), schema), beside.mapInArrow(_beside(sizes, True), schema), tmp)
        found = starts.unionByName(others).select("seq", F.explode("starts").alias("p")).groupBy("seq").agg(F.collect_list("p").alias("p"))
        found = held.select("seq", "k1", "k2").join(found, "seq").groupBy("k1", "k2")
        return materialise(found.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("p")))).alias("starts")), "repeats")


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` at sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.append(True, starts[1:] > starts[:-1] + length)
    return starts[new], np.append(starts[:-1][new[1:]], starts[-1]) + length


def _kept(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    keep = np.ones(len(data), bool)
    for a, b in zip(lo, hi):
        keep[a:b] = False
    return data[keep].tobytes()


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out = []
            for k, data in _rows(part):
                lo, hi = _spans(_ints(part, "starts", k), length)
                out.append((int((hi - lo).sum()), len(lo), hashlib.sha256(_kept(data, lo, hi)).hexdigest()))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([tb.column(part, "k1"), tb.column(part, "k2"), *cols], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])

    found = repeats(docs, length)
    rows = _keys(docs)
    # Equal rows have equal results: one of them stands for all.
    cut = rows.drop("doc_id").join(found, ["k1", "k2"]).mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    cut = cut.dropDuplicates(["k1", "k2"])
    own = rows.select("doc_id", "k1", "k2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    zero = F.lit(0).cast("bigint")
    return own.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without repeated strings, with all their columns.

    A character of which a cut leaves only some bytes goes too.  Texts without repeats, nulls
    included, are untouched.
    """

    mark = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in tb.pieces(batches, text):
            values = tb.column(part, text).to_pylist()
            starts = tb.column(part, mark + "starts")
            for k in range(part.num_rows):
                if starts[k].is_valid:
                    raw = np.frombuffer(values[k].encode(), np.uint8)
                    values[k] = _kept(raw, *_spans(np.asarray(starts[k].values.to_numpy(zero_copy_only=False), np.int64), length)).decode(errors="ignore")
            at = part.schema.get_field_index(text)
            part = part.set_column(at, part.schema.field(at).name, pa.array(values, part.schema.field(at).type))
            yield part.select([c for c in part.schema.names if c != mark + "starts"])

    plain = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    found = repeats(plain, length).select(*[F.col(c).alias(mark + c) for c in ("k1", "k2", "starts")])
    mine = F.coalesce(docs[key].cast("bigint"), F.lit(-(1 << 62)))
    hit = (mine == F.col(mark + "k1")) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == F.col(mark + "k2"))
    return docs.join(found, hit, "left").select(*docs.columns, mark + "starts").mapInArrow(run, docs.schema)
