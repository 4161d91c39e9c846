"""Runs of repeated words: periodic stretches of at least four periods, found by a harmonic grid.

A run of period ``q`` and four or more periods equals itself ``q`` words later over at least
``3 * q`` words, so one of the grid positions ``0, 3q, 6q, ..`` lies in that stretch.  Each grid
position is extended both ways by a longest common extension (LCE).  An LCE compares words up to
the next pair of positions that are both in a difference cover (at most ``MODULUS - 1`` words,
and nearly always one or two until they differ); from there the ranks of the sampled suffixes and
a sparse table of range minima over their common prefixes give the rest in constant time.  Only
sampled suffixes are sorted, and only those of texts in which some comparison got that far.

Every text is judged alone, inside the task that reads it: no shuffle, no state between rows.  A
task holds one piece of about a megabyte of text (or one longer text), and the grid is walked in
slices of ``GRID_SLICE`` positions.

Defined results: a null or empty text, or one of white space only, has no words and no runs, four
nulls, and the digests of the empty string.  A null doc_id counts as a number that plants nothing.
Repeated rows give repeated results.  Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paddock.llm import textbytes as tb

#: Every difference modulo 31 occurs between two of these six residues.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
MIN_WORDS, MIN_PERIODS = 6, 4
GRID_SLICE = 1 << 20

_SAMPLED = np.zeros(MODULUS, bool)
_SAMPLED[list(COVER)] = True
#: For a difference: the residue of the first position at which both are in the cover.
_MEET = np.zeros(MODULUS, np.int64)
for _a in COVER:
    for _b in COVER:
        if _a != _b:
            _MEET[(_b - _a) % MODULUS] = _a
_MEET[0] = COVER[0]

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string, n_words bigint, n_kept_words bigint"
)


class SampledSuffixes:
    """Sorted suffixes at the cover positions of some texts, with range minima of their common prefixes.

    ``words`` are codes of all words, text by text, ``offs`` the bounds of the texts.
    """

    def __init__(self, words: np.ndarray, offs: np.ndarray):
        count = len(words)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        at = np.flatnonzero(_SAMPLED[(np.arange(count) - offs[doc]) % MODULUS])
        self.index = np.full(count + 1, -1, np.int64)
        self.index[at] = np.arange(len(at))
        end = offs[doc[at] + 1]
        m = len(at)
        # First names: the words up to the next cover period; a text's end is a word of its own.
        top = int(words.max(initial=0)) + 1
        block = np.empty((m, MODULUS), ">u4")
        for k in range(MODULUS):
            block[:, k] = np.where(at + k < end, words[np.minimum(at + k, count - 1)], top + doc[at])
        _, name = np.unique(block.view(f"V{4 * MODULUS}").ravel(), return_inverse=True)
        levels, width, texts = [name], MODULUS, len(offs) - 1
        while m and levels[-1].max() + 1 < m:
            after = np.minimum(at + width, count)
            tail = np.where(at + width < end, levels[-1][self.index[after]] + texts, doc[at])
            _, name = np.unique(levels[-1] * np.int64(m + texts) + tail, return_inverse=True)
            levels.append(name)
            width *= 2
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        self.rows = [self._neighbours(words, at, end, order, levels)]
        while len(self.rows[-1]) > (half := 1 << (len(self.rows) - 1)):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, words: np.ndarray, at: np.ndarray, end: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix and the next one, by halving widths and then word by word."""
        a, b = at[order[:-1]].copy(), at[order[1:]].copy()
        a_end, b_end = end[order[:-1]], end[order[1:]]
        first = a.copy()
        for k in range(len(levels) - 2, -1, -1):
            live = np.flatnonzero((a < a_end) & (b < b_end))
            same = live[levels[k][self.index[a[live]]] == levels[k][self.index[b[live]]]]
            a[same] += MODULUS << k
            b[same] += MODULUS << k
        live = np.arange(len(a))
        while len(live):
            live = live[(a[live] < a_end[live]) & (b[live] < b_end[live])]
            live = live[words[a[live]] == words[b[live]]]
            a[live] += 1
            b[live] += 1
        return a - first

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at pairs of different cover positions."""
        x, y = self.rank[self.index[a]], self.rank[self.index[b]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            sel = np.flatnonzero(level == k)
            row = self.rows[k]
            out[sel] = np.minimum(row[low[sel]], row[high[sel] - (1 << int(k))])
        return out


def _to_samples(words: np.ndarray, first: np.ndarray, second: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from two positions up to where both are sampled, and which pairs got that far.

    ``first`` < ``second`` in the text from ``start`` to ``end``.
    """
    ahead = (_MEET[(second - first) % MODULUS] - (first - start)) % MODULUS
    ahead = np.minimum(ahead, end - second)
    equal = np.zeros(len(first), np.int64)
    live = np.flatnonzero(ahead > 0)
    while len(live):
        live = live[words[first[live] + equal[live]] == words[second[live] + equal[live]]]
        equal[live] += 1
        live = live[equal[live] < ahead[live]]
    return equal, (equal == ahead) & (second + equal < end)


def _extend(words: np.ndarray, offs: np.ndarray, doc: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """LCE of pairs of positions, each inside the text ``doc``."""
    equal, further = _to_samples(words, first, second, offs[doc], offs[doc + 1])
    rest = np.flatnonzero(further)
    if len(rest):
        used, local = np.unique(doc[rest], return_inverse=True)
        sizes = np.diff(offs)[used]
        sub = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        shift = offs[used] - sub[:-1]
        held = words[np.repeat(shift, sizes) + np.arange(sub[-1])]
        suffixes = SampledSuffixes(held, sub)
        move = equal[rest] - shift[local]
        equal[rest] += suffixes.common(first[rest] + move, second[rest] + move)
    return equal


def _grid(offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (text, position, period) over the harmonic grid of each text."""
    most = np.diff(offs) // MIN_PERIODS
    doc = np.repeat(np.arange(len(most)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (MIN_PERIODS - 1) * period
    points = (np.diff(offs)[doc] - period - 1) // step + 1
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(points)])
    for low in range(0, int(upto[-1]), GRID_SLICE):
        flat = np.arange(low, min(low + GRID_SLICE, int(upto[-1])))
        which = np.searchsorted(upto, flat, "right") - 1
        yield doc[which], offs[doc[which]] + (flat - upto[which]) * step[which], period[which]


def find_runs(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of every run, by start and then period; positions in all words."""
    count = len(words)
    grid = []
    for doc, at, period in _grid(offs):
        hit = np.flatnonzero(words[at] == words[at + period])
        grid.append((doc[hit], at[hit], period[hit]))
    if not grid:
        return np.zeros((0, 3), np.int64)
    doc, at, period = (np.concatenate(x) for x in zip(*grid, strict=True))
    after = _extend(words, offs, doc, at, at + period)
    # Backwards is forwards in the reversed words, where the texts come in reverse, too.
    texts = len(offs) - 1
    before = _extend(words[::-1], count - offs[::-1], texts - 1 - doc, count - at - period, count - at)
    start, end = at - before, at + period + after
    ok = np.flatnonzero(end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period))
    runs = np.unique(np.stack([start[ok], end[ok], period[ok]], 1), axis=0)
    # Multiples of the smallest period end where it ends.
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[fresh]
    return runs[np.lexsort([runs[:, 2], runs[:, 0]])]


def _planted(ids: list[int | None], offs: np.ndarray) -> np.ndarray:
    """For each word the number of the word that stands there: some texts repeat their tail."""
    take = np.arange(offs[-1])
    for k, i in enumerate(ids):
        n = int(offs[k + 1] - offs[k])
        if i is None or n == 0 or (h := zlib.crc32(str(i).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        take[offs[k] + a : offs[k + 1]] = offs[k] + a + np.arange(n - a) % p
    return take


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    size = end - start
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    held = data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto), pa.py_buffer(held)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words one after another, each followed by a space, and where each starts."""
    size = end - start + 1
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    padded = np.append(data, np.uint8(0x20))
    out = padded[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
    out[upto[1:] - 1] = 0x20
    return out.tobytes(), upto


def describe(ids: list[int | None], data: np.ndarray, offs: np.ndarray, plant: bool) -> list[pa.Array]:
    """The columns of ``SCHEMA`` after doc_id for the texts of a flat byte array."""
    texts = len(offs) - 1
    start, end, doc = tb.spans(data, offs, tb.SPACE)
    bounds = np.searchsorted(doc, np.arange(texts + 1))
    take = _planted(ids, bounds) if plant else np.arange(len(doc))
    words = _codes(data, start, end)[take] if len(doc) else np.zeros(0, np.int64)
    runs = find_runs(words, bounds)
    of = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    n_runs = np.bincount(of, minlength=texts).astype(np.int64)

    length = runs[:, 1] - runs[:, 0]
    order = np.lexsort([runs[:, 2], runs[:, 0], -length, of])
    best = order[np.unique(of[order], return_index=True)[1]]
    none = n_runs == 0
    at = np.zeros(texts, np.int64)
    at[of[best]] = best
    pick = lambda x: pa.array(x[at] if len(x) else np.zeros(texts, np.int64), pa.int64(), mask=none)

    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    stay = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    text, upto = _joined(data, start[take[stay]], end[take[stay]])
    cut = upto[np.searchsorted(stay, bounds)]
    from_ = np.searchsorted(of, np.arange(texts + 1))
    local = runs[:, 0] - bounds[of]
    lines = [f"{s},{n},{q}\n" for s, n, q in zip(local.tolist(), length.tolist(), runs[:, 2].tolist(), strict=True)]
    return [
        pa.array(n_runs), pick(local), pick(length), pick(runs[:, 2]),
        pick(1000 * length // np.maximum(runs[:, 2], 1)),
        pa.array([hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(from_[:-1], from_[1:], strict=True)], pa.string()),
        pa.array([hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string()),
        pa.array(np.diff(bounds)), pa.array(np.bincount(doc[stay], minlength=texts).astype(np.int64)),
    ]


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False) -> DataFrame:
    """Number of runs, the longest one and digests of every text; see ``SCHEMA`` for the columns.

    With ``plant``, a tenth of the texts (by a checksum of the id) first get a tail that repeats itself.
    """
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.pieces(batches, "text"):
            columns = describe(rows.column(0).to_pylist(), data, offs, plant)
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names)

    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(judge, SCHEMA)


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with only the first period of every run left in their text.

    Texts without a run stay as they are; in the others the kept words are joined by one space.  A
    null text stays null.  All other columns pass through, whatever their names.
    """
    schema = docs.select("*").schema
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in tb.pieces(iter([pa.RecordBatch.from_arrays([batch.column(at)], ["t"])]), "t"):
                old = rows.column(0)
                start, end, doc = tb.spans(data, offs, tb.SPACE)
                bounds = np.searchsorted(doc, np.arange(len(old) + 1))
                runs = find_runs(_codes(data, start, end) if len(doc) else np.zeros(0, np.int64), bounds)
                drop = np.zeros(len(doc) + 1, np.int64)
                np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                np.add.at(drop, runs[:, 1], -1)
                stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                joined, upto = _joined(data, start[stay], end[stay])
                cuts = upto[np.searchsorted(stay, bounds)]
                has = np.zeros(len(old), bool)
                has[doc[runs[:, 0]]] = True
                yield pa.array([joined[cuts[k] : cuts[k + 1] - 1].decode() if has[k] else old[k].as_py() for k in range(len(old))], pa.string())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = pa.concat_arrays(list(cut(iter([batch]))))
                yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(whole, schema)
