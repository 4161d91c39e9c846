"""Texts of an Arrow batch as one flat byte array, with word bounds and hashes in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  All hashes are 64 bits wide: a
polynomial over bytes modulo 2**64, finished by a bit mixer.  Modulo a power of two some long
regular texts hash alike (a Thue-Morse word of 1,024 letters and its complement do, whatever the
base), so spans of ``LONG_SPAN`` bytes and more are hashed by xxh3 instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a single longer text is handled alone.
PIECE_BYTES = 1 << 20
#: Length from which a span is hashed by itself.
LONG_SPAN = 256
#: Bytes of a block in ``block_hash``.
BLOCK_BYTES = 100

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (a bijection of 64-bit values)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.string())
    empty = b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else ""
    texts = pc.fill_null(texts, empty)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offs = offs.astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES, rows: int = 1024
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text or one row, with their flat bytes and offsets."""
    for batch in batches:
        data, offs = flat(column(batch, text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[k] = out
    up, down = _powers
    if n <= 4 * PIECE_BYTES < len(up):  # a single long text shall not hold its tables for ever
        _powers[:] = [up[: 4 * PIECE_BYTES].copy(), down[: 4 * PIECE_BYTES].copy()]
    return up, down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` takes the hash of any span from it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hash of each span of ``data``, whose running hash is ``prefix``; equal bytes, equal hash."""
    _, down = powers(len(prefix))
    out = mix((prefix[end] - prefix[start]) * down[start])
    long = np.flatnonzero(end - start >= LONG_SPAN)
    view = memoryview(data)
    out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def block_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``span_hash``, with other values: blocks of a span are hashed one by one, in numpy, however long it is."""
    _, down = powers(len(prefix))
    out = (end - start).astype(np.uint64)
    on = np.flatnonzero(end > start)
    at = start[on]
    while len(on):
        to = np.minimum(at + BLOCK_BYTES, end[on])
        out[on] = mix(out[on] * _BASE + (prefix[to] - prefix[at]) * down[at])
        more = np.flatnonzero(to < end[on])
        on, at = on[more], to[more]
    return out


def window_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` bytes in a row, cheaper than ``span_hash`` and with other values."""
    out = prefix[n:] - prefix[:-n]
    _, down = powers(len(prefix))
    out *= down[: len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out


def spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run without ``space``; runs end with their text."""
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def gram_hash(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; windows that leave their text are the caller's to drop."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _BASE
        out += words[k : k + count]
    return mix(out)


def same_text(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from each one lie in one text."""
    count = max(0, len(doc) - n + 1)
    return doc[:count] == doc[n - 1 : n - 1 + count]


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte) for each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
