"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the windows of a text that occurred earlier in
it; the characters of words inside such windows, and inside repeated lines, are measured
against all characters of words.

Every text is judged alone, inside the task that reads it: no shuffle, no state between rows.
A task holds one piece of about a megabyte of text (or one longer text) and some ten times
that in arrays.

Defined results: a null or empty text, or one of white space only, has zero in every count
and is not kept (it has too few words).  Repeated rows give repeated results.  A null doc_id
stays null.  Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paddock.llm import textbytes as tb

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: n-gram length -> largest percentage of word characters in windows seen earlier in the text.
GRAM_PERCENT = {5: 15, 7: 13, 10: 10}
#: Largest percentages of lines, and of word characters, in lines seen earlier in the text.
LINE_PERCENT, LINE_CHAR_PERCENT = 30, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, dup_line_chars bigint, "
    + ", ".join(f"dup_chars_{n} bigint" for n in GRAM_PERCENT)
)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that occur more than once, and of those that occurred earlier."""
    often, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        held = keys[order]
        same = held[1:] == held[:-1]
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        at = np.flatnonzero(often)
        order = at[np.argsort(keys[at], kind="stable")]
        held = keys[order]
        later[order[1:][held[1:] == held[:-1]]] = True
    return often, later


def _covered(at: np.ndarray, n: int, count: int) -> np.ndarray:
    """Flags of the words inside the windows of ``n`` words that start at ``at``."""
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + n, count), -1)
    return np.cumsum(steps[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All counts for each text of a flat byte array."""
    texts = len(offs) - 1
    prefix = tb.prefix_hash(data)
    start, end, doc = tb.spans(data, offs, tb.SPACE)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEAD[data], out=leads[1:])
    chars = leads[end] - leads[start]
    words = tb.span_hash(prefix, start, end, data)
    salt = tb.mix(np.arange(texts, dtype=np.uint64) + np.uint64(1))

    def total(value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=value, minlength=texts).astype(np.int64)

    out = {
        "n_words": np.bincount(doc, minlength=texts).astype(np.int64),
        "word_chars": total(chars, doc),
        "n_symbols": tb.per_text(_SYMBOL[data], offs),
    }

    first = np.flatnonzero(tb.same_text(doc, 3))
    often, _ = _repeats(tb.gram_hash(words, doc, 3)[first] ^ salt[doc[first]])
    first = first[often]
    out["n_repeat_words"] = total(_covered(first, 3, len(words)), doc)
    # A longer window can only repeat where its first three words do.
    for n in GRAM_PERCENT:
        fits = first[first + n <= len(words)]
        fits = fits[doc[fits] == doc[fits + n - 1]]
        key = np.zeros(len(fits), np.uint64)
        for k in range(n):
            key = tb.mix(key + words[fits + k])
        _, later = _repeats(key ^ salt[doc[fits]])
        out[f"dup_chars_{n}"] = total(chars * _covered(fits[later], n, len(words)), doc)

    from_, to, of = tb.spans(data, offs, _NEWLINE)
    at = np.searchsorted(start, from_)
    until = np.searchsorted(start, to)
    has = until > at
    from_, to, of, at, until = from_[has], to[has], of[has], at[has], until[has]
    _, later = _repeats(tb.span_hash(prefix, from_, to, data) ^ salt[of])
    running = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars)])
    out["n_lines"] = np.bincount(of, minlength=texts).astype(np.int64)
    out["n_dup_lines"] = total(later, of)
    out["dup_line_chars"] = total((running[until] - running[at]) * later, of)
    return out


def _verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    bad = 100 * m["n_dup_lines"] > LINE_PERCENT * m["n_lines"]
    bad |= 100 * m["dup_line_chars"] > LINE_CHAR_PERCENT * m["word_chars"]
    for n, percent in GRAM_PERCENT.items():
        bad |= 100 * m[f"dup_chars_{n}"] > percent * m["word_chars"]
    return failed, ~failed & ~bad


def repetition_rules(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and verdict of every text; see ``SCHEMA`` for the columns."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.pieces(batches, "text"):
            m = measure(data, offs)
            failed, kept = _verdict(m)
            names = [c.strip().split()[0] for c in SCHEMA.split(",")]
            given = {"doc_id": rows.column(0), "base_failed": pa.array(failed), "kept": pa.array(kept)}
            yield pa.RecordBatch.from_arrays([given.get(n, pa.array(m[n]) if n in m else None) for n in names], names)

    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(judge, SCHEMA)
