"""Toxicity by class-conditional Kneser-Ney models.

Two word models, one of toxic and one of ordinary texts, give every word of a text a
log-likelihood; the difference, divided by the number of words, is the evidence, and a logistic
curve turns it into a score.  Each model interpolates three orders by absolute discounting:

* a word after the word before it: how many different words of the class precede the pair,
* a word after any word: how many different words of the class precede it,
* the first letters of a word: how many different words of the class open with them;

(continuation counts throughout, so that a passage copied into many texts of one class, where
the same words always precede, does not pass for the speech of that class);

below that, all classes share one backoff: how often the whole corpus, labelled or not, uses
the word among words with those first letters.  The words and openings of the class models are
counted exactly, by 64-bit hash, in every document: a grouped table of the model's size.

Bounds: ``per_class`` texts of each class are fitted (a documented bound of the classifier) and
as many are set aside to fit the curve; what does not exceed the discount backs off.  The model is the
grams of those texts, which bounds the broadcast.  One scan of the corpus counts words, one
takes the sample, one scores.

Words are runs of letters: ASCII punctuation, digits and white space separate them, A-Z are
lowered.  Defined results: a null or empty text, or one without words, has no evidence either
way and gets the curve's value at zero evidence.  Without learning rows of both classes every
score is the share of label 1 (0 if there is none at all).  Repeated rows get equal scores; a
null doc_id stays null and is not held out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import labelled
from paddock.llm import textbytes as tb
from paddock.scratch import Scratch

PER_CLASS = 6000
#: Discount of each order and bytes of a word's opening.  The README gives the figures of DISCOUNT and EVEN.
DISCOUNT, HEAD_BYTES = 2, 5
#: Evidence of one word counts beyond EVEN only (what the topics and languages of the two classes
#: do to common words stays below), and up to MOST.
EVEN, MOST = 2.5, 12.0

_NOT_WORD = tb.SPACE.copy()
_NOT_WORD[:0x80] = True
_NOT_WORD[list(b"abcdefghijklmnopqrstuvwxyz")] = False
_OPEN = np.uint64(1)  # stands before the first word of a text


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of its opening, number of its text."""
    low = tb.LOWER[data]
    prefix = tb.prefix_hash(low)
    start, end, doc = tb.spans(low, offs, _NOT_WORD)
    return tb.span_hash(prefix, start, end, low), tb.span_hash(prefix, start, np.minimum(end, start + HEAD_BYTES), low), doc


def _before(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    out[1:] = words[:-1]
    out[:1] = _OPEN
    out[1:][doc[1:] != doc[:-1]] = _OPEN
    return out


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked value among sorted keys, or the number of keys."""
    at = np.searchsorted(keys, asked)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == asked[hit]
    return np.where(hit, at, len(keys))


def shared_counts(docs: DataFrame, words: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often all documents use each of ``words`` and of the openings ``heads`` (sorted hashes)."""
    sent = docs.sparkSession.sparkContext.broadcast((words, heads))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(k) + 1, np.int64) for k in sent.value]
        for _, data, offs in tb.pieces(batches, "text"):
            for t, keys, found in zip(total, sent.value, words_of(data, offs)):
                t += np.bincount(_find(keys, found), minlength=len(t))
        for kind, t in enumerate(total):
            at = np.flatnonzero(t[:-1])
            if len(at):
                cols = [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(t[at])]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "at", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(add_up, "kind int, at bigint, n bigint")
    held = sums.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    kind, at, n = (held[c].to_numpy() for c in ("kind", "at", "n"))
    out = np.zeros(len(words)), np.zeros(len(heads))
    for k, counts in enumerate(out):
        counts[at[kind == k]] = n[kind == k]
    return out


class Grams(NamedTuple):
    """Words (with openings) and their continuation counts by class, contexts with their totals and
    discounted mass, and pairs beyond the discount; words and contexts in the order of their hash."""

    words: np.ndarray
    heads: np.ndarray
    before: np.ndarray
    contexts: np.ndarray
    seen: np.ndarray
    off: np.ndarray
    pair_v: np.ndarray
    pair_w: np.ndarray
    often: np.ndarray


def _grams(rows: DataFrame) -> Grams:
    """Continuation counts of the sample: pairs beyond the discount, words, contexts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            words, heads, doc = words_of(data, offs)
            label = tb.column(part, "label").to_numpy()[doc].astype(np.int32)
            before = _before(words, doc)
            earlier = _before(before, doc)
            _, first = np.unique(_pair(_pair(earlier, before), words) ^ tb.mix(label.astype(np.uint64)), return_index=True)
            cols = [x[first].view(np.int64) for x in (earlier, before, words, heads)] + [label[first]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "v", "w", "h", "label"])

    triples = rows.mapInArrow(each, "u bigint, v bigint, w bigint, h bigint, label int").dropDuplicates()
    by = [F.count(F.when(F.col("label") == c, 1)).alias(f"n{c}") for c in (0, 1)]
    sums = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)]
    sums += [F.sum(F.least(f"n{c}", F.lit(DISCOUNT))).alias(f"d{c}") for c in (0, 1)]

    def held(df: DataFrame, keys: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray | None]:
        got = df.toArrow()
        part = [np.stack([got[f"{x}{c}"].to_numpy().astype(float) for c in (0, 1)]) if f"{x}0" in got.column_names else None for x in "nd"]
        return [got[k].to_numpy().view(np.uint64) for k in keys], *part

    with Scratch(rows.sparkSession, "word-pairs") as tmp:
        pairs = tmp.write(triples.groupBy("v", "w", "h").agg(*by))
        kinds = [F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"n{c}") for c in (0, 1)]
        (w, h), before, _ = held(pairs.groupBy("w", "h").agg(*kinds), "wh")
        (v,), seen, off = held(pairs.groupBy("v").agg(*sums), "v")
        (pv, pw), often, _ = held(pairs.where(F.greatest("n0", "n1") > DISCOUNT).select("v", "w", "n0", "n1"), "vw")
    return Grams(w, h, before, v, seen, off, pv, pw, often)


def _discounted(n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each class after absolute discounting, and what each class leaves to ``below``."""
    total = n.sum(1, keepdims=True)
    spread = np.minimum(n, DISCOUNT).sum(1, keepdims=True) / total
    return np.maximum(n - DISCOUNT, 0) / total + spread * below, spread[:, 0]


class Rater:
    """Log-likelihood differences of known pairs, words and openings, in sorted arrays."""

    def __init__(self, g: Grams, docs: DataFrame):
        order = np.argsort(g.words)
        self.words, head_of, before = g.words[order], g.heads[order], g.before[:, order]
        # Openings: how many different words of the class have each.
        self.heads, opening = np.unique(head_of, return_inverse=True)
        types = np.stack([np.bincount(opening, weights=c > 0, minlength=len(self.heads)) for c in before])
        below = (types.sum(0) + 1) / (types.sum() + len(self.heads) + 1)
        head, spread = _discounted(types, below)
        self.head_llr = np.append(np.log(head[1]) - np.log(head[0]), np.log(spread[1]) - np.log(spread[0]))
        # Words: the shared counts divide an opening's share among its words.
        used, all_used = shared_counts(docs, self.words, self.heads)
        used, all_used = used + 1, all_used[opening] + 2
        word, spread = _discounted(before, head[:, opening] * used / np.maximum(all_used, used))
        self.word_llr = np.log(word[1]) - np.log(word[0])
        self.unseen_llr = float(np.log(spread[1]) - np.log(spread[0]))
        # Pairs, after contexts that the class has.
        order = np.argsort(g.contexts)
        self.contexts, seen = g.contexts[order], g.seen[:, order]
        spread = np.where(seen > 0, g.off[:, order] / np.maximum(seen, 1), 1.0)
        self.context_llr = np.log(spread[1]) - np.log(spread[0])
        at = np.searchsorted(self.contexts, g.pair_v)
        pair = np.maximum(g.often - DISCOUNT, 0) / np.maximum(seen[:, at], 1)
        pair += spread[:, at] * word[:, np.searchsorted(self.words, g.pair_w)]
        key = _pair(g.pair_v, g.pair_w)
        order = np.argsort(key)
        self.pairs, self.pair_llr = key[order], (np.log(pair[1]) - np.log(pair[0]))[order]
        self.slope, self.shift = 1.0, 0.0

    def evidence(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean difference of the log-likelihoods of a text's words."""
        words, heads, doc = words_of(data, offs)
        at = _find(self.words, words)
        llr = np.append(self.word_llr, 0.0)[at]
        new = np.flatnonzero(at == len(self.words))
        llr[new] = self.unseen_llr + self.head_llr[_find(self.heads, heads[new])]
        before = _before(words, doc)
        llr += np.append(self.context_llr, 0.0)[_find(self.contexts, before)]
        hit = _find(self.pairs, _pair(before, words))
        known = np.flatnonzero(hit < len(self.pairs))
        llr[known] = self.pair_llr[hit[known]]
        texts = len(offs) - 1
        llr = np.sign(llr) * np.clip(np.abs(llr) - EVEN, 0, MOST)
        total = np.bincount(doc, weights=llr, minlength=texts)
        return total / np.maximum(np.bincount(doc, minlength=texts), 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40))), 9)


class Constant:
    """Stands in where nothing can be learned."""

    def __init__(self, share: float):
        self.share = share

    def evidence(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.zeros(len(offs) - 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return np.full(len(evidence), self.share)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, lightly held towards a slope of zero."""
    scale = max(float(np.std(x)), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        grad = z.T @ (weight * (y - p)) - np.array([1e-2, 0]) * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-9])
        beta = beta + np.clip(np.linalg.solve(hess, grad), -3, 3)
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Rater | Constant:
    rows, sizes = labelled.sample(docs, labels, label, 2 * per_class)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(2))
    learn, aside = rows.where(fold == 0), rows.where(fold == 1)
    grams = _grams(learn)
    if not len(grams.words) or not grams.before.sum(1).all():
        return Constant(sizes.get(1, 0) / max(sum(sizes.values()), 1))
    model = Rater(grams, docs)
    del grams
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            found = pa.array(sent.value.evidence(data, offs))
            yield pa.RecordBatch.from_arrays([tb.column(part, "doc_id"), tb.column(part, "label"), found], ["doc_id", "label", "x"])

    held = sorted(map(tuple, aside.mapInArrow(rate, "doc_id bigint, label int, x double").collect()))
    sent.destroy()
    y = np.array([r[1] for r in held], float)
    if len(y) and 0 < y.mean() < 1:
        taken = {0: (y == 0).sum(), 1: (y == 1).sum()}
        weight = np.array([sizes[int(c)] / taken[int(c)] for c in y])
        model.slope, model.shift = _curve(np.array([r[2] for r in held]), y, weight * len(y) / weight.sum())
    return model


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, per_class: int = PER_CLASS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, per_class))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in tb.pieces(batches, "text"):
            score = model.value.score(model.value.evidence(data, offs))
            yield pa.RecordBatch.from_arrays(
                [*(tb.column(part, c) for c in ("doc_id", "held_out")), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", labelled.held_out(F.col("doc_id")))
    return rows.mapInArrow(judge, "doc_id bigint, held_out boolean, score double, predicted int")
