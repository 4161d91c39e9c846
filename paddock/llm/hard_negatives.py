"""Hard negatives by threshold joins over inverted lists that leave out what norms already bound.

Every anchor has a few positives (its best rows of the same label); each positive opens a window of
scores below its own, and the best rows of other labels inside that window are wanted.  A row that
cannot reach an anchor's threshold need not be scored in full: components are taken from the last
to the first, in groups; the leading components of a row are left out of the lists as long as
their norm times the anchor's norm stays under every threshold; after the lists are summed, a
pair lives on only if its partial score plus the norms of what is left reaches the threshold;
only those pairs get their exact score.

Thresholds start high, where an estimate from the mean and variance of an anchor's scores (exact
sums over all rows) expects ``AIMS[0]`` rows in each window, and are lowered for windows that have
not filled, at the end to the window's own lower bound.  The estimate decides how much work is done,
never what comes out.

Rows and anchors are dealt into cells: a cell meets ``1 / splits`` of the rows with one chunk of
anchors, so that every anchor meets every row once and no cell holds more than ``CELL_ROWS`` rows and
``CELL_ANCHORS`` anchors, whatever the sizes of labels.  A cell returns at most the wanted number per
window.  Nothing passes through the driver or a broadcast but counts.

Components are ``floor(scale * x)``, kept as doubles, which hold them exactly; products of norms
below 2**53 keep all sums exact, other cells are summed in Python integers.  A score beyond the
range of a long counts as the nearest long.

Defined results: rows with a null label or vector, or a component that is null, not finite, or not
finite once scaled, take no part.  A shorter vector counts as followed by zeros.  A null id makes no
anchor, and stands after all others in ties.  Repeated rows are rows of their own: each is an anchor,
and a positive or negative of the others.  Anchors without a positive, positives below zero and
windows without a row return nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb
from paddock.scratch import Scratch, materialise_counted

SCALE = 256
N_POSITIVES, N_NEGATIVES = 5, 10
CELL_ROWS, CELL_ANCHORS, LEAST_ROWS = 1 << 16, 1 << 15, 1 << 10
#: Components in a group of the inverted lists; rows and anchors of one block of the score matrix.
GROUP, BLOCK_ROWS, BLOCK_ANCHORS = 8, 2048, 512
#: Rows a window is expected to hold at each threshold; the last round takes the whole window.
AIMS = (30, 300)
_LONG = (1 << 63) - 1

_FOUND = "anchor bigint, positive int, other_id bigint, score bigint"
_SCORED = f"{_FOUND}, n double, total double, squares double"


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, with zeros after shorter ones."""
    held = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = held.flatten().to_numpy(zero_copy_only=False)
    sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Both with as many columns; and whether float sums of their products are exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    with np.errstate(over="ignore"):
        norms = [np.sqrt((x * x).sum(1).max(initial=0.0)) for x in (a, b)]
        return a, b, bool(norms[0] * norms[1] < 2.0**52)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All scores in Python integers, cut to the range of a long."""
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    out = np.zeros((len(a), len(b)), np.int64)
    for i, row in enumerate(whole[0]):
        for j, other in enumerate(whole[1]):
            out[i, j] = max(-_LONG - 1, min(_LONG, sum((x * y for x, y in zip(row, other, strict=True)), 0)))
    return out


def _best(group: np.ndarray, score: np.ndarray, other: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each group, by score downwards and then id."""
    order = np.lexsort([other, -score, group])
    held = group[order]
    first = np.searchsorted(held, held, "left")
    return order[np.arange(len(order)) - first < count]


def _reaching(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose score is at least the anchor's ``least``."""
    rows, anchors, exact = _pair(rows, anchors)
    if not exact:
        score = _exact(rows, anchors)
        i, j = np.nonzero(score >= least[None, :])
        return i, j, score[i, j]
    # Light components first: they are the ones left out of the lists.
    order = np.argsort((rows * rows).sum(0), kind="stable")
    rows, anchors = rows[:, order], anchors[:, order]
    edges = [*range(0, rows.shape[1], GROUP), rows.shape[1]]
    upto = lambda x: np.sqrt(np.stack([np.zeros(len(x)), *[(x[:, :e] ** 2).sum(1) for e in edges[1:]]], 1))
    row_norm, anchor_norm = upto(rows), upto(anchors)
    full = anchor_norm[:, -1]
    floor = least.astype(np.float64)
    reach = np.where(full > 0, floor / np.where(full > 0, full, 1), np.where(floor > 0, np.inf, -np.inf))
    by_reach = np.argsort(-reach, kind="stable")
    out = []
    slack = 1 - 1e-9
    for a in range(0, len(anchors), BLOCK_ANCHORS):
        some = by_reach[a : a + BLOCK_ANCHORS]
        lowest, q, q_norm, t = reach[some].min(), anchors[some], anchor_norm[some], floor[some]
        # Groups of leading components left out: their norm times any anchor's norm stays under its threshold.
        left = np.maximum((row_norm < lowest * slack).sum(1) - 1, 0) if lowest > 0 else np.zeros(len(rows), np.int64)
        by_left = np.argsort(left, kind="stable")
        for r in range(0, len(rows), BLOCK_ROWS):
            part = by_left[r : r + BLOCK_ROWS]
            x, skip = rows[part], left[part]
            score = np.zeros((len(part), len(some)))
            for k in range(len(edges) - 2, -1, -1):
                listed = int(np.searchsorted(skip, k, "right"))
                if listed:
                    score[:listed] += x[:listed, edges[k] : edges[k + 1]] @ q[:, edges[k] : edges[k + 1]].T
            bound = np.zeros_like(score)
            for k in np.unique(skip):
                at = slice(*np.searchsorted(skip, [k, k + 1]))
                bound[at] = np.multiply.outer(row_norm[part[at], k], q_norm[:, k])
            i, j = np.nonzero(score + bound * (1 + 1e-9) >= t[None, :])
            exact_score = score[i, j]
            for k in np.unique(skip[i]):
                at = np.flatnonzero(skip[i] == k)
                for low in range(0, len(at), 1 << 16):
                    at_ = at[low : low + (1 << 16)]
                    exact_score[at_] += np.einsum("ij,ij->i", x[i[at_], : edges[k]], q[j[at_], : edges[k]])
            ok = np.flatnonzero(exact_score >= t[j])
            out.append((part[i[ok]], some[j[ok]], exact_score[ok].astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the largest long for nulls, and which are null."""
    return column.fill_null(_LONG).to_numpy(), column.is_null().to_numpy()


def _table(schema: str, **columns: pa.Array | np.ndarray) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = {c.split()[0]: types[c.split()[1]] for c in schema.split(", ")}
    size = len(next(iter(columns.values())))
    return pa.table({n: pa.array(columns[n], kinds[n]) if n in columns else pa.nulls(size, kinds[n]) for n in names})


def _positives(count: int):
    """Best rows of an anchor's own label in a cell, and sums over its scores with all rows of the cell."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _table(_SCORED, anchor=np.zeros(0, np.int64))
        x, q, exact = _pair(_matrix(rows["vec"]), _matrix(anchors["vec"]))
        uid, anchor = rows["uid"].to_numpy(), anchors["uid"].to_numpy()
        other, null = _ids(rows["vec_id"])
        label, wanted = rows["label"].to_numpy(), anchors["label"].to_numpy()
        by_label = np.argsort(label, kind="stable")
        by_wanted = np.argsort(wanted, kind="stable")
        found = []
        for value in np.unique(wanted):
            mine = by_label[slice(*np.searchsorted(label[by_label], [value, value + 1]))]
            asking = by_wanted[slice(*np.searchsorted(wanted[by_wanted], [value, value + 1]))]
            for a in range(0, len(asking), BLOCK_ANCHORS):
                some = asking[a : a + BLOCK_ANCHORS]
                for r in range(0, len(mine), BLOCK_ROWS):
                    part = mine[r : r + BLOCK_ROWS]
                    score = x[part] @ q[some].T if exact else _exact(x[part], q[some])
                    self_ = uid[part][:, None] == anchor[some][None, :]
                    if len(part) > count + 1:
                        # With the row itself in, one more than the wanted number is enough.
                        enough = np.partition(score, len(part) - count - 1, 0)[len(part) - count - 1]
                        i, j = np.nonzero((score >= enough[None, :]) & ~self_)
                    else:
                        i, j = np.nonzero(~self_)
                    found.append((some[j], part[i], score[i, j].astype(np.int64)))
        j, i, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        keep = _best(j, score, other[i], count)
        j, i, score = j[keep], i[keep], score[keep]
        with np.errstate(over="ignore", invalid="ignore"):
            total = q @ x.sum(0)
            squares = ((q @ (x.T @ x)) * q).sum(1)
        best = _table(_SCORED, anchor=anchor[j], other_id=pa.array(other[i], mask=null[i]), score=score)
        sums = _table(_SCORED, anchor=anchor, n=np.full(len(anchor), float(len(x))), total=total, squares=squares)
        return pa.concat_tables([best, sums])

    return meet


def _negatives(count: int):
    """First rows of other labels in each open window of the anchors of a cell."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _table(_FOUND, anchor=np.zeros(0, np.int64))
        windows = anchors["windows"].combine_chunks()
        of = np.repeat(np.arange(len(anchors)), windows.value_lengths().to_numpy())
        flat = windows.flatten()
        positive, low, high = (flat.field(k).to_numpy() for k in ("positive", "low", "high"))
        least = np.full(len(anchors), _LONG, np.int64)
        np.minimum.at(least, of, low)
        i, j, score = _reaching(_matrix(rows["vec"]), _matrix(anchors["vec"]), least)
        differ = rows["label"].to_numpy()[i] != anchors["label"].to_numpy()[j]
        i, j, score = i[differ], j[differ], score[differ]
        other, null = _ids(rows["vec_id"])
        # Every pair against every open window of its anchor; there are at most N_POSITIVES of them.
        first = np.searchsorted(of, np.arange(len(anchors) + 1))
        size = np.diff(first)[j]
        pair = np.repeat(np.arange(len(j)), size)
        window = np.repeat(first[j] - (np.cumsum(size) - size), size) + np.arange(len(pair))
        fits = (low[window] <= score[pair]) & (score[pair] <= high[window])
        pair, window = pair[fits], window[fits]
        keep = _best(window, score[pair], other[i[pair]], count)
        pair, window = pair[keep], window[keep]
        return _table(
            _FOUND, anchor=anchors["uid"].to_numpy()[of[window]], positive=positive[window],
            other_id=pa.array(other[i[pair]], mask=null[i[pair]]), score=score[pair],
        )

    return meet


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, meet, schema: str) -> DataFrame:
    """Every anchor with every row, cell by cell."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = max(-(-n_rows // CELL_ROWS), min(-(-n_rows // LEAST_ROWS), 4 * cores), 1)
    chunks = max(-(-n_anchors // CELL_ANCHORS), 1)
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("chunk", deal(chunks)).withColumn("split", every(splits))
    right = rows.withColumn("split", deal(splits)).withColumn("chunk", every(chunks))
    return left.groupBy("chunk", "split").cogroup(right.groupBy("chunk", "split")).applyInArrow(meet, schema)


def _prepared(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """Rows that take part: uid, id, label and scaled components."""
    limit = np.finfo(np.float64).max / scale
    good = rows[label].isNotNull() & rows[vector].isNotNull() & F.forall(
        rows[vector].cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(limit)))
    )
    held = rows.where(good).select(
        rows[key].cast("bigint").alias("vec_id"), rows[label].cast("bigint").alias("label"), rows[vector].cast("array<double>").alias("vec")
    )

    def scaled(batches):
        for batch in batches:
            lists = tb.column(batch, "vec")
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(scale))
            sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            vec = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], ["vec_id", "label", "vec"])

    return held.mapInArrow(scaled, "vec_id bigint, label bigint, vec array<double>").select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vec"
    )


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _thresholds(anchors: DataFrame, n_rows: int) -> DataFrame:
    """For each window the threshold of each round: where the normal curve expects so many rows, at least its lower bound."""
    curve = NormalDist()

    def tail(share: float) -> float:
        return -curve.inv_cdf(min(max(share, 1e-15), 1 - 1e-15))

    def add(batches):
        for batch in batches:
            low, high, mean, spread = (tb.column(batch, k).to_pylist() for k in ("low", "high", "mean", "spread"))
            steps = []
            for lo, hi, m, s in zip(low, high, mean, spread, strict=True):
                if s and s == s and s < float("inf"):
                    above = curve.cdf(-(hi - m) / s)
                    steps.append([int(min(max(m + s * tail(above + aim / n_rows), lo), hi)) for aim in AIMS] + [lo])
                else:
                    steps.append([lo] * (len(AIMS) + 1))
            columns = [tb.column(batch, k) for k in ("uid", "positive", "positive_id", "positive_score", "low", "high")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(steps, pa.list_(pa.int64()))], ["uid", "positive", "positive_id", "positive_score", "low", "high", "steps"]
            )

    return anchors.mapInArrow(add, "uid bigint, positive int, positive_id bigint, positive_score bigint, low bigint, high bigint, steps array<bigint>")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
    n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every mined pair.

    ``is_anchor`` is a condition on ``vec_id``.  A positive's window goes from 30 to 90 percent of its score.
    """
    spark = rows.sparkSession
    with Scratch(spark, "negatives") as scratch:
        vectors, n_rows = materialise_counted(_prepared(rows, key, vector, label, scale), "vectors")
        anchors, n_anchors = materialise_counted(vectors.where(is_anchor), "anchors")
        scored = scratch.write(_cells(anchors, vectors, n_anchors, n_rows, _positives(n_positives), _SCORED))
        best = _first(scored.where(F.col("score").isNotNull()).select("anchor", "other_id", "score"), ["anchor"], n_positives)
        sums = scored.where(F.col("n").isNotNull()).groupBy("anchor").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
        tens, ones = F.expr("score div 10"), F.expr("score % 10")
        mean = F.col("total") / F.col("n")
        opened = best.where(F.col("score") >= 0).join(sums, "anchor").select(
            F.col("anchor").alias("uid"), F.col("rank").cast("int").alias("positive"), F.col("other_id").alias("positive_id"),
            F.col("score").alias("positive_score"), (3 * tens + F.floor((3 * ones + 9) / 10)).cast("bigint").alias("low"),
            (9 * tens + F.floor(9 * ones / 10)).cast("bigint").alias("high"), mean.alias("mean"),
            F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("spread"),
        ).where(F.col("low") <= F.col("high"))
        windows, open_ = materialise_counted(_thresholds(opened, n_rows), "windows")
        done = []
        pending = windows
        for step in range(len(AIMS) + 1):
            if not open_:
                break
            asked = pending.groupBy("uid").agg(
                F.collect_list(F.struct("positive", F.col("steps")[step].alias("low"), "high")).alias("windows")
            ).join(anchors.select("uid", "label", "vec"), "uid")
            hits, _ = materialise_counted(
                _first(_cells(asked, vectors, n_anchors, n_rows, _negatives(n_negatives), _FOUND), ["anchor", "positive"], n_negatives), "hits"
            )
            done.append(hits.withColumn("step", F.lit(step)))
            full = hits.groupBy(F.col("anchor").alias("uid"), "positive").agg(F.count("*").alias("n")).where(F.col("n") >= n_negatives)
            short = pending.join(full, ["uid", "positive"], "left_anti").where(F.col("steps")[step] > F.col("low"))
            pending, open_ = materialise_counted(short, "pending")
        if not done:
            none = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
            return spark.createDataFrame([], none)
    found = done[0]
    for other in done[1:]:
        found = found.unionByName(other)
    # Of a window asked again only the last round's rows count.
    last = Window.partitionBy("anchor", "positive")
    found = found.withColumn("last", F.max("step").over(last)).where(F.col("step") == F.col("last"))
    named = anchors.select(F.col("uid"), F.col("vec_id").alias("anchor_id"))
    return found.withColumnRenamed("anchor", "uid").join(windows, ["uid", "positive"]).join(named, "uid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
