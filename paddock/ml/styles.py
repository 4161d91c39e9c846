"""Driver-style clusters, archetypes and coordinates.

Every step is one aggregation over the driver-seasons, and only centres (at most ``clusters``
rows) and a covariance of four features reach the driver.  Ties have fixed rules, so the same rows
give the same clusters under any partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock import fixed
from paddock.functions.scalars import lookup
from paddock.scratch import materialise

CLUSTERS, ITERATIONS = 5, 100
#: Distances are compared on this many digits, so the order in which sums add up decides nothing.
DIGITS = 9
_SCALED = [f"_z{i}" for i in range(len(fixed.STYLE_FEATURES))]


@dataclass(frozen=True)
class StyleModel:
    """Means and deviations of the features, two principal axes, scaled centres and their names."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...]
    centres: dict[int, tuple[float, ...]]
    labels: dict[int, str]

    def scaled(self, features: DataFrame) -> DataFrame:
        """Features with their distance from the mean in deviations; a constant feature is 0."""
        parts = zip(_SCALED, fixed.STYLE_FEATURES, self.means, self.deviations, strict=True)
        return features.withColumns({z: (F.col(f) - m) / d if d > 0 else F.lit(0.0) for z, f, m, d in parts})


def fit_styles(features: DataFrame, clusters: int = CLUSTERS, iterations: int = ITERATIONS) -> StyleModel:
    """Scale, find the two principal axes, and cluster by k-means; k is at most the distinct rows."""
    held = materialise(features, "styles")
    facts = [f(c) for f in (F.avg, F.stddev_samp) for c in fixed.STYLE_FEATURES]
    count, *row = held.agg(F.count(F.lit(1)), *facts).first()
    if count < 2:
        raise ValueError("driver styles need at least two driver-seasons")
    n = len(fixed.STYLE_FEATURES)
    bare = StyleModel(tuple(row[:n]), tuple(row[n:]), (), {}, {})
    rows = materialise(bare.scaled(held).select("driver_id", "season", *_SCALED), "scaled")
    centres = _k_means(rows, _farthest_first(rows, clusters), iterations)
    return StyleModel(bare.means, bare.deviations, principal_axes(rows), centres, label_archetypes(centres))


def principal_axes(rows: DataFrame, k: int = 2) -> tuple[tuple[float, ...], ...]:
    """Axes of the largest variance; the largest part of each (of equal ones the first) is positive."""
    n = len(_SCALED)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    found = rows.agg(*[F.covar_samp(_SCALED[i], _SCALED[j]) for i, j in pairs]).first()
    covariance = np.zeros((n, n))
    for (i, j), value in zip(pairs, found, strict=True):
        covariance[i, j] = covariance[j, i] = value
    _, vectors = np.linalg.eigh(covariance)
    axes = vectors.T[::-1][:k]
    return tuple(tuple(float(x) for x in a * np.sign(a[np.argmax(np.round(np.abs(a), DIGITS))])) for a in axes)


def _distance(centre: Sequence[float]) -> Column:
    parts = [(F.col(z) - c) * (F.col(z) - c) for z, c in zip(_SCALED, centre, strict=True)]
    return F.round(sum(parts[1:], parts[0]), DIGITS)


def _farthest_first(rows: DataFrame, clusters: int) -> dict[int, tuple[float, ...]]:
    """The row farthest from the mean, then each time the row farthest from the centres taken, ties
    by driver and season; fewer where all rows lie on centres."""
    centres: dict[int, tuple[float, ...]] = {}
    while len(centres) < clusters:
        near = F.least(*map(_distance, centres.values())) if len(centres) > 1 else _distance(centres.get(0, (0.0,) * len(_SCALED)))
        far = F.min(F.struct((-near).alias("d"), "driver_id", "season", F.array(*_SCALED).alias("z")))
        row = rows.agg(far.alias("far")).first()["far"]
        if centres and row["d"] == 0:
            break
        centres[len(centres)] = tuple(row["z"])
    return centres


def nearest(centres: Mapping[int, Sequence[float]]) -> Column:
    """Number of the nearest centre, of equally near ones the smallest."""
    each = [F.struct(_distance(z).alias("d"), F.lit(c).alias("cluster")) for c, z in centres.items()]
    return F.array_min(F.array(*each))["cluster"]


def _rounded(distance: float) -> float:
    """As Spark rounds a double."""
    if not 0 <= distance < 1e15:
        return distance
    return float(Decimal(repr(distance)).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))


def _places(z: np.ndarray, there: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Place of the nearest of ``points`` for each row, as ``nearest`` gives it; a row with a missing value has the first.

    Rounding decides only where another point is nearly as near, so only those distances are rounded.
    """
    far = np.zeros((len(z), len(points)))
    for i in range(z.shape[1]):
        far += (z[:, i, None] - points[None, :, i]) ** 2
    least = far.min(1)
    at = far.argmin(1)
    close = (far <= least[:, None] + 10.0 ** (1 - DIGITS)).sum(1) != 1
    for k in np.flatnonzero(close | ~there):
        each = [(np.isnan(d), _rounded(d), c) for c, d in enumerate(far[k].tolist())]
        at[k] = min(each)[2] if there[k] and not np.isnan(far[k]).all() else 0
    return at


def _cluster_sums(centres: Mapping[int, Sequence[float]]):
    """Sums and counts of the scaled features by nearest centre, for each batch."""
    labels = np.array(sorted(centres), np.int32)
    points = np.array([centres[c] for c in labels.tolist()], np.float64)

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(_SCALED))]
            valid = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], 1)
            z = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns], 1)
            at = _places(z, valid.all(1), points)
            held = np.unique(at)
            out = [pa.array(labels[held])]
            for i in range(len(_SCALED)):
                sums = np.bincount(at, np.where(valid[:, i], z[:, i], 0.0), len(labels))
                out += [pa.array(sums[held]), pa.array(np.bincount(at, valid[:, i], len(labels)).astype(np.int64)[held])]
            yield pa.RecordBatch.from_arrays(out, ["cluster", *[f"{k}{i}" for i in range(len(_SCALED)) for k in "sn"]])

    return run


def _k_means(rows: DataFrame, centres: dict[int, tuple[float, ...]], iterations: int) -> dict[int, tuple[float, ...]]:
    """Centres moved to the means of their rows until they stay; a cluster left without rows is dropped."""
    axes = range(len(_SCALED))
    schema = ", ".join(["cluster int", *[f"s{i} double, n{i} bigint" for i in axes]])
    for _ in range(iterations):
        sums = rows.select(*_SCALED).mapInArrow(_cluster_sums(centres), schema).groupBy("cluster")
        means = sums.agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(z) for i, z in enumerate(_SCALED)])
        moved = {r["cluster"]: tuple(r[z] for z in _SCALED) for r in sorted(means.collect(), key=lambda r: r["cluster"])}
        still = moved.keys() == centres.keys() and all(np.allclose(moved[c], centres[c], rtol=0, atol=1e-12) for c in moved)
        centres = moved
        if still:
            break
    return centres


def label_archetypes(means: Mapping[int, Sequence[float]]) -> dict[int, str]:
    """Name clusters one after another by their most telling feature; the rest are balanced."""
    at = {f: i for i, f in enumerate(fixed.STYLE_FEATURES)}
    variance, tyres, spread = (
        at["sector_time_variance"], at["tyre_management_index"], at["lap_time_consistency"]
    )
    rules = (
        ("technical", lambda m: -m[variance]),
        ("inconsistent", lambda m: m[spread] + m[variance]),
        ("aggressive", lambda m: m[tyres]),
        ("conservative", lambda m: -m[tyres]),
    )
    left = dict(sorted(means.items()))
    named: dict[int, str] = {}
    for label, size in rules:
        if left:
            best = max(left, key=lambda c: size(left[c]))
            named[best] = label
            del left[best]
    return {**named, **{c: "balanced" for c in left}}


def style_assignments(style: StyleModel, features: DataFrame) -> DataFrame:
    """Features with cluster, archetype and the first two components as coordinates."""
    rows = style.scaled(features).withColumn("cluster", nearest(style.centres))
    return rows.select(
        "driver_id", "season", *fixed.STYLE_FEATURES, "cluster",
        lookup("cluster", style.labels).alias("archetype"),
        *style_coordinates(style),
    )


def style_coordinates(style: StyleModel) -> list[Column]:
    """Projections of the scaled features on the two axes."""
    out = []
    for name, axis in zip(("style_x", "style_y"), style.axes, strict=True):
        parts = [F.col(z) * a for z, a in zip(_SCALED, axis, strict=True)]
        out.append(sum(parts[1:], parts[0]).alias(name))
    return out


def archetype_table(style: StyleModel, assigned: DataFrame) -> DataFrame:
    """Rows, name and scaled centre of each cluster."""
    counts = assigned.groupBy("cluster", "archetype").agg(F.count(F.lit(1)).alias("rows"))
    centre = [lookup("cluster", {c: z[i] for c, z in style.centres.items()}).alias(f) for i, f in enumerate(fixed.STYLE_FEATURES)]
    return counts.select("cluster", "archetype", "rows", *centre)
