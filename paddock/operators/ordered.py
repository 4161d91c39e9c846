"""Ranks, running sums and neighbours over groups of any size.

``Window.partitionBy(key)`` puts a whole group into one task.  A session or a driver
may hold a third of all rows, so the functions here range-partition on (keys, order)
instead, which splits a large group at row boundaries into chunks.  Each chunk is then
an ordinary small window, and what has to cross a chunk boundary (a count, a sum, one
row) travels in a carry table.  At most one group continues into any chunk, so the
carry table never has more rows than there are chunks and is safe to broadcast.

Order columns are ascending and, together with the keys, must identify a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.lookups import join_lookup
from paddock.scratch import materialise

CHUNK = "_chunk"
CHUNKS_CONF = "paddock.rangeChunks"


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on (keys, order), number the ranges and write the rows once.

    The write pins the chunk numbers: range bounds come from sampling and would
    differ if the partitioning were computed again.
    """
    by = [F.col(c) for c in (*keys, *order)]
    fixed = df.sparkSession.conf.get(CHUNKS_CONF, None)
    ranged = df.repartitionByRange(int(fixed), *by) if fixed else df.repartitionByRange(*by)
    return materialise(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def over_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rank: str | None = None,
    sums: Mapping[str, str] | None = None,
    max_before: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    last_known: Mapping[str, str] | None = None,
    next_known: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``; every mapping is {new column: source column}.

    rank: 1-based row number.  sums: running sum up to the row (NULLs skipped, NULL
    until the first value).  max_before: largest value in the rows before, NULL when there
    is none.  previous/following: value of the neighbouring row.
    last_known/next_known: nearest non-NULL value at or before / at or after the row.
    """
    sums, previous, following = dict(sums or {}), dict(previous or {}), dict(following or {})
    last_known, next_known = dict(last_known or {}), dict(next_known or {})
    max_before = dict(max_before or {})
    keys, order = list(keys), list(order)
    base = in_chunks(df, keys, order)
    carry = _carry(base, keys, order, sums, max_before, previous, following, last_known, next_known)

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far_but_row = inside.rowsBetween(Window.unboundedPreceding, -1)
    # A frame that runs to the end of the partition is evaluated anew for every row, so
    # looking ahead is looking back in the reverse order.
    back_to_here = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = base
    if rank or previous or following:
        local = local.withColumn("_pos", F.row_number().over(inside))
    if following:
        local = local.withColumn("_left", F.lead(F.lit(1)).over(inside))
    for out, col in sums.items():
        local = local.withColumn(f"_s_{out}", F.sum(col).over(so_far))
    for out, col in max_before.items():
        local = local.withColumn(f"_m_{out}", F.max(col).over(so_far_but_row))
    for out, col in previous.items():
        local = local.withColumn(f"_p_{out}", F.lag(col).over(inside))
    for out, col in following.items():
        local = local.withColumn(f"_f_{out}", F.lead(col).over(inside))
    for out, col in last_known.items():
        local = local.withColumn(f"_l_{out}", F.last(col, ignorenulls=True).over(so_far))
    for out, col in next_known.items():
        local = local.withColumn(f"_n_{out}", F.last(col, ignorenulls=True).over(back_to_here))

    joined = local.join(F.broadcast(carry), _same(local, carry, keys), "left")
    out_cols: list[Column] = [local[c] for c in df.columns]
    if rank:
        out_cols.append(
            (F.col("_pos") + F.coalesce(F.col("_c_rows"), F.lit(0))).cast("bigint").alias(rank)
        )
    for out in sums:
        held, before = F.col(f"_s_{out}"), F.col(f"_c_s_{out}")
        out_cols.append(F.coalesce(held + before, held, before).alias(out))
    for out in max_before:
        out_cols.append(F.greatest(F.col(f"_m_{out}"), F.col(f"_c_m_{out}")).alias(out))
    for out in previous:
        out_cols.append(
            F.when(F.col("_pos") > 1, F.col(f"_p_{out}")).otherwise(F.col(f"_c_p_{out}")).alias(out)
        )
    for out in following:
        out_cols.append(
            F.when(F.col("_left").isNotNull(), F.col(f"_f_{out}"))
            .otherwise(F.col(f"_c_f_{out}"))
            .alias(out)
        )
    for out in last_known:
        out_cols.append(F.coalesce(F.col(f"_l_{out}"), F.col(f"_c_l_{out}")).alias(out))
    for out in next_known:
        out_cols.append(F.coalesce(F.col(f"_n_{out}"), F.col(f"_c_n_{out}")).alias(out))
    return joined.select(*out_cols)


def _same(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> Column:
    parts = [local[k].eqNullSafe(carry[f"_k_{k}"]) for k in keys]
    return reduce(lambda a, b: a & b, parts, local[CHUNK] == carry["_k_chunk"])


def _carry(base, keys, order, sums, max_before, previous, following, last_known, next_known):
    """What each (group, chunk) takes over from the group's other chunks."""
    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(c).alias(f"_s_{o}") for o, c in sums.items()]
    aggs += [F.max(c).alias(f"_m_{o}") for o, c in max_before.items()]
    if previous:
        row = F.struct(*[F.col(c).alias(o) for o, c in previous.items()])
        aggs.append(F.max_by(row, at).alias("_last"))
    if following:
        row = F.struct(*[F.col(c).alias(o) for o, c in following.items()])
        aggs.append(F.min_by(row, at).alias("_first"))
    for o, c in last_known.items():
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_l_{o}"))
    for o, c in next_known.items():
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_n_{o}"))
    per_chunk = base.groupBy(*keys, CHUNK).agg(*aggs)

    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_chunk = group.orderBy(CHUNK)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(k).alias(f"_k_{k}") for k in keys] + [F.col(CHUNK).alias("_k_chunk")]
    cols.append(F.sum("_rows").over(earlier).alias("_c_rows"))
    cols.append(F.lead("_rows").over(by_chunk).alias("_c_more"))
    cols += [F.sum(f"_s_{o}").over(earlier).alias(f"_c_s_{o}") for o in sums]
    cols += [F.max(f"_m_{o}").over(earlier).alias(f"_c_m_{o}") for o in max_before]
    if previous:
        cols += [F.lag(f"_last.{o}").over(by_chunk).alias(f"_c_p_{o}") for o in previous]
    if following:
        cols += [F.lead(f"_first.{o}").over(by_chunk).alias(f"_c_f_{o}") for o in following]
    for o in last_known:
        cols.append(F.last(f"_l_{o}", ignorenulls=True).over(earlier).alias(f"_c_l_{o}"))
    for o in next_known:
        cols.append(F.last(f"_n_{o}", ignorenulls=True).over(later).alias(f"_c_n_{o}"))
    split_groups = F.col("_c_rows").isNotNull() | F.col("_c_more").isNotNull()
    return per_chunk.select(*cols).filter(split_groups)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based row number inside each group."""
    return over_order(df, keys, order, rank=out)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float],
    weight: str | None = None, largest: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, {output column: fraction}.

    Equal values are counted first, then ranked through running counts, so no
    aggregation buffer grows with the group.  The input is read once: totals come from the counts,
    and so do ``largest``, {output column: column}, which are taken over rows without a value too;
    with them, a group of such rows only has NULL quantiles instead of no row.
    """
    keys, largest = list(keys), dict(largest or {})
    held = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df if largest else df.filter(F.col(value).isNotNull())
    counts = (
        counted.groupBy(*keys, F.col(value).alias("_v"))
        .agg(held.cast("bigint").alias("_n"), *[F.max(c).alias(o) for o, c in largest.items()])
        .withColumn("_n", F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    )
    upto = over_order(counts, keys, ["_v"], sums={"_upto": "_n"})
    totals = upto.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    if keys:
        placed = join_lookup(upto, totals, keys, "inner")
    else:
        placed = upto.withColumn("_total", totals.scalar())
    aggs = []
    for i, q in enumerate(wanted.values()):
        spot = (F.col("_total") - 1) * F.lit(float(q))
        lo, hi = F.floor(spot), F.ceil(spot)
        first = F.col("_upto") - F.col("_n")
        aggs.append(F.max(F.when((first <= lo) & (lo < F.col("_upto")), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when((first <= hi) & (hi < F.col("_upto")), F.col("_v"))).alias(f"_hi{i}"))
        aggs.append(F.max(spot - lo).alias(f"_part{i}"))
    picked = placed.groupBy(*keys).agg(*aggs, *[F.max(o).alias(o) for o in largest])
    return picked.select(
        *keys, *largest,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")).alias(o)
            for i, o in enumerate(wanted)
        ],
    )

