"""Split-group windows against plain Python over skewed groups."""

import random

import pytest
from pyspark.sql import functions as F

from paddock.operators.lapblocks import attach_per_driver, running_by_lap
from paddock.operators.lookups import hot_keys, join_lookup, salted_join
from paddock.operators.ordered import exact_quantiles, over_order, ranked
from tests.conftest import rows


def skewed(n=600, seed=3):
    """Two thirds of the rows in one group, some values missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.67 else rng.choice("abcdef")
        value = None if rng.random() < 0.3 else rng.randrange(100)
        out.append((key, rng.randrange(50), i, value))
    return out


def brute(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    out = []
    for group in groups.values():
        total, best = None, None
        for i, r in enumerate(group):
            before = best
            if r[3] is not None:
                total = r[3] + (total or 0)
                best = r[3] if best is None else max(best, r[3])
            known = [x[3] for x in group[: i + 1] if x[3] is not None]
            ahead = [x[3] for x in group[i:] if x[3] is not None]
            out.append(
                (*r, i + 1, total, before, group[i - 1][3] if i else None,
                 group[i + 1][3] if i + 1 < len(group) else None,
                 known[-1] if known else None, ahead[0] if ahead else None)
            )
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunks", [None, 1, 4, 17])
def test_over_order_equals_brute_force(spark, chunks):
    if chunks:
        spark.conf.set("paddock.rangeChunks", str(chunks))
    try:
        data = skewed()
        df = spark.createDataFrame(data, "k string, o int, i int, v int").repartition(7)
        got = over_order(
            df, ["k"], ["o", "i"], rank="r", sums={"s": "v"}, max_before={"m": "v"},
            previous={"p": "v"}, following={"f": "v"}, last_known={"l": "v"}, next_known={"n": "v"},
        )
        assert rows(got) == brute(data)
    finally:
        spark.conf.unset("paddock.rangeChunks")


def test_rank_without_keys_and_null_keys(spark, small_chunks):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50)], "k string, i int")
    assert [r[2] for r in ranked(df, ["k"], ["i"], "r").orderBy("k", "i").collect()] == list(range(1, 51)) * 2
    whole = ranked(df.filter("k = 'a'"), [], ["i"], "r")
    assert [r["r"] for r in whole.orderBy("i").collect()] == list(range(1, 51))


def test_following_sees_null_values_of_the_next_row(spark, small_chunks):
    df = spark.createDataFrame([("a", i, None if i % 2 else i) for i in range(20)], "k string, o int, v int")
    got = over_order(df, ["k"], ["o"], following={"f": "v"}, previous={"p": "v"}).orderBy("o").collect()
    assert [r["f"] for r in got] == [None if (i + 1) % 2 or i == 19 else i + 1 for i in range(20)]
    assert [r["p"] for r in got] == [None if i == 0 or (i - 1) % 2 else i - 1 for i in range(20)]


def test_exact_quantiles_match_percentile(spark, small_chunks):
    df = spark.createDataFrame([(r[0], r[3]) for r in skewed(500, 9)], "k string, v int")
    got = exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95})
    want = df.groupBy("k").agg(*[F.percentile("v", q) for q in (0.05, 0.5, 0.95)])
    assert [[round(x, 9) if isinstance(x, float) else x for x in r] for r in rows(got)] == [
        [round(x, 9) if isinstance(x, float) else x for x in r] for r in rows(want)
    ]
    whole = exact_quantiles(df, [], "v", {"b": 0.5}).first()[0]
    assert whole == df.agg(F.percentile("v", 0.5)).first()[0]


def test_lap_blocks_equal_one_window(spark):
    data = [("s", "hot", n, n * 7 % 11 if n % 5 else None) for n in range(1, 101)] + [
        ("s", "b", n, n) for n in range(1, 4)
    ]
    df = spark.createDataFrame(data, "session_id string, driver_id string, lap_number int, v int")
    cut = running_by_lap(df, {"run": "v"}, laps=8)
    whole = running_by_lap(df, {"run": "v"})
    assert rows(cut) == rows(whole)
    stats = df.groupBy("session_id", "driver_id").agg(
        F.max("lap_number").alias("last_lap"), F.sum("v").alias("total")
    )
    joined = attach_per_driver(df, stats, laps=8)
    assert rows(joined) == rows(df.join(stats.drop("last_lap"), ["session_id", "driver_id"], "left"))


def test_lookup_join_takes_each_way(spark):
    left = spark.createDataFrame([("hot" if i % 3 else "b", i) for i in range(60)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("c", 2)], "k string, v int")
    want = rows(left.join(right, "k", "left"))
    assert rows(join_lookup(left, right, ["k"])) == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        measured = join_lookup(left, right, ["k"])
        assert "BroadcastHashJoin" in measured._jdf.queryExecution().executedPlan().toString()
        assert rows(measured) == want
        salted = join_lookup(left, right, ["k"], max_rows=0)
        assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
        assert rows(salted) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows(salted_join(left, right, ["k"], "inner", 4)) == rows(left.join(right, "k"))
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "full")


def test_salting_only_repeats_hot_keys(spark, monkeypatch):
    assert hot_keys(spark.createDataFrame([("a", 1)] * 20, "k string, i int"), ["k"]).count() == 0  # a few rows are never hot
    monkeypatch.setattr("paddock.operators.lookups.HOT_ROWS", 100)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(4000)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2)] + [(f"k{i}", i) for i in range(0, 4000, 4)], "k string, v int")
    assert [r.k for r in hot_keys(left, ["k"]).collect()] == ["hot"]
    for how in ("inner", "left"):
        assert rows(salted_join(left, right, ["k"], how, 8)) == rows(left.join(right, "k", how))
