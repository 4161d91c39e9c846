"""Streams against their batch twins: restarts, duplicates, shuffled arrival."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paddock import scratch
from paddock.scratch import new_path
from paddock.sources import feed
from paddock.streaming import alerts, live, rules
from tests.conftest import rows

TIMING = (
    "session_id string, car_number string, seq int, "
    "entry struct<NumberOfLaps: int, LastLapTime: struct<Value: string>, Sectors: map<string, struct<Value: string>>>"
)
NOW = datetime(2024, 5, 5, 12, 0, 0)


def timing(spark, data):
    return spark.createDataFrame([("s", car, seq, (lap, (t,), {"0": ("28.1",)})) for car, seq, lap, t in data], TIMING)


def run_parts(spark, parts, start):
    folder = new_path(spark, "parts")
    for part in parts:
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(part.schema).parquet(folder)).awaitTermination()


MESSAGES = [
    ("44", 1, 1, "1:31.0"), ("44", 2, 1, "1:31.0"), ("44", 3, 3, "1:30.0"), ("1", 4, 2, "1:29.5"),
    ("44", 5, 2, "1:33.0"), ("44", 6, None, "1:33.0"), ("44", 7, 4, ""), ("1", 8, 2, "1:29.5"), ("1", 9, 3, "x"),
]


def test_completed_laps_batch(spark, small_chunks):
    laps, best = live.completed_laps(timing(spark, MESSAGES))
    got = sorted((r.car_number, r.lap_number, r.lap_time_seconds, r.compound, r.sector1_seconds) for r in laps.collect())
    assert got == [
        ("1", 2, 89.5, "UNKNOWN", 28.1), ("1", 3, None, "UNKNOWN", 28.1), ("44", 1, 91.0, "UNKNOWN", 28.1),
        ("44", 3, 90.0, "UNKNOWN", 28.1), ("44", 4, None, "UNKNOWN", 28.1),
    ]
    assert {(r.car_number, r.highest) for r in best.collect()} == {("44", 4), ("1", 3)}


@pytest.mark.parametrize("cut", [1, 3, 5, 8])
def test_completed_laps_stream_survives_a_restart(spark, cut):
    whole = timing(spark, MESSAGES)
    path = new_path(spark, "laps")
    run_parts(spark, [whole.filter(F.col("seq") <= cut), whole.filter(F.col("seq") > cut)], lambda s: live.lap_completions(s, path))
    got = live.read_batches(spark, f"{path}/laps").select("car_number", "seq", "lap_number")
    want = live.completed_laps(whole)[0].select("car_number", "seq", "lap_number")
    assert rows(got) == rows(want)


def test_keyed_laps_take_stored_laps_and_drop_idle_cars(spark):
    path = new_path(spark, "keyed")
    stored = spark.createDataFrame([("s", "44", 2), ("s", "44", 1)], "session_id string, car_number string, lap_number int")
    whole = timing(spark, [("44", 1, 2, "1:31.0"), ("44", 2, 3, "1:31.0"), ("1", 3, 2, "1:31.0"), ("1", 4, 3, "1:31.0"), ("44", 5, 3, "1:31.0"), ("1", 6, 3, "1:31.0")])
    parts = [whole.filter("seq <= 3"), whole.filter("seq = 4"), whole.filter("seq >= 5")]
    run_parts(spark, parts, lambda s: live.lap_completions(s, path, stored=stored, idle_hours=0.5 / 3600))
    got = live.read_batches(spark, f"{path}/laps").select("batch_id", "seq")
    assert rows(got) == [(0, 2), (0, 3), (1, 4), (2, 5)]  # 44 is idle in batch 1, so its lap 3 counts again


def test_highest_lap_calls_the_store_twice_a_key():
    """One read and one write a key and batch; the timer is set once and follows when it fires."""
    from pyspark.sql import Row

    from paddock.streaming.state import HighestLap

    class Store:
        value, timers, calls = None, [], 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    state, store = HighestLap("seq", "lap", 100), Store()
    state.init(store)
    sent = [(3, 2), (1, 1), (2, 3), (5, 3), (4, None), (6, 4)]
    got = state.handleInputRows(("a",), iter([Row(seq=s, lap=n) for s, n in sent]), Clock(1000))
    assert [(r.seq, r.lap) for r in got] == [(1, 1), (2, 3), (6, 4)]
    assert list(state.handleInputRows(("a",), iter([Row(seq=7, lap=4)]), Clock(1050))) == []
    assert (store.calls, store.timers, store.value) == (4, [1100], (4, 1150))
    state.handleExpiredTimer(("a",), Clock(1100), None)
    assert store.timers == [1100, 1150] and store.value == (4, 1150)
    state.handleExpiredTimer(("a",), Clock(1150), None)
    assert store.value is None


def test_live_chain_stores_mapped_cars(spark):
    path = new_path(spark, "chain")
    cars = spark.createDataFrame([("44", "ham")], "car_number string, driver_id string")
    whole = timing(spark, MESSAGES)
    run_parts(spark, [whole.filter("seq <= 3"), whole.filter("seq > 3")], lambda s: live.lap_completions(s, path, cars, lambda: NOW))
    laps = live.read_batches(spark, f"{path}/laps").drop("batch_id")
    run_parts(spark, [laps], lambda s: live.upsert_laps(s, f"{path}/stored", f"{path}/upsert"))
    got = spark.read.parquet(f"{path}/stored").collect()
    assert sorted((r.driver_id, r.lap_number, r.created_at) for r in got) == [("ham", n, NOW) for n in (1, 3, 4)]


def test_upsert_stores_laps_however_late(spark):
    schema = "session_id string, driver_id string, lap_number int, lap_time_seconds double, created_at timestamp"
    base = [("s", "d", n, 90.0 + n, NOW - timedelta(hours=n)) for n in range(6)]
    path = new_path(spark, "late")
    run_parts(spark, [spark.createDataFrame([r], schema) for r in base], lambda s: live.upsert_laps(s, f"{path}/t", f"{path}/c"))
    assert sorted(r.lap_number for r in spark.read.schema(schema).parquet(f"{path}/t").collect()) == list(range(6))


def test_wrong_shapes_are_rejected(spark):
    bad = [("TimingData", '{"Lines": 5}'), ("TimingData", "[1]"), ("TimingData", "{}"), ("WeatherData", "7"), ("WeatherData", "null"), ("TimingData", None)]
    parts = live.split_topics(spark.createDataFrame(bad, "topic string, payload string"))
    assert rows(parts["rejects"]) == sorted(bad, key=repr)
    assert all(parts[name].count() == 0 for name in ("cars", "timing", "weather"))


def test_python_workers_of_a_feed(spark):
    """Payloads are inflated once, and only those of the topic that is packed."""
    parts = live.split_topics(spark.createDataFrame([("CarData.z", "junk"), ("TimingData", "{}")], "topic string, payload string"))

    def calls(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")

    assert {name: calls(df) for name, df in parts.items()} == {"cars": 1, "timing": 0, "weather": 0, "rejects": 1}


def test_lineage_cuts_are_emptied(spark):
    mark = scratch.made(spark)
    held = scratch.materialise(spark.range(100), "life")
    path = held.inputFiles()[0].rsplit("/", 1)[0]
    assert held.count() == 100
    scratch.clear(spark, mark)
    assert spark.read.schema("x int").parquet(path).count() == 0 and scratch.made(spark) == mark


def test_upsert_drops_duplicates_in_and_across_batches(spark):
    schema = "session_id string, driver_id string, lap_number int, lap_time_seconds double, created_at timestamp"
    base = [("s", "d", n, 90.0 + n, NOW + timedelta(minutes=n)) for n in range(8)]
    parts = [spark.createDataFrame(base[:4] + base[:2], schema), spark.createDataFrame(base[2:] + base[5:], schema)]
    path = new_path(spark, "upsert")
    run_parts(spark, parts, lambda s: live.upsert_laps(s, f"{path}/t", f"{path}/c"))
    got = spark.read.schema(schema).parquet(f"{path}/t")
    assert sorted(r.lap_number for r in got.collect()) == list(range(8))


def test_topics(spark):
    import base64
    import zlib

    packer = zlib.compressobj(wbits=-15)
    text = json.dumps({"Cars": {"44": {"Channels": {"2": 312.5, "3": 8, "4": 100, "5": 0, "45": 8}}}}).encode()
    payload = base64.b64encode(packer.compress(text) + packer.flush()).decode()
    df = spark.createDataFrame(
        [("CarData.z", payload), ("CarData.z", "junk"), ("TimingData", '{"Lines": {"1": {"NumberOfLaps": 3}}}'),
         ("TimingData", "{oops"), ("WeatherData", '{"TrackTemp": "30.5", "AirTemp": "20"}'), ("SessionInfo", "{}")],
        "topic string, payload string",
    ).withColumns({"ts": F.lit(NOW), "session_id": F.lit("s")})
    parts = live.split_topics(df)
    latest = live.latest_car(parts["cars"])
    r = latest.first()
    assert (r.car_number, r.speed_kmh, r.gear, r.throttle_pct, r.brake, r.drs) == ("44", 312.5, 8, 100.0, False, "available")
    assert live.fresh(latest, NOW + timedelta(seconds=7), 8).count() == 1
    assert live.fresh(latest, NOW + timedelta(seconds=8), 8).count() == 0
    assert [(r.car_number, r.entry.NumberOfLaps) for r in parts["timing"].collect()] == [("1", 3)]
    assert live.latest_weather(parts["weather"]).first().track_temp == 30.5
    assert rows(parts["rejects"].select("topic")) == [("CarData.z",), ("TimingData",)]


def test_latest_stream_ignores_arrival_order(spark):
    schema = "session_id string, car_number string, ts timestamp, entry struct<Channels: map<string, double>>"
    data = [("s", str(c), NOW + timedelta(seconds=i), ({"2": float(c * 100 + i)},)) for c in range(3) for i in range(10)]
    df = spark.createDataFrame(data, schema)
    path = new_path(spark, "latest")
    late_first = [df.filter("pmod(hash(ts), 2) = 0"), df.filter("pmod(hash(ts), 2) = 1")]
    run_parts(spark, late_first, lambda s: live.store_latest(s, live.latest_car, path))
    got = live.read_latest(spark, path, ("session_id", "car_number"), live.CHANNEL_FIELDS)
    assert rows(got) == rows(live.latest_car(df))


def test_enriched_events_are_never_lost(spark):
    lap_schema = "driver_id string, session_id string, lap_number int, lap_time_seconds double, compound string, sector1_seconds double, sector2_seconds double, sector3_seconds double"
    laps = spark.createDataFrame([(d, "s", 5, 90.0, "SOFT", None, None, None) for d in ("live", "stale", "unmapped")], lap_schema)
    channels = spark.createDataFrame(
        [("s", "44", 300.0, 99.0, True, 8, "open", NOW), ("s", "1", 200.0, 50.0, False, 4, "off", NOW - timedelta(seconds=9))],
        "session_id string, car_number string, speed_kmh double, throttle_pct double, brake boolean, gear int, drs string, ts timestamp",
    )
    cars = spark.createDataFrame([("44", "live"), ("1", "stale")], "car_number string, driver_id string")
    path = new_path(spark, "enrich")
    run_parts(spark, [laps], lambda s: live.enrich_stream(s, lambda: channels, cars, path, lambda: NOW + timedelta(seconds=2)))
    got = {r.data.driver_id: r.data.speed_kmh for r in live.read_batches(spark, f"{path}/events").collect()}
    assert got == {"live": 300.0, "stale": None, "unmapped": None}


def test_replay_keeps_lap_order(spark):
    data = [(d, "s", n, 90.0 if (d, n) != ("b", 2) else None, "SOFT", None, None, None) for n in range(1, 11) for d in ("b", "a")]
    laps = spark.createDataFrame(
        data, "driver_id string, session_id string, lap_number int, lap_time_seconds double, compound string, sector1_seconds double, sector2_seconds double, sector3_seconds double"
    )
    folder = feed.replay_laps(laps, "s", 4)
    got = spark.read.json(folder).orderBy("seq").collect()
    assert [(r.lap_number, r.driver_id) for r in got] == [(n, d) for n in range(1, 11) for d in ("a", "b") if (d, n) != ("b", 2)]
    assert sorted({r.batch for r in got}) == [0, 1, 2, 3]
    arrived = []
    feed.replay_stream(spark, folder, lambda b, i: arrived.append((i, sorted((r.lap_number, r.driver_id) for r in b.collect()))), folder + "-checkpoint", 4)
    assert [i for i, _ in arrived] == [0, 1, 2, 3]
    assert [x for _, rows in arrived for x in rows] == [(n, d) for n in range(1, 11) for d in ("a", "b") if (d, n) != ("b", 2)]


def subs(spark):
    return spark.createDataFrame(
        [("u1", ["a", "a"], ["PIT_WINDOW_OPEN"]), ("u2", ["a", "b"], ["UNDERCUT_THREAT", "PIT_WINDOW_OPEN"]), ("u3", [], ["PIT_WINDOW_OPEN"])],
        "user_id string, driver_ids array<string>, alert_types array<string>",
    )


def test_pit_alert_stream(spark):
    users = spark.createDataFrame([("u1", "tok"), ("u2", None)], "id string, fcm_token string")
    text = [json.dumps({"session_id": "s", "driver_id": d, "pit_probability": p}) for d, p in (("a", 0.5), ("b", 0.49), ("c", 0.9))]
    messages = spark.createDataFrame([(t,) for t in text] + [("{bad",), (None,)], "value string")
    batch = alerts.pit_alerts(messages, subs(spark), users)
    assert {(r.user_id, r.driver_id, r.deliverable, r.message) for r in batch.collect()} == {
        ("u1", "a", True, "Driver a: pit probability 50%"), ("u2", "a", False, "Driver a: pit probability 50%")
    }
    path = new_path(spark, "alerts")
    run_parts(spark, [messages], lambda s: alerts.pit_alert_stream(s, subs(spark), users, path, lambda: NOW))
    stored = live.read_batches(spark, f"{path}/alerts").collect()
    assert {r.user_id for r in stored} == {"u1", "u2"} and len({r.id for r in stored}) == 2
    assert {r.triggered_at for r in stored} == {NOW}
    sent = [json.loads(r.value) for r in live.read_batches(spark, f"{path}/messages").collect()]
    assert {m["alert_type"] for m in sent} == {"PIT_WINDOW_OPEN"}


def test_undercut_threats(spark, small_chunks):
    laps = spark.createDataFrame([("s", "b", 4, 1), ("s", "a", 5, 2), ("s", "b", 5, 1)], "session_id string, driver_id string, lap_number int, position int")
    schema = "session_id string, driver_id string, predicted_at timestamp, id string, undercut_score double"

    def scores(a):
        return spark.createDataFrame([("s", "a", NOW, "1", 0.9), ("s", "a", NOW + timedelta(seconds=5), "2", a), ("s", "b", NOW, "3", 0.99)], schema)

    hot = subs(spark).withColumn("driver_ids", F.array(F.lit("a"), F.lit("b")))
    got = alerts.undercut_threats(laps, scores(0.625), hot).collect()
    assert [(r.user_id, r.driver_id, r.message) for r in got] == [("u2", "a", "Undercut threat: driver a on driver b (62%)")]
    assert alerts.undercut_threats(laps, scores(0.5), hot).count() == 0
    assert alerts.undercut_threats(laps, scores(0.9), subs(spark).filter("user_id = 'u1'")).count() == 0


def test_threat_stream_looks_at_touched_sessions(spark):
    laps = spark.createDataFrame([(s, d, 5, p) for s in ("s", "t") for d, p in (("b", 1), ("a", 2))], "session_id string, driver_id string, lap_number int, position int")
    preds = spark.createDataFrame([(s, "a", NOW, s, 0.8) for s in ("s", "t")], "session_id string, driver_id string, predicted_at timestamp, id string, undercut_score double")
    path = new_path(spark, "threats")
    run_parts(spark, [laps.filter("session_id = 't'")], lambda s: alerts.threat_stream(s, lambda: (laps, preds), subs(spark), path, lambda: NOW))
    assert {r.session_id for r in live.read_batches(spark, f"{path}/alerts").collect()} == {"t"}


def test_sustained_needs_an_unbroken_run(spark, small_chunks):
    rule = rules.Rule("r", "hit_rate", 5, 1, 0.6, False, 3)
    fired = [1, 1, 1, 1, 0, 1, 1, None, 1, 1, 1, 1, 1]
    data = [("r", NOW + timedelta(minutes=i), bool(f)) for i, f in enumerate(fired) if f is not None]
    df = spark.createDataFrame(data, "rule string, window_start timestamp, firing boolean")
    got = rules.sustained(df, (rule,)).orderBy("window_start").collect()
    assert [int((r.window_start - NOW).total_seconds() // 60) for r in got if r.sustained] == [3, 11, 12]
    assert got[4].firing_since is None and got[5].firing_since == NOW + timedelta(minutes=5)


@pytest.mark.parametrize("measure", ["hit_rate", "p95", "error_ratio"])
def test_stream_rules_close_windows_with_the_watermark(spark, measure):
    log = spark.createDataFrame(
        [(NOW + timedelta(seconds=20 * i), i % 4 != 0, 200) for i in range(120)], "ts timestamp, cache_hit boolean, status int"
    ).withColumn("latency_s", F.minute("ts") / 7.0)
    rule = rules.Rule("low", measure, 10, 5, 0.8, False, 10)
    path = new_path(spark, "rule")
    stream = lambda s: rules.window_rule_stream(s, rule).writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/out")
    run_parts(spark, [log], stream)
    got = {r.window_start: r.value for r in spark.read.parquet(f"{path}/out").collect()}
    want = {r.window_start: r.value for r in rules.window_values(log, rule).collect()}
    assert got and all(want[w] == pytest.approx(x) for w, x in got.items())


def test_late_rows_correct_their_windows_and_are_listed(spark):
    log = spark.createDataFrame(
        [(i, NOW + timedelta(seconds=40 * i), i % 3 != 0, 200, 0.1) for i in range(90)], "id int, ts timestamp, cache_hit boolean, status int, latency_s double"
    )
    rule = rules.Rule("low", "hit_rate", 10, 5, 0.66, False, 10)
    parts = [log.filter("id between 60 and 69"), log.filter("id >= 72 or id < 10"), log.filter("id between 10 and 59"), log.filter("id between 70 and 71")]
    path = new_path(spark, "late")
    run_parts(spark, parts, lambda s: rules.window_rule_updates(s, rule, path, 600, every=2))
    got = live.read_updates(spark, path, ["rule", "window_start"]).select("rule", "window_start", "value", "firing")
    assert rows(got) == rows(rules.window_rules(log, (rule,)))
    late = {(r.batch_id, r.id): r.behind_seconds for r in live.read_batches(spark, f"{path}/late").collect()}
    assert late == {**{(1, i): 40 * (69 - i) for i in range(10)}, **{(2, i): 40 * (89 - i) for i in range(10, 60)}, (3, 70): 760, (3, 71): 720}


def test_sustained_stream_equals_the_batch(spark):
    log = spark.createDataFrame(
        [(NOW + timedelta(minutes=i, seconds=5), i % 12 < 3, 200, 0.1) for i in range(60) if i not in (24, 25, 26, 27)], "ts timestamp, cache_hit boolean, status int, latency_s double"
    )
    rule = rules.Rule("low", "hit_rate", 2, 1, 0.6, False, 3)
    path, cut = new_path(spark, "runs"), NOW + timedelta(minutes=20)
    run_parts(spark, [log.filter(F.col("ts") < cut), log.filter(F.col("ts") >= cut)], lambda s: rules.sustained_stream(s, rule, path, "2 minutes"))
    got = rows(live.read_batches(spark, f"{path}/windows").select("window_start", "firing", "firing_since", "sustained"))
    closed = F.col("window_start") <= NOW + timedelta(minutes=59 - 2 - 2)
    want = rules.sustained(rules.window_rules(log, (rule,)), (rule,)).filter(closed)
    assert got == rows(want.select("window_start", "firing", "firing_since", "sustained")) and any(r[3] for r in got)


def test_the_newest_sample_store_stays_small(spark):
    """Batches fold away: late samples, repeated batches and many batches give the newest of all."""
    import random

    rng, path, keys = random.Random(3), new_path(spark, "latest"), ["k"]
    rows = [(n, f"k{rng.randrange(5)}", float(n), datetime(2024, 1, 1, 0, rng.randrange(60), n % 60)) for n in range(70)]
    seen = {}
    for batch in range(14):
        part = [r[1:] for r in rows if r[0] // 5 == batch] if batch != 6 else []
        newest = live.latest_samples(spark.createDataFrame(part, "k string, v double, ts timestamp"), keys, ["v"])
        for _ in range(2 if batch in (3, 4, 9) else 1):
            live.keep_latest(newest, batch, path, keys, every=3)
        for k, v, ts in part:
            seen[k] = max(seen.get(k, (ts, v)), (ts, v))
        if batch in (0, 3, 4, 8, 9, 13):
            got = {r.k: (r.ts, r.v) for r in live.read_latest(spark, path, keys, ["v"]).collect()}
            assert got == seen
    folders = {tuple(r) for r in spark.read.parquet(f"{path}/latest/batches").select("slot", "batch_id").distinct().collect()}
    assert folders <= {(s, b) for b in range(6, 14) for s in [b // 3 % 3]}
