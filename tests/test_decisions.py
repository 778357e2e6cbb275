import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import decisions as dec
from lodestar.plans.queries import QUERIES
from lodestar.streaming.scan import OUTPUT, _steps, decide_stream, step

C, U = 0.9, 0.3
COLUMNS = "session long, seq long, ms long, top_id string, zone_key string, conf double, ocr_zone string"


def rows(*obs):
    """obs: (top, conf, ms, ocr)."""
    return [(1, i, ms, top, None if top is None else f"zone-{top}", conf, ocr) for i, (top, conf, ms, ocr) in enumerate(obs)]


def seq(text, conf_gap=1000):
    return rows(*[(t[1:] or "x", C if t[0] == "C" else U, i * conf_gap, None) for i, t in enumerate(text.split())])


CASES = [
    (seq("Ca Ca"), False, [None, "a"]), (seq("Ca Cb Cb Cb"), False, [None, None, None, "b"]), (seq("Ca ux Ca"), False, [None, None, "a"]),
    (seq("Ca ux ux ux ux ux Ca"), False, [None] * 7), (seq("Cb Ca ux ux Ca"), False, [None] * 4 + ["a"]),
    (rows(*[("a", U, 0, "zone-a")] * 4), False, [None] * 3 + ["a"]), (rows(*[("a", U, 0, "zone-z")] * 6), False, [None] * 6),
    (rows(("a", U, 0, "zone-a"), ("b", U, 0, "zone-a"), ("a", U, 0, "zone-a"), ("a", U, 0, "zone-a")), False, [None] * 4),
    (rows(*[("a", C, 0, None)] * 2), True, [None, None]), (rows(*[("a", C, 0, "zone-a")] * 2), True, [None, "a"]),
]


@pytest.mark.parametrize("need", [False, True])
def test_confirmations(spark, need):
    """Every case is a session of its own."""
    some = [(i, obs, expected) for i, (obs, n, expected) in enumerate(CASES) if n == need]
    out = dec.decide(spark.createDataFrame([(i, *o[1:]) for i, obs, _ in some for o in obs], COLUMNS), need).orderBy("session", "seq").collect()
    assert [[r.confirmed for r in out if r.session == i] for i, _, _ in some] == [expected for _, _, expected in some]


@pytest.mark.parametrize(("obs", "expected"), [
    (rows(("x", U, 0, None), ("x", U, 4999, None)), False), (rows(("x", U, 0, None), ("x", U, 5000, None)), True),
    (rows(("x", U, 0, None), ("x", C, 3000, None), ("x", U, 7999, None)), False), (rows((None, 0.0, 0, None), (None, 0.0, 5000, None)), True),
])
def test_time_out(spark, obs, expected):
    assert dec.decide(spark.createDataFrame(obs, COLUMNS)).orderBy("seq").collect()[-1].show_candidates == expected


@pytest.mark.parametrize(("need", "segment"), [(False, 100_000), (True, 100_000), (False, 5), (True, 13)])
def test_window_form_agrees_with_the_machine(spark, need, segment):
    """Also if sessions are cut into small segments, and where some of their rows start them anew."""
    rng, obs = random.Random(3), []
    for s in range(20):
        ms = 0
        for i in range(40 if s else 300):
            ms += rng.choice([200, 900, 3000])
            top = rng.choice(["a", "a", "a", "b", None])
            obs.append((s, i, ms, top, None if top is None else f"z{top}", rng.choice([0.1, 0.1, 0.3, 0.7, 0.9] if s % 2 else [0.1, 0.3]), rng.choice([None, "za", "zb"]), rng.choice([None, False, i % 17 == 3]) if s % 3 == 0 else None))
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["reset"]
    got = {(r.session, r.seq): (r.confirmed, r.via, r.show_candidates) for r in dec.decide(spark.createDataFrame(obs, COLUMNS + ", reset boolean"), need, segment).collect()}
    state = {}
    for o in obs:
        want = step(state.setdefault(o[0], {"ring": [], "since": None}), dict(zip(names, o, strict=True)), need)
        assert got[o[0], o[1]] == want, o
    assert len(got) == len(obs)


def test_reset_clears_the_machine():
    state = {"ring": [], "since": None}
    row = {"top_id": "a", "zone_key": "z", "conf": 0.9, "ocr_zone": None, "ms": 0}
    assert step(state, row, False)[0] is None
    step(state, {"reset": True}, False)
    assert step(state, row, False)[0] is None and step(state, row, False)[0] == "a"


def test_as_of_zone_expires(spark):
    frames = spark.createDataFrame([(1, 1, 1000), (1, 2, 8999), (1, 3, 9000), (2, 1, 5)], "session long, seq long, ms long")
    zones = spark.createDataFrame([(1, 0, 1000, "z")], "session long, seq long, ms long, zone string")
    got = {(r.session, r.seq): r.zone for r in dec.latest_zone(frames, zones).collect()}
    assert got == {(1, 1): "z", (1, 2): "z", (1, 3): None, (2, 1): None}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_as_of_zone_of_random_times(spark, parts):
    rng = random.Random(9)
    frames = [(rng.randrange(3), i, rng.randrange(400)) for i in range(200)]
    zones = [(rng.randrange(3), i, rng.randrange(400), f"z{i}") for i in range(40)]
    out = dec.latest_zone(spark.createDataFrame(frames, "session long, seq long, ms long"), spark.createDataFrame(zones, "session long, seq long, ms long, zone string"), 30, parts)
    want = []
    for s, i, ms in frames:
        past = max(((m, k, z) for t, k, m, z in zones if t == s and m <= ms), default=None)
        want.append((s, i, ms, past[2] if past and ms - past[0] < 30 else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_readings_of_one_moment_are_taken_by_seq_and_zone(spark):
    """Whatever order they come in, and the same one in the moment's own bucket and in later ones."""
    zones = [(1, 7, 1000, z) for z in "cab"] + [(2, s, 1000, f"z{s}") for s in (3, 5, 4)]
    frames = [(s, i, ms) for s in (1, 2) for i, ms in enumerate((1000, 1001, 2000, 8999))]
    for some in (zones, zones[::-1]):
        readings = spark.createDataFrame(some, "session long, seq long, ms long, zone string").coalesce(1)
        out = dec.latest_zone(spark.createDataFrame(frames, "session long, seq long, ms long"), readings)
        assert {(r.session, r.zone) for r in out.collect()} == {(1, "c"), (2, "z5")}


def test_attempts_stop_at_the_first_confident_one(spark):
    data = [(1, 0, 0.2), (1, 1, 0.2), (1, 2, 0.1), (2, 0, 0.1), (2, 1, 0.7), (2, 2, 0.9), (3, 0, 0.8)]
    got = {r.qid: (r.attempt, r.conf) for r in dec.best_attempt(spark.createDataFrame(data, "qid long, attempt int, conf double")).collect()}
    assert got == {1: (0, 0.2), 2: (1, 0.7), 3: (0, 0.8)}


def test_ring_and_hint(spark):
    out = dec.ring(spark.createDataFrame([(1, i, i * 500) for i in range(7)], "session long, seq long, ms long")).orderBy("seq").collect()
    assert out[-1].fresh == [3, 4, 5, 6] and out[1].fresh == [0, 1]
    assert spark.range(1).select(dec.hint(F.lit(False), F.lit(True), F.lit(True)).alias("h")).first().h == "zone_locked"


@pytest.mark.parametrize("need", [False, True])
def test_sessions_worked_on_together_agree_with_the_machine(need):
    """In micro-batches, with rows that come late or twice, resets, values that are missing, and times that go back."""
    rng, names = random.Random(5), ["session", "seq", "ms", "top_id", "zone_key", "conf", "ocr_zone", "reset"]
    obs = []
    for s in range(9):
        ms = 0
        for i in range(120):
            ms += rng.choice([200, 900, 3000, -2000 if s % 4 == 1 else 10])
            top = rng.choice(["a", "a", "a", "b", None])
            obs.append((s, i, ms, top, rng.choice([None, f"z{top}", f"z{top}"]), rng.choice([0.1, 0.3, None] if s % 2 else [0.1, 0.3, 0.7, 0.9]), rng.choice([None, "za", "za", "zb"]), s % 3 == 0 and rng.choice([None, False, i % 17 == 3])))
    obs.sort(key=lambda o: o[1] + rng.random() * 6)
    obs += rng.sample(obs, 40)
    states, got, single, want = {}, [], {}, []
    while obs:
        batch = pd.DataFrame([obs.pop(0) for _ in range(min(len(obs), rng.choice([1, 5, 60, 200])))], columns=names)
        got += _steps(batch.astype({"conf": float}), states, need).itertuples(index=False, name=None)
        for o in batch.astype(object).where(batch.notna(), None).sort_values(["session", "seq"], kind="stable").to_dict("records"):
            state = single.setdefault(o["session"], {"ring": [], "since": None, "last": -1})
            if o["seq"] > state["last"]:
                state["last"] = o["seq"]
                want.append((o["session"], o["seq"], *step(state, o, need)))
        assert states == single
    assert got == want and {r[3] for r in got} == {None, "ocrStable", "score"} and any(r[4] for r in got)


def test_stream_keeps_one_state_for_sessions_together(spark, tmp_path):
    """A micro-batch of 640 sessions takes 21 groups, not one for each session; one without a number is a session too."""
    obs = [(s, i, i * 3000, "a", "za", 0.3, None) for s in [*range(3, 643), None] for i in range(4)]
    spark.createDataFrame(obs, COLUMNS).write.parquet(f"{tmp_path}/in")
    out = decide_stream(spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in"))
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) == 22
    rows = spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out").collect()
    assert sorted((-1 if r.session is None else r.session, r.seq, r.confirmed, r.via, r.show_candidates) for r in rows) == sorted((-1 if s is None else s, i, None, None, i > 1) for s, i, *_ in obs)


def _by_the_machine(events):
    """scan_decisions_crowded of events (event_id, ms, user_id, event_type, value), one after the other."""
    names, states, out = [c.split()[0] for c in COLUMNS.split(", ")], {}, []
    for i, ms, user, kind, value in sorted(events, key=lambda e: e[0]):  # a stable sort
        s = user if user % 3 else 0
        o = (s, i, ms, kind, str(len(kind) % 3), min(value / 100, 1.0), str(i // 2 % 3) if i % 2 == 0 else None)
        out.append((s, i, *step(states.setdefault(s, {"ring": [], "since": None}), dict(zip(names, o, strict=True)), False)))
    return sorted(out, key=str)


def _decided(spark, path, files):
    (path / "events.parquet").mkdir()
    for k, events in enumerate(files):
        table = pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value"])
        table.assign(ts=pd.to_datetime(table["ts"], unit="ms").astype("datetime64[us]")).to_parquet(path / "events.parquet" / f"part-{k}.parquet", index=False)
    return sorted(map(tuple, QUERIES["scan_decisions_crowded"](spark, str(path)).collect()), key=str)


def test_events_of_one_number_keep_the_order_of_the_table(spark, tmp_path):
    """The files are the larger the later they come; Spark reads the largest first."""
    rng = random.Random(7)
    files = [[(i, rng.randrange(10**7), 3 * rng.randrange(3) + (rng.random() < 0.1), rng.choice(["view", "error"]), rng.uniform(0, 90)) for i in range(n)] for n in (300, 900, 2700)]
    assert _decided(spark, tmp_path, files) == _by_the_machine([e for f in files for e in f])


def test_large_numbers_are_halved_exactly(spark, tmp_path):
    """Numbers from 2^54 on aren't all doubles."""
    events = [((1 << 60) + i, i * 1000, 0, "view", 30.0) for i in range(600)]
    assert _decided(spark, tmp_path, [events]) == _by_the_machine(events)
