import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import numeric as num
from lodestar.operators import similarity as sim


def brute(queries, variants, coarse, top, keep=lambda e: True):
    """Sequential form: the order of each window's sort carries over to the next."""
    mean = np.mean([v["vec"] for v in variants], 0)

    def ncc(a, b):
        a, b = a - mean, b - mean
        a, b = a - a.mean(), b - b.mean()
        d = (a * a).sum() * (b * b).sum()
        return 0.0 if (a * a).sum() <= 1e-9 or (b * b).sum() <= 1e-9 else float((a * b).sum() / np.sqrt(d))

    out = {}
    live = [v for v in variants if keep(v["entry"])]
    for qid, windows in queries.items():
        order, best = list(live), {}
        for w in windows:
            hd = {id(v): bin(w["p"] ^ v["p"]).count("1") + bin(w["d"] ^ v["d"]).count("1") for v in live}
            order = sorted(order, key=lambda v: hd[id(v)])
            for v in order[:coarse]:
                s = (ncc(w["vec"], v["vec"]), -hd[id(v)])
                best[v["entry"]] = max(best.get(v["entry"], (-9, -999)), s)
        rank = sorted(((-n, -h, e) for e, (n, h) in best.items()))
        out[qid] = [(e, round(-n, 9), h) for n, h, e in rank[:top]]
    return out


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    variants = [{"flat": i, "entry": i // 4, "p": int(rng.integers(0, 8)), "d": int(rng.integers(0, 4)), "vec": rng.integers(0, 255, 16).astype(float)} for i in range(40)]
    variants[7]["vec"] = np.full(16, 3.0)
    queries = {q: [{"p": int(rng.integers(0, 8)), "d": int(rng.integers(0, 4)), "vec": rng.integers(0, 255, 16).astype(float)} for _ in range(4)] for q in range(6)}
    vs = spark.createDataFrame([(v["flat"], v["entry"], v["p"], v["d"], v["vec"].tolist()) for v in variants], "flat long, entry int, p long, d long, vec array<double>")
    qs = spark.createDataFrame([(q, i, w["p"], w["d"], w["vec"].tolist()) for q, ws in queries.items() for i, w in enumerate(ws)], "qid long, w int, p long, d long, vec array<double>")
    return variants, queries, sim.with_units(vs, vs), sim.with_units(qs, vs)


@pytest.mark.parametrize("limit", [None, 3])
def test_match_equals_sequential_form(small, limit):
    variants, queries, vs, qs = small
    keep = None if limit is None else F.col("entry") < limit
    want = brute(queries, variants, 9, 3, (lambda e: True) if limit is None else (lambda e: e < limit))
    got = {}
    for r in sim.match(qs, vs, keep=keep, coarse=9).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.entry, round(r.ncc, 9), r.hamming))
    assert got == want


def test_catalogue_in_blocks(small, monkeypatch):
    """Several blocks give the same cut as one."""
    whole = sorted(map(tuple, sim.candidates(small[3], small[2], coarse=9).select("qid", "w", "flat", "hd", F.round("ncc", 9)).collect()))
    monkeypatch.setattr(sim, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, sim.candidates(small[3], small[2], coarse=9).select("qid", "w", "flat", "hd", F.round("ncc", 9)).collect())) == whole


def test_filter_that_keeps_nothing_is_an_error(small):
    with pytest.raises(ValueError):
        sim.match(small[3], small[2], keep=F.col("entry") < 0)


def test_single_candidate_has_full_margin(spark):
    r = spark.range(1).select(sim.confidence(F.lit(0.6), F.lit(None).cast("double")).alias("a"), sim.confidence(F.lit(0.6), F.lit(0.58)).alias("b"), sim.confidence(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("c")).first()
    assert r.a == pytest.approx(1.0) and r.b == pytest.approx(0.0, abs=1e-6) and r.c == 0.0


def test_numbers(spark):
    halves = [0.5, 1.5, 2.5, 3.5, -0.5, -1.5, 1.2, 1.8, -1.2, -1.8]
    df = spark.createDataFrame([(x,) for x in halves], "x double")
    assert [r[0] for r in df.select(num.half_even(F.col("x"))).collect()] == [0, 2, 2, 4, 0, -2, 1, 2, -1, -2]
    assert [r[0] for r in df.select(num.half_up(F.col("x"))).collect()] == [1, 2, 3, 4, 0, -1, 1, 2, -1, -2]
    row = spark.range(1).select(
        num.hex_bits(F.lit("ff00000000000000")).alias("a"), num.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("b"),
        num.percent(F.lit(0.876)).alias("c"), num.percent(F.lit(-0.5)).alias("d"), num.floor_percentile(F.array(*map(F.lit, (5, 1, 4, 2, 3))), 0.8).alias("e"),
        num.fit_within(F.lit(3840), F.lit(2160), F.lit(1200)).alias("f"), num.fit_within(F.lit(10000), F.lit(1), F.lit(1200)).alias("g"),
        num.cover_source_rect(F.lit(1000), F.lit(1000), F.lit(500.0), F.lit(500.0), F.struct(F.lit(50.0).alias("x"), F.lit(50.0).alias("y"), F.lit(400.0).alias("width"), F.lit(400.0).alias("height"))).alias("h"),
    ).first()
    assert row.a == -(1 << 56) and row.b == 64 and (row.c, row.d, row.e) == (88, 0, 5)
    assert tuple(row.f) == (1200, 675) and row.g.height == 1 and tuple(row.h) == (100, 100, 800, 800)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(num.guide_rect(F.lit(0.0), F.lit(100.0))).collect()


def test_raw_ncc(spark):
    r = spark.range(1).select(sim.raw_ncc(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 4, 6)))).alias("a"), sim.raw_ncc(F.array(*map(F.lit, (1, 1))), F.array(*map(F.lit, (2, 4)))).alias("b")).first()
    assert r.a == pytest.approx(1.0) and r.b == 0.0


def test_attempts_run_for_what_is_left(small):
    """Each attempt is given the queries that no earlier one made sure, and the best list of all that ran is taken."""
    from lodestar.operators import identify

    _, _, vs, qs = small
    given, sets = [], ({0, 1}, {3}, set())

    def attempt(k):
        def run(left):
            given.append(sorted({r.qid for r in left.collect()}))
            ranks = sim.match(left, vs, coarse=9).where("qid <> 5")
            sure = F.col("qid").isin(*sets[k]) if sets[k] else F.lit(False)
            return ranks.withColumn("confidence", F.when(sure, 0.9).when(F.col("qid") == 4, 0.1 + 0.1 * (k == 1)).otherwise(0.2))

        return run

    out = identify.staged_attempts(qs, [attempt(k) for k in range(3)]).collect()
    assert given == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5], [2, 4, 5]]
    assert {r.qid: (r.attempt, r.tried) for r in out} == {0: (0, 1), 1: (0, 1), 2: (0, 3), 3: (1, 2), 4: (1, 3)}
    assert all(sorted(r.rank for r in out if r.qid == q) == [1, 2, 3] for q in range(5))


def test_a_task_holds_few_pairs_at_a_time():
    """All pairs of 4,000 queries and their 48 nearest would take 200 MB of unit vectors at once; only what ranks need is handed on."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 4000, np.random.default_rng(3)
    unit = rng.normal(size=(n, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    p = rng.integers(0, 1 << 62, n)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), 64).cast(pa.list_(pa.float64()))
    common = {"p": pa.array(p), "d": pa.array(np.zeros(n, int)), "unit": vectors}
    asked = pa.table({"qid": pa.array(np.arange(n)), "w": pa.array(np.zeros(n, np.int32)), **common})
    block = pa.table({"flat": pa.array(np.arange(n)), "entry": pa.array(np.arange(n, dtype=np.int32) % 50), **common})
    tracemalloc.start()
    out = sim._nearest(["unit"], True, 48, 3)(asked, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 and out.num_rows == 4 * n
    q = 17
    h = np.bitwise_count(p ^ p[q])
    near = np.array([i for i in np.lexsort((np.arange(n), h)) if i != q][:48])
    best = {}
    for i in near:
        best[i % 50] = max(best.get(i % 50, (-9.0, 0)), (float(unit[q] @ unit[i]), -int(h[i])))
    want = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1]))[:4]
    got = sorted((r for r in out.to_pylist() if r["qid"] == q), key=lambda r: -r["ncc"])
    assert [(r["entry"], r["hamming"]) for r in got] == [(e, -h) for e, (_, h) in want]
