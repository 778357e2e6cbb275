import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as txt
from lodestar.operators.zones import match_zones

#: Names of zones.
JA = ["高地ドラヴァニア", "低地ドラヴァニア", "ドラヴァニア雲海", "クルザス西部高地", "クルザス中央高地", "アバラシア雲海", "ギラバニア湖畔地帯"]
KO = ["검은장막 숲 중부삼림", "검은장막 숲 동부삼림", "검은장막 숲 남부삼림", "얀샤"]
ZH = ["黑衣森林中央林区", "黑衣森林东部林区", "黑衣森林南部林区", "延夏", "迷津", "中萨纳兰", "西萨纳兰", "东萨纳兰", "北萨纳兰", "南萨纳兰"]
LATIN = ["Eastern Thanalan", "Western Thanalan", "Southern Thanalan", "Forêt centrale", "Forêt du sud", "Forêt de l'est"]


#: Readings of names and what they must match, as (text, script, zones, match).
READINGS = [
    ("ドラ ヴァ ニア 青海", "ja", JA, "ドラヴァニア雲海"), ("クル ザス 西部 高地", "ja", JA, "クルザス西部高地"), ("ウタ クン 88 癌 攻守", "ja", JA, None), ("", "ja", JA, None),
    ("アバラシア雲海", "ja", JA, "アバラシア雲海"), ("Eastem Thanalan", "latin", LATIN, "Eastern Thanalan"), ("Foret centrale", "latin", LATIN, "Forêt centrale"),
    ("검은장막 숲 중부삼림", "ko", KO, "검은장막 숲 중부삼림"), ("얀샤", "ko", KO, "얀샤"), ("黑衣森林 中央林区", "zh", ZH, "黑衣森林中央林区"), ("延夏", "zh", ZH, "延夏"), ("迷津", "zh", ZH, "迷津"),
    ("中辽纳兰", "zh", ZH, "中萨纳兰"),
]


@pytest.mark.parametrize("script", ["ja", "ko", "zh", "latin"])
def test_zone_match(spark, script):
    some = [r for r in READINGS if r[1] == script]
    z = spark.createDataFrame([(n, i) for i, n in enumerate(some[0][2])], "zone string, ord int")
    out = match_zones(spark.createDataFrame([(r[0],) for r in some], "text string"), z, script)
    assert {r.text: r.zone for r in out.collect()} == {r[0]: r[3] for r in some}


def test_empty_zone_is_skipped_and_ties_are_refused(spark):
    z = spark.createDataFrame([("!!!", 0), ("abcdef", 1), ("abcdef", 2)], "zone string, ord int")
    r = match_zones(spark.createDataFrame([("abcdef",)], "text string"), z, "latin").first()
    assert r.zone is None and r.gap == 0 and abs(r.score - 1.25) < 1e-12


def test_normalise(spark):
    row = spark.range(1).select(
        txt.normalise(F.lit("Forêt Straße 12!"), "latin").alias("a"), txt.normalise(F.lit("高地 12 ドラ!"), "ja").alias("b"), txt.normalise(F.lit("얀샤 x"), "ko").alias("c"),
        txt.filled(F.lit("{n} of {n} {m}"), {"n": F.lit(3), "m": F.lit("x")}).alias("d"), txt.script_of(F.lit("de")).alias("e"), txt.script_of(F.lit("ko")).alias("f"),
        txt.pick_language(F.lit("xx"), F.array(F.lit("pt-BR"), F.lit("fr-CA"))).alias("g"), txt.dice(F.lit("a"), F.lit("ab")).alias("h"), txt.common_prefix(F.lit("abx"), F.lit("aby")).alias("i"),
        txt.location_text(F.lit("Zone A"), F.lit(12.34), F.lit(5.6)).alias("j"), txt.is_image_mime(F.lit("image/png")).alias("k"), txt.dice_n(F.lit(""), F.lit("a"), 1).alias("l"),
    ).first()
    assert list(row) == ["foretstrasse", "高地ドラ", "얀샤", "3 of 3 x", "latin", "ko", "fr", pytest.approx(2 / 3), 2, "Zone A (X:12.3, Y:5.6)", True, 0.0]


@pytest.mark.parametrize("script", ["latin", "ja"])
def test_best_two_zones_are_those_of_a_comparison_with_all(spark, script):
    """Random short names over few letters: many equal scores, single letters, common beginnings and none."""
    import random

    from lodestar.operators import zones as zon

    rng = random.Random(8)
    letters = "abcd" if script == "latin" else "アイウカ"
    name = lambda n: "".join(rng.choice(letters) for _ in range(n))
    zones = [name(rng.choice([1, 2, 3, 4, 6, 9])) for _ in range(60)] + ["!!!"]
    texts = [name(rng.randrange(12)) for _ in range(80)] + [z + name(2) for z in zones[:20]] + ["x" * 5 if script == "latin" else "ン" * 5]

    def bag(s, n):
        out = {}
        for i in range(len(s) - n + 1):
            out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
        return out

    def dice(a, b):
        n = 2 if len(a) >= 2 and len(b) >= 2 else 1
        x, y = bag(a, n), bag(b, n)
        return 2 * sum(min(c, y.get(g, 0)) for g, c in x.items()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0

    def ones(a, b):
        x, y = bag(a, 1), bag(b, 1)
        return 2 * sum(min(c, y.get(g, 0)) for g, c in x.items()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0

    def score(t, z):
        h = t[: len(z)]
        s = max(dice(t, z), dice(h, z))
        s = s if script == "latin" else max(s, 0.9 * max(ones(t, z), ones(h, z)))
        same = next((i for i, (a, b) in enumerate(zip(t, z, strict=False)) if a != b), min(len(t), len(z)))
        return s + 0.25 * same / len(z)

    want = {}
    for t in set(texts):
        ranked = sorted(((-score(t, z), i) for i, z in enumerate(zones) if z != "!!!"), key=lambda r: (round(r[0], 12), r[1])) if len(t) >= (3 if script == "latin" else 2) else []
        ranked = [r for r in ranked if r[0] < 0]
        if ranked:
            best, second = -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else 0.0
            sure = best >= 0.4 and best - second >= 0.06
            want[t] = (zones[ranked[0][1]] if sure else None, round(best, 9), round(best - second, 9))
        else:
            want[t] = (None, None, None)
    frame = spark.createDataFrame([(z, i) for i, z in enumerate(zones)], "zone string, ord int")
    out = zon.match_zones(spark.createDataFrame([(t,) for t in texts], "text string"), frame, script)
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {r.text: (r.zone, None if r.score is None else round(r.score, 9), None if r.gap is None else round(r.gap, 9)) for r in out.collect()}
    assert got == want
