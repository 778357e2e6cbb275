"""Fuzzy match of recognised text with place names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.text import common_prefix, grams, normalise
from lodestar.sources.shared import stored

#: Least score, least lead over the runner-up, and least length of text by kind of script.
LEAST, LEAD, SHORTEST, SHORTEST_LATIN = 0.4, 0.06, 2, 3
#: What a wholly common beginning adds to a score, and the weight of single letters in other scripts.
BONUS, ONES = 0.25, 0.9
#: A text's rarest grams that give it a first score to beat.
SEEDS = 2


def tag_rows(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(column, pos, tag): the n-grams of distinct values of column in order, each tagged with how often it has occurred so far.

    Tagged, a bag is a set: bags overlap as far as their tags do, and the first k tags are those of a beginning.
    """
    base = rows.select(column).where(F.col(column).isNotNull()).distinct()
    each = base.select(column, F.posexplode(grams(F.col(column), n)).alias("pos", "g"))
    each = each.withColumn("k", F.row_number().over(W.partitionBy(column, "g").orderBy("pos")))
    return each.select(column, "pos", F.concat("g", F.lit("#"), F.col("k").cast("string")).alias("tag"))


def tagged(rows: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Distinct values of column with the array of their tags in order."""
    base = rows.select(column).where(F.col(column).isNotNull()).distinct()
    sets = tag_rows(rows, column, n).groupBy(column).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("s"))
    return base.join(sets, column, "left").select(column, F.coalesce(F.transform("s", lambda x: x["tag"]), F.array().cast("array<string>")).alias(out))


def _dice(a: Column, b: Column) -> Column:
    """Dice of two tagged bags; 0 if either is empty."""
    n = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / F.nullif(n, F.lit(0))).otherwise(0.0)


def zone_score(script: str) -> Column:
    """Similarity of text t and zone z, from columns t, z and their tagged grams t1, t2, z1, z2, plus a bonus for a common beginning; null for an empty zone."""
    lt, lz = F.length("t"), F.length("z")
    head = lambda c, n: F.slice(c, F.lit(1), F.greatest(lz - (n - 1), F.lit(0)))
    one = [_dice(F.col("t1"), F.col("z1")), _dice(head("t1", 1), F.col("z1"))]
    two = [_dice(F.col("t2"), F.col("z2")), _dice(head("t2", 2), F.col("z2"))]
    score = F.when((lt >= 2) & (lz >= 2), F.greatest(*two)).otherwise(F.greatest(*one))
    if script != "latin":
        score = F.greatest(score, ONES * F.greatest(*one))
    return score + BONUS * common_prefix(F.col("t"), F.col("z")) / F.nullif(lz, F.lit(0))


def _gram_index(t: DataFrame, z: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Tags of all texts (t, tag, rt, nt, rs) and zones (tag, z, rz, nz), written. rt and rz number a bag's tags from the one
    that fewest zones hold, rs those only that some zone holds, and nt and nz are the bags' sizes."""
    zt = tag_rows(z, "z", n)
    held = zt.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    own = lambda c: W.partitionBy(c).orderBy(F.coalesce("df", F.lit(0)), "tag")
    size = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    rank = lambda c: (F.row_number().over(own(c)) - 1).alias(f"r{c}")
    known = tag_rows(t, "t", n).join(held, "tag", "left")
    seen = F.sum((F.col("df") > 0).cast("int")).over(own("t").rowsBetween(W.unboundedPreceding, 0)).alias("rs")
    texts = known.select("t", "tag", rank("t"), size("t").alias("nt"), F.when(F.col("df") > 0, seen).alias("rs"), "df")
    zones = zt.join(held, "tag").select("tag", "z", rank("z"), size("z").alias("nz"))
    return stored(texts.where("df > 0").drop("df"), "text-grams"), stored(zones, "zone-grams")


def _met(index: tuple[DataFrame, DataFrame], least: DataFrame, share: float) -> DataFrame:
    """(t, z): pairs whose Dice, times `share`, and bonus may reach the least score (t, least) that counts for the text.

    Two bags of sizes nt and nz with that Dice have c tags or more in common (count filter). So they share one among the
    nt - c + 1 and nz - c + 1 that fewest zones hold (prefix filter), and longer lists of more common tags don't meet.
    Only a zone with the text's first letter has a bonus, of BONUS at most.
    """
    texts, zones = index
    bonus = F.when(F.substring("t", 1, 1) == F.substring("z", 1, 1), BONUS).otherwise(0.0)
    both = F.least("nt", "nz") + F.col("nz")  # at most as many as in any of the two bags compared with the zone's
    c = F.greatest(F.ceil((F.col("least") - bonus) / share * both / 2 - 1e-9), F.lit(1))
    near = texts.join(least, "t").join(zones, "tag").where((F.col("rt") <= F.col("nt") - c) & (F.col("rz") <= F.col("nz") - c))
    return near.select("t", "z").distinct()


def match_zones(texts: DataFrame, zones: DataFrame, script: str = "ja", least: float = LEAST, lead: float = LEAD) -> DataFrame:
    """(text, zone, score, gap): texts (text) against zones (zone, ord); zone is null if the match is weak or ambiguous.

    Distinct texts are compared once, by an inverted index of grams: zones that share one of a text's SEEDS rarest grams
    give a second best score that any other zone must reach; those that can by their grams' number and rarity, and the two
    shortest zones with the same first letter (which may have a bonus alone), are all that is scored. The best
    two are those of a comparison with all zones. Equal scores go to the earlier zone.
    """
    t = texts.select("text").distinct().withColumn("t", normalise(F.col("text"), script))
    z = zones.select("zone", "ord", normalise(F.col("zone"), script).alias("z")).where(F.length("z") > 0)
    shortest = SHORTEST_LATIN if script == "latin" else SHORTEST
    t, z = stored(t.where(F.length("t") >= shortest), "texts"), stored(z, "zones")
    # texts have two letters at least: single letters count with shorter zones, and with all of them in other scripts
    lone = z.where(F.length("z") < 2) if script == "latin" else z
    sizes = (2,) if lone.isEmpty() else (2, 1)
    ts, zs = tagged(t, "t", 2, "t2"), tagged(z, "z", 2, "z2")
    if len(sizes) == 1:
        none = F.array().cast("array<string>")
        ts, zs = ts.withColumn("t1", none), zs.withColumn("z1", none)
    else:
        ts, zs = ts.join(tagged(t, "t", 1, "t1"), "t"), zs.join(tagged(z, "z", 1, "z1"), "z")
    ts, zs = stored(ts, "text-bags"), stored(zs, "zone-bags")
    indexes = [_gram_index(t, z if n == 2 else lone, n) for n in sizes]

    def best(pairs: DataFrame) -> DataFrame:
        """(t, zone, score, rn): the best two zones of each text among the pairs."""
        scored = pairs.join(ts, "t").join(zs, "z").withColumn("score", zone_score(script)).where("score > 0").select("t", "z", "score")
        order = W.partitionBy("t").orderBy(F.col("score").desc(), "ord")
        return scored.join(z, "z").withColumn("rn", F.row_number().over(order)).where("rn <= 2").select("t", "zone", "score", "rn")

    seeds = [i[0].where(F.col("rs") <= SEEDS).join(i[1], "tag").select("t", "z") for i in indexes]
    second = best(reduce(DataFrame.union, seeds).distinct()).where("rn = 2").select("t", F.col("score").alias("least"))
    needed = stored(t.select("t").distinct().join(second, "t", "left").select("t", F.coalesce("least", F.lit(0.0)).alias("least")), "least")
    letter = W.partitionBy("a").orderBy(F.length("z"), "ord")
    short = z.withColumn("a", F.substring("z", 1, 1)).withColumn("rn", F.row_number().over(letter)).where("rn <= 2").select("a", "z")
    alone = t.select("t", F.substring("t", 1, 1).alias("a")).join(short, "a").select("t", "z")
    near = [_met(i, needed, 1.0 if n == 2 or script == "latin" else ONES) for n, i in zip(sizes, indexes, strict=True)]
    pairs = reduce(DataFrame.union, [*near, alone]).distinct()
    found = best(pairs).groupBy("t").agg(F.max(F.when(F.col("rn") == 1, F.struct("score", "zone"))).alias("b"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
    gap = F.col("b.score") - F.coalesce("second", F.lit(0.0))
    sure = (F.col("b.score") >= least) & (gap >= lead)
    found = found.select("t", F.when(sure, F.col("b.zone")).alias("zone"), F.col("b.score").alias("score"), gap.alias("gap"))
    found = t.join(found, "t").select(F.col("text").alias("_t"), "zone", "score", "gap")
    return texts.select("text").distinct().join(found, F.col("text") == F.col("_t"), "left").select("text", "zone", "score", "gap")
