"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import n_words, running_total, sized_broadcast, table, written

#: Words of a block.
BLOCK = 1024
#: The weights that sources take in turn, by code point of their name, null last.
WEIGHTS = (3, 1, 2)
#: The mix holds this multiple of all words; no source more than CAP times its own.
SHARE, CAP = 1.5, 2
#: Golden-ratio points are i * STEP mod POINTS.
STEP, POINTS = 1327217885, 1 << 31
#: Cells of the unit interval by which points find their source.
CELLS = 1024
SPAN = 1 << 60


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the words of each document and its place in the shuffle, a hash of id and size."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    name = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return sized.withColumn("h", F.conv(F.substr(F.md5(name), F.lit(1), F.lit(15)), 16, 10).cast("long"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: sid, source, docs, source_size, weight, target.

    A target is weight * level, at most cap * source_size; the level makes the targets add up to share * all words.
    Sorted by cap over weight, the sources below the level stop at their cap, so the level follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    every = W.partitionBy(F.lit(1))
    turn = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("sid", turn.cast("long")).withColumn("weight", F.get(F.array(*map(F.lit, map(float, weights))), turn % len(weights)))
    per = per.withColumn("most", cap * F.col("source_size").cast("double"))
    above = every.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rest = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(above), zero)
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(above), zero))
    per = per.withColumn("level", level).withColumn("stops", F.col("most") < F.col("weight") * F.col("level"))
    open_ = F.min(F.when(~F.col("stops"), F.struct((F.col("most") / F.col("weight")).alias("r"), "sid", "level"))).over(every)
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * open_["level"])
    return per.select("sid", "source", "docs", "source_size", "weight", F.coalesce(target, zero).alias("target"))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank, start, stop): slot i takes the rank-th block of source sid, words start..stop-1 of its shuffled stream.

    Slot i's golden-ratio point falls into one source's interval of the cumulated targets. A source's slots are ranked;
    those beyond its target are left out, and the few that low discrepancy still owes it come last.
    """
    spark = goals.sparkSession
    goals = goals.withColumn("goal", F.floor("target").cast("long"))
    need = F.ceil(F.col("goal") / block).cast("long")
    every = W.partitionBy(F.lit(1))
    edge = F.sum("goal").over(every.orderBy("sid"))
    marks = goals.withColumn("hi", edge / F.sum("goal").over(every)).withColumn("need", need).where("goal > 0")
    marks = marks.withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("sid")), F.lit(0.0)))
    total = goals.agg(F.coalesce(F.sum(need), F.lit(0))).first()[0]
    cells = marks.select("sid", "lo", "hi", "need", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = (F.expr(f"pmod((id % {POINTS}L) * {STEP}L, {POINTS}L)") / float(POINTS)).cast("double")
    slots = spark.range(total).withColumn("p", point).withColumn("cell", F.floor(F.col("p") * CELLS))
    found = slots.join(sized_broadcast(cells), "cell").where("p >= lo and p < hi").select(F.col("id").alias("slot"), "sid", "need", F.lit(1).cast("long").alias("one"))
    ranked = running_total(found, "sid", "slot", [], "one", int(total), max(1, int(total))).withColumnRenamed("before", "rank")
    kept = ranked.where("rank < need").select("slot", "sid", "rank")
    had = found.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    owed = marks.select("sid", "need").join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)).cast("long")).where("had < need")
    owed = owed.select("sid", F.explode(F.sequence("had", F.col("need") - 1)).alias("rank")).select((F.col("rank") + total).alias("slot"), "sid", "rank")
    full = kept.union(owed).join(sized_broadcast(goals.select("sid", "goal")), "sid")
    return full.select("slot", "sid", "rank", (F.col("rank") * block).alias("start"), F.least((F.col("rank") + 1) * block, F.col("goal")).alias("stop"))


def placed(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized with sid, source_size, target and `before`: where the document starts in its source's shuffled stream."""
    names = goals.select(F.col("source").alias("_s"), "sid", "source_size", "target", "docs")
    rows = sized.join(sized_broadcast(names), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "docs")
    n = goals.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    return running_total(rows, "sid", "h", ["doc_id", "size"], "size", int(n), SPAN)


def pieces(places: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, before, start, stop): the words of the document at `before` that slot takes, counted from its beginning."""
    some = places.where("size > 0").select("sid", "before", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))).alias("epoch"))
    some = some.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("before"))
    cut = some.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    met = cut.join(slots.select("slot", "sid", "rank", F.col("start").alias("b0"), F.col("stop").alias("b1")), ["sid", "rank"])
    start, stop = F.greatest("b0", "at") - F.col("at"), F.least(F.col("b1"), F.col("at") + F.col("size")) - F.col("at")
    return met.select("slot", "sid", "before", start.alias("start"), stop.alias("stop")).where("start < stop")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot (the first slot of the schedule that
    holds words of it, null if none does): ordered by slot, the documents' pieces are the mix.

    Null texts have size 0; a null source is a source of its own, last; an empty table gives no rows; documents of size 0
    take nothing; repeated rows are documents of their own (which of two equal rows is taken more is left open, their
    rows together agree in every run). Other columns are ignored. Each source's taken words add up to floor(target).
    """
    sized = written(sizes(docs), "sizes")
    goals = written(targets(sized), "targets")
    places = written(placed(sized, goals), "places")
    taken = pieces(places, schedule(goals, block), block).groupBy("sid", "before").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.select(F.col("sid").alias("_s"), F.col("before").alias("_b"), "taken", "first_slot")
    both = places.join(taken, (F.col("sid") == F.col("_s")) & (F.col("before") == F.col("_b")) & (F.col("size") > 0), "left")
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (SELECT *, CAST('0x' || substr(md5(concat_ws(' ', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))), 1, 15) AS BIGINT) AS h
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)),
per AS (SELECT *, [3.0, 1.0, 2.0][sid % 3 + 1] AS weight, 2 * CAST(source_size AS DOUBLE) AS most
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source)),
lev AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM per WINDOW o AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open AS (SELECT level FROM lev WHERE NOT most < weight * level ORDER BY most / weight, sid LIMIT 1),
goals AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM (SELECT source, source_size, sid,
  coalesce(CASE WHEN most < weight * level THEN most ELSE weight * (SELECT level FROM open) END, 0.0) AS target FROM lev)),
marks AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0.0) AS lo FROM (SELECT sid, goal, (goal + 1023) // 1024 AS need,
  sum(goal) OVER (ORDER BY sid) / CAST(sum(goal) OVER () AS DOUBLE) AS hi FROM goals) WHERE goal > 0),
total AS (SELECT CAST(coalesce(sum(need), 0) AS BIGINT) AS t FROM marks),
points AS (SELECT i, (i * 1327217885 % 2147483648) / 2147483648.0 AS p FROM (SELECT unnest(range(0, t)) AS i FROM total)),
slots AS (SELECT sid, i AS slot, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM points JOIN marks ON p >= lo AND p < hi),
places AS (SELECT s.*, g.sid, g.source_size, g.target, g.goal,
  sum(size) OVER (PARTITION BY g.sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (SELECT *, CAST(least(greatest(goal - before, 0), size) + least(greatest(goal - source_size - before, 0), size) AS BIGINT) AS taken FROM places)
SELECT doc_id, source, size, source_size, target, taken,
  CAST(CASE WHEN taken > 0 THEN coalesce(slots.slot, before // 1024 + (SELECT t FROM total)) END AS BIGINT) AS first_slot
FROM taken LEFT JOIN slots ON slots.sid = taken.sid AND slots.rank = before // 1024
"""
