"""Decisions over observation sequences, attempts and as-of side inputs, as window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators.catalog_view import numbered

#: Observations that count, hits needed, those checked for another zone, those that must agree,
#: least confidence of the last rule, and the time-outs in ms.
RECENT, HITS, CONFLICT, STABLE, STABLE_LEAST, CONFIDENT = 5, 2, 3, 4, 0.25, 0.6
PATIENCE_MS, ZONE_TTL_MS, SMALL = 5000, 8000, 0.3
#: Fixed value: least time between two readings of text in a live scan.
READ_EVERY_MS = 2000
#: Rows of a session that a task sorts, at most, and buckets that the life of a reading is cut into.
SEGMENT, TTL_PARTS = 100_000, 8


def _segments(rows: DataFrame, size: int, ties: list[str]) -> DataFrame:
    """rows without ties, with their place _n in the order of session, seq and ties, and the segment _seg of `size` places they are in."""
    return numbered(rows, ["session", "seq", *ties], "_n").drop(*ties).withColumn("_seg", F.floor(F.col("_n") / size).cast("long"))


def _lives(rows: DataFrame) -> DataFrame:
    """rows of _segments() without those with reset, each session cut at these into lives of their own.

    Resets are counted within segments, and the segments' totals run up: no window holds a whole session's rows.
    """
    blank = F.coalesce("reset", F.lit(False)).cast("int")
    totals = rows.groupBy("session", "_seg").agg(F.sum(blank).alias("_t"))
    run = W.partitionBy("session").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(run), F.lit(0))).where("_before > 0").select(F.col("session").alias("_s"), F.col("_seg").alias("_g"), "_before")
    local = F.sum(blank).over(W.partitionBy("session", "_seg").orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("_local", local).join(before, (F.col("session") == F.col("_s")) & (F.col("_seg") == F.col("_g")), "left")
    life = F.col("_local") + F.coalesce("_before", F.lit(0))
    return out.where(blank == 0).withColumn("session", F.struct("session", life.alias("life"))).drop("reset", "_local", "_s", "_g", "_before")


def decide(rows: DataFrame, require_zone: bool = False, segment: int = SEGMENT, ties: list[str] | None = None) -> DataFrame:
    """rows (session, seq, ms, top_id, zone_key, conf, ocr_zone, optional reset) with confirmed, via and show_candidates.

    Sessions are cut into segments of `segment` rows at most, with the last rows of the segment before as context, since
    no rule but the time-out looks farther back. The start of low confidence is found within segments and carried from
    one to the next by one row each. So a task sorts a segment, however long the session. A row with reset forgets what
    came before it in its session, and decides nothing. Rows of a session with the same seq are taken in the order of
    the columns `ties`, which have to tell them apart if the result is to be the same each time.
    """
    segment = max(segment, RECENT)
    placed = _segments(rows, segment, ties or [])
    if "reset" in rows.columns:
        kept = _decided(_lives(placed), require_zone, segment).withColumn("session", F.col("session.session"))
        none = F.lit(None).cast("string")
        blank = F.coalesce("reset", F.lit(False))
        return kept.unionByName(rows.where(blank).select("session", "seq", none.alias("confirmed"), none.alias("via"), F.lit(False).alias("show_candidates")))
    return _decided(placed, require_zone, segment)


def _decided(placed: DataFrame, require_zone: bool, segment: int) -> DataFrame:
    context = placed.where(F.pmod("_n", F.lit(segment)) >= segment - RECENT + 1).withColumns({"_seg": F.col("_seg") + 1, "_own": F.lit(False)})
    both = placed.withColumn("_own", F.lit(True)).unionByName(context)
    part = W.partitionBy("session", "_seg").orderBy("_n")
    has = F.col("top_id").isNotNull()
    sure = has & (F.col("conf") >= CONFIDENT)
    x = both.withColumn("sure", F.coalesce(sure, F.lit(False)))
    x = x.withColumn("cid", F.when(F.col("sure"), F.col("top_id"))).withColumn("czone", F.when(F.col("sure"), F.col("zone_key")))
    same = F.lit(True)
    for k in range(1, STABLE):
        same = same & F.coalesce(F.lag("top_id", k).over(part) == F.col("top_id"), F.lit(False))
    agrees = F.coalesce(F.col("ocr_zone") == F.col("zone_key"), F.lit(False))
    x = x.withColumn("by_zone", has & agrees & F.coalesce(F.col("conf") >= STABLE_LEAST, F.lit(False)) & same)
    last5, last3 = F.collect_list("cid").over(part.rowsBetween(1 - RECENT, 0)), F.collect_list("czone").over(part.rowsBetween(1 - CONFLICT, 0))
    x = x.withColumn("ids", last5).withColumn("zones", last3)
    hits = F.size(F.filter("ids", lambda i: i == F.col("cid"))) >= HITS
    clash = F.exists("zones", lambda z: z != F.col("zone_key"))
    ok = F.lit(True) if not require_zone else agrees
    x = x.withColumn("by_score", F.col("sure") & ~F.col("by_zone") & ok & hits & ~clash).where("_own")
    x = x.withColumn("reset", F.col("sure") | F.col("by_zone"))
    x = x.withColumn("island", F.sum(F.col("reset").cast("int")).over(part.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("session", "_seg", "island").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("since", F.min(F.when(~F.col("reset"), F.col("ms"))).over(run))
    # what a segment hands on: whether it holds a reset, and the least time since its last one
    ends = x.groupBy("session", "_seg", "island").agg(F.min(F.when(~F.col("reset"), F.col("ms"))).alias("least")).groupBy("session", "_seg").agg(F.max(F.struct("island", "least")).alias("e"))
    line = W.partitionBy("session").orderBy("_seg")
    ends = ends.withColumn("group", F.sum((F.col("e.island") > 0).cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    upto = F.min("e.least").over(W.partitionBy("session", "group").orderBy("_seg").rowsBetween(W.unboundedPreceding, 0))
    ends = ends.withColumn("upto", upto).withColumn("carried", F.lag("upto").over(line)).where("carried is not null")
    ends = ends.select(F.col("session").alias("_s"), F.col("_seg").alias("_g"), "carried")
    x = x.join(ends, (F.col("session") == F.col("_s")) & (F.col("_seg") == F.col("_g")), "left")
    since = F.when(F.col("island") == 0, F.least("since", "carried")).otherwise(F.col("since"))
    done = F.col("by_zone") | F.col("by_score")
    return x.select(
        "session", "seq", F.when(done, F.col("top_id")).alias("confirmed"),
        F.when(F.col("by_zone"), "ocrStable").when(F.col("by_score"), "score").alias("via"),
        (~F.col("reset") & (F.col("ms") - since >= PATIENCE_MS)).alias("show_candidates"),
    )


def latest_zone(frames: DataFrame, zones: DataFrame, ttl_ms: int = ZONE_TTL_MS, parts: int = TTL_PARTS) -> DataFrame:
    """frames (session, seq, ms) with zone: the last one read before or at that moment, if less than ttl_ms ago.

    Both inputs are laid on a time line that is cut into buckets of a `parts`-th of ttl_ms. The last reading of a bucket
    is handed to the next `parts` buckets, one row each, beyond which it has expired; within a bucket it is carried
    forward. So a task sorts a bucket of a session, however long or busy the session, and no pairs are made. Of readings
    of the same moment the one of the largest seq counts, of those with the same seq the one of the largest zone.
    """
    width = -(-ttl_ms // parts)
    bucket = F.floor(F.col("ms") / width).cast("long")
    reading = zones.select("session", "ms", "seq", F.lit(0).alias("kind"), F.col("zone").cast("string").alias("zone"), bucket.alias("bucket"))
    both = frames.select("session", "ms", "seq", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("zone"), bucket.alias("bucket")).unionByName(reading.withColumn("kind", F.lit(1)))
    lasts = reading.groupBy("session", "bucket").agg(F.max(F.struct("ms", "seq", "zone")).alias("r"))
    handed = lasts.select("session", F.explode(F.sequence(F.col("bucket") + 1, F.col("bucket") + parts)).alias("bucket"), "r")
    handed = handed.groupBy("session", "bucket").agg(F.max("r").alias("r")).select("session", "r.ms", "r.seq", F.lit(0).alias("kind"), "r.zone", "bucket")
    line = W.partitionBy("session", "bucket").orderBy("ms", "kind", "seq", "zone").rowsBetween(W.unboundedPreceding, 0)
    read = F.last(F.when(F.col("kind") < 2, F.struct("ms", "zone")), ignorenulls=True).over(line)
    out = both.unionByName(handed).withColumn("read", read).where("kind = 2")
    return out.select("session", "seq", "ms", F.when(F.col("ms") - F.col("read.ms") < ttl_ms, F.col("read.zone")).alias("zone"))


def best_attempt(rows: DataFrame) -> DataFrame:
    """rows (qid, attempt, conf): the attempt taken. Attempts stop at the first confident one; an earlier one stays on ties."""
    before = W.partitionBy("qid").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    tried = rows.withColumn("over", F.coalesce(F.max((F.col("conf") >= CONFIDENT).cast("int")).over(before), F.lit(0)) == 1).where(~F.col("over"))
    best = tried.groupBy("qid").agg(F.max(F.struct("conf", (-F.col("attempt")).alias("first"))).alias("b"), F.count(F.lit(1)).alias("tried"))
    return best.select("qid", (-F.col("b.first")).alias("attempt"), F.col("b.conf").alias("conf"), "tried")


def consecutive_duplicates(rows: DataFrame, key: str, session: str, seq: list[str]) -> DataFrame:
    """rows with repeated: whether key is that of the session's row just before."""
    return rows.withColumn("repeated", F.coalesce(F.lag(key).over(W.partitionBy(session).orderBy(*seq)) == F.col(key), F.lit(False)))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only the newest row of each key (what came meanwhile is dropped); a max of structs, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]])


def ring(rows: DataFrame, size: int = 5, age_ms: int = 1600) -> DataFrame:
    """rows (session, seq, ms) with fresh: the last `size` rows not older than age_ms, as an array of seq."""
    recent = F.collect_list(F.struct("seq", "ms")).over(W.partitionBy("session").orderBy("seq").rowsBetween(1 - size, 0))
    return rows.withColumn("_r", recent).withColumn("fresh", F.transform(F.filter("_r", lambda r: F.col("ms") - r["ms"] <= age_ms), lambda r: r["seq"])).drop("_r")


def too_small(top_edge: Column, frame_width: Column) -> Column:
    """Whether the widget fills too little of the frame: its top edge is shorter than SMALL of the frame's width."""
    return F.coalesce(top_edge < F.lit(SMALL) * frame_width, F.lit(False))


def hint(low: Column, zone_locked: Column, small: Column) -> Column:
    """The message that goes first."""
    return F.when(low, "low_confidence").when(zone_locked, "zone_locked").when(small, "too_small").otherwise("default")
