"""Chat formatting by multi-party perspective rotation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import table

#: Turns in one part of a rendering, at most; only longer dialogues have several parts.
CHUNK = 64
#: Turn numbers that are ranked together; says nothing about results.
RANGE = 64


def _spans(masked: bool) -> Column:
    """Fold the segments of a chunk into `start-end` marks, in code points of the whole rendering."""

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        take = s["mine"] if masked else ~s["mine"]
        marks = F.when(take, F.concat(acc["marks"], F.array(F.concat(start.cast("string"), F.lit("-"), end.cast("string"))))).otherwise(acc["marks"])
        return F.struct((end + F.length(s["tail"])).alias("at"), marks.alias("marks"))

    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("marks"))
    return F.aggregate("segments", zero, step, lambda acc: F.array_join(acc["marks"], ","))


def rotate(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           chunk: int | None = CHUNK, open_tag: str = "<|", close_tag: str = "|>", end_tag: str = "<|end|>\n") -> DataFrame:
    """The rendering of every dialogue from the perspective of each of its participants.

    Columns: conv_id, perspective (the participant who becomes the assistant), part, start, n_turns, n_own, text,
    loss_spans (code-point ranges of the assistant's words, where the mask is 1) and context_spans.
    Others appear as `user name=<speaker>`.

    There is one rendering, of the whole dialogue; `chunk` only says how it is stored. A dialogue of up to `chunk` turns
    is one row. A longer one is stored in parts 0, 1, ... whose texts, joined in order, are the rendering; start and the
    spans count from the beginning of the rendering, so that nothing hangs on where it is cut. Parts are cut by the place
    of a turn in its dialogue, whatever the numbers of turns. No group that is collected holds more than `chunk` turns,
    unless chunk is None, which gives whole dialogues as one row each. A very long text is rendered whole.

    A turn without a conversation is a dialogue of its own. A null speaker is named `unknown`; a null text is empty;
    a null turn sorts first. Equal turns go by speaker, then text; repeated rows stay. Marks that texts and names hold
    are broken by a space (`< |`), so that no turn can forge another's. An empty table gives no rows; other columns are ignored.
    """
    broken = lambda c: F.replace(F.replace(c, F.lit(open_tag), F.lit(" ".join(open_tag))), F.lit(close_tag), F.lit(" ".join(close_tag)))
    base = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        broken(F.coalesce(F.col(speaker), F.lit("unknown"))).alias("speaker"), broken(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    mine_tag, tail = f"{open_tag}assistant{close_tag}", F.lit(end_tag)
    alone = base.where("conv_id is null").select(
        "conv_id", F.col("speaker").alias("perspective"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"),
        F.lit(1).cast("long").alias("n_turns"), F.lit(1).cast("long").alias("n_own"), F.concat(F.lit(mine_tag), "body", tail).alias("text"),
        F.concat(F.lit(f"{len(mine_tag)}-"), (F.length("body") + len(mine_tag)).cast("string")).alias("loss_spans"), F.lit("").alias("context_spans"),
    )
    base = base.where("conv_id is not null")
    who = base.groupBy("conv_id", "speaker").agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
    # turns are ranked within ranges of their numbers, and the ranges' counts run up, so that no task sorts a long dialogue
    base = base.withColumn("range", F.greatest(F.floor(F.coalesce("turn", F.lit(0)) / RANGE), F.lit(0)).cast("long"))
    if chunk is None:
        base = base.withColumn("cut", F.lit(0).cast("long"))
    else:
        before = F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
        counts = base.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where("before > 0")
        counts = counts.select(F.col("conv_id").alias("_c"), F.col("range").alias("_r"), "before")
        base = base.withColumn("place", F.row_number().over(W.partitionBy("conv_id", "range").orderBy("turn", "speaker", "body")) - 1)
        base = base.join(counts, (F.col("conv_id") == F.col("_c")) & (F.col("range") == F.col("_r")), "left")
        base = base.withColumn("cut", F.floor((F.col("place") + F.coalesce("before", F.lit(0))) / chunk).cast("long"))
    parts = base.groupBy("conv_id", "cut").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "body"))).alias("rows"))
    seen = parts.join(who, F.col("conv_id") == F.col("c")).drop("c")
    mine = lambda s: s["speaker"] == F.col("perspective")
    segments = F.transform(
        "rows",
        lambda s: F.struct(
            F.when(mine(s), F.lit(mine_tag)).otherwise(F.concat(F.lit(f"{open_tag}user name="), s["speaker"], F.lit(close_tag))).alias("head"),
            s["body"].alias("body"), tail.alias("tail"), mine(s).alias("mine"),
        ),
    )
    seen = seen.select("conv_id", "perspective", F.col("cut").alias("part"), segments.alias("segments"))
    seen = seen.withColumn("text", F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], s["tail"])), ""))
    order = W.partitionBy("conv_id", "perspective").orderBy("part")
    before = F.sum(F.length("text").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    seen = seen.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))
    return seen.select(
        "conv_id", "perspective", "part", "start",
        F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["mine"])).cast("long").alias("n_own"),
        "text", _spans(True).alias("loss_spans"), _spans(False).alias("context_spans"),
    ).unionByName(alone)


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All perspectives of all conversations, as in rotate()."""
    return rotate(table(spark, sf_dir, "conversations"))


SQL = """
WITH base AS (
  SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS speaker,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS body FROM conversations),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1) // 64 AS cut FROM base WHERE conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM ranked),
seg AS (
  SELECT b.conv_id, w.perspective, b.cut AS part, b.speaker = w.perspective AS mine, body,
    CASE WHEN b.speaker = w.perspective THEN '<|assistant|>' ELSE '<|user name=' || b.speaker || '|>' END AS head,
    row_number() OVER (PARTITION BY b.conv_id, w.perspective ORDER BY turn NULLS FIRST, b.speaker, body) AS k
  FROM ranked b JOIN who w ON b.conv_id = w.conv_id),
off AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, perspective ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM seg),
s AS (SELECT *, o + length(head) AS s FROM off)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(min(o) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (mine) AS BIGINT) AS n_own,
  string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(body) AS BIGINT), ',' ORDER BY k) FILTER (mine), '') AS loss_spans,
  coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(body) AS BIGINT), ',' ORDER BY k) FILTER (NOT mine), '') AS context_spans
FROM s GROUP BY conv_id, perspective, part
UNION ALL
SELECT conv_id, speaker, 0, 0, 1, 1, '<|assistant|>' || body || '<|end|>' || chr(10), '13-' || (13 + length(body)), '' FROM base WHERE conv_id IS NULL
"""
