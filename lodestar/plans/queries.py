"""Registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import numeric as num
from lodestar.functions import text as txt
from lodestar.operators import catalog_view as cat
from lodestar.operators import decisions as dec
from lodestar.operators import hash_index
from lodestar.operators import histogram as hist
from lodestar.operators import identify as ident
from lodestar.operators import similarity as sim
from lodestar.operators import zones as zon
from lodestar.plans import image_queries
from lodestar.sources import catalog as doc
from lodestar.sources import frames, images, reader
from lodestar.sources.shared import new_path
from lodestar.streaming import live, scan


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Identification. An embedding stands for a feature vector, its sign bits for the hash, its label for the entry.


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flat"), F.col("label").alias("entry"), F.col("embedding").alias("vec"))
    rows = e.withColumn("p", num.sign_bits(F.col("vec"))).withColumn("d", F.lit(0).cast("bigint"))
    return sim.with_units(rows, e).drop("vec")


def _queries(variants: DataFrame) -> DataFrame:
    return variants.select(F.col("flat").alias("qid"), F.lit(0).alias("w"), "p", "d", "unit")


def hamming_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest other by sign bits."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flat"), F.col("label").alias("entry"), num.sign_bits(F.col("embedding")).alias("p"), F.lit(0).cast("bigint").alias("d"))
    near = sim.candidates(v.select(F.col("flat").alias("qid"), F.lit(0).alias("w"), "p", "d"), v, other=True, coarse=1)
    return near.select(F.col("qid").alias("vec_id"), F.col("flat").alias("nearest"), F.col("hd").alias("hamming"))


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.mean_vector(_t(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("mean", 6).alias("mean"))


def centered_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each vector with the next one, both centred by the mean vector."""
    v = _variants(spark, sf_dir).select("flat", "unit")
    other = v.select((F.col("flat") - 1).alias("flat"), F.col("unit").alias("next"))
    return v.join(other, "flat").select(F.col("flat").alias("vec_id"), F.round(sim.dot(F.col("unit"), F.col("next")), 6).alias("ncc"))


def raw_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(other, "vec_id").select("vec_id", F.round(sim.raw_ncc(F.col("embedding"), F.col("next")), 6).alias("ncc"))


def _ranks(spark: SparkSession, sf_dir: str, keep=None, top: int = sim.TOP) -> DataFrame:
    v = _variants(spark, sf_dir)
    return sim.match(_queries(v), v, keep=keep, other=True, top=top)


def identify_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best labels of every vector."""
    return _ranks(spark, sf_dir).select(F.col("qid").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("entry").alias("label"), F.round("ncc", 6).alias("ncc"), F.col("hamming").cast("int").alias("hamming"))


def identify_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best label, confidence and whether it counts, of every vector."""
    out = sim.outcomes(_ranks(spark, sf_dir))
    return out.select(F.col("qid").alias("vec_id"), F.col("best").alias("label"), F.round("confidence", 5).alias("confidence"), num.percent(F.col("confidence")).alias("pct"), "is_confident")


def identify_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match with the catalogue narrowed to one zone (labels below 5) before the cut."""
    return _ranks(spark, sf_dir, keep=F.col("entry") < 5).select(F.col("qid").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("entry").alias("label"), F.round("ncc", 6).alias("ncc"), F.col("hamming").cast("int").alias("hamming"))


def identify_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse cut of three windows per vector (its halves zeroed in turn): ties go by the windows before."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flat"), F.col("label").alias("entry"), F.col("embedding").alias("vec"))
    half = lambda lo, hi: F.transform("vec", lambda x, i: F.when((i >= lo) & (i < hi), x).otherwise(F.lit(0.0)))
    v = e.withColumn("p", num.sign_bits(F.col("vec"))).withColumn("d", F.lit(0).cast("bigint"))
    w = e.select(F.col("flat").alias("qid"), F.posexplode(F.array(*[num.sign_bits(half(*x)) for x in ((0, 64), (0, 32), (32, 64))])).alias("w", "p")).withColumn("d", F.lit(0).cast("bigint"))
    cut = sim.candidates(w, v, other=True)
    return cut.groupBy("qid", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("hd").cast("bigint").alias("total"), F.sum(F.col("flat") * (F.col("hd") + 1)).cast("bigint").alias("digest")).select(F.col("qid").alias("vec_id"), F.col("w").cast("int").alias("w"), "n", "total", "digest")


def identify_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at every vector, by the signs of its first half, of its second half and of all of it, each for the vectors that none before made sure."""
    v = _variants(spark, sf_dir)
    masks = (0xFFFFFFFF, -(1 << 32), -1)

    def attempt(mask: int):
        def run(left: DataFrame) -> DataFrame:
            asked = left.withColumn("p", F.col("p").bitwiseAND(F.lit(mask).cast("long")))
            return sim.match(asked, v, other=True).withColumn("confidence", F.round("confidence", 9))

        return run

    out = ident.staged_attempts(_queries(v), [attempt(m) for m in masks])
    return out.select(F.col("qid").alias("vec_id"), "attempt", "tried", F.col("rank").cast("int").alias("rank"), F.col("entry").alias("label"), F.round("ncc", 6).alias("ncc"), F.col("hamming").cast("int").alias("hamming"))


def _stored(spark: SparkSession, variants: DataFrame) -> hash_index.HashIndex:
    """The variants as a stored catalogue whose zones are the labels' remainders by 5; only sign bits vary, so only they are indexed."""
    path = new_path(spark, "variants")
    hash_index.write(variants.withColumn("zone_key", F.concat(F.lit("z"), F.col("entry") % 5)), path, "zone_key", ("p",))
    return hash_index.HashIndex(spark, path, "zone_key", ("p",))


def identify_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match within one zone of a catalogue that is stored by zone: only that zone's folder is read."""
    v = _variants(spark, sf_dir)
    ranks = sim.match(_queries(v), _stored(spark, v).rows("z2"), other=True)
    return ranks.select(F.col("qid").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("entry").alias("label"), F.round("ncc", 6).alias("ncc"), F.col("hamming").cast("int").alias("hamming"))


def hamming_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors whose sign bits differ in 17 places at most, from the buckets of the hashes' bytes."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flat"), F.col("label").alias("entry"), num.sign_bits(F.col("embedding")).alias("p"), F.lit(0).cast("bigint").alias("d"))
    near = _stored(spark, v).within(v.select(F.col("flat").alias("vec_id"), "p", "d"), 17)
    return near.where("vec_id <> flat").select("vec_id", F.col("flat").alias("other"), F.col("hd").cast("int").alias("hamming"))


_SIGNS = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"
_MATCH = f"""
m AS (SELECT pos, avg(x) AS mean FROM (SELECT unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY pos),
ma AS (SELECT list(mean ORDER BY pos) AS mean FROM m),
s AS (SELECT vec_id, label, {_SIGNS} AS p, list_transform(list_zip(embedding, mean), lambda z: CAST(z[1] AS DOUBLE) - z[2]) AS v FROM embeddings, ma),
c AS (SELECT vec_id, label, p, list_transform(v, lambda x: x - list_avg(v)) AS v FROM s),
u AS (SELECT vec_id, label, p, CASE WHEN list_dot_product(v, v) > 1e-9 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE list_transform(v, lambda x: 0.0) END AS v FROM c),
cut AS (SELECT q.vec_id AS qid, v.label, hamming(q.p, v.p) AS hd, list_dot_product(q.v, v.v) AS ncc
  FROM u q JOIN u v ON q.vec_id <> v.vec_id %s QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.p, v.p), v.vec_id) <= 48),
best AS (SELECT qid, label, ncc, hd FROM cut QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY ncc DESC, hd) = 1),
ranks AS (SELECT *, row_number() OVER w AS rank, lead(ncc) OVER w AS next FROM best WINDOW w AS (PARTITION BY qid ORDER BY ncc DESC, hd, label))
"""
_TOP3 = "SELECT qid AS vec_id, CAST(rank AS INTEGER) AS rank, label, round(ncc, 6) AS ncc, CAST(hd AS INTEGER) AS hamming FROM ranks WHERE rank <= 3"


_STAGED = (
    _MATCH.split("cut AS (")[0] % ()
    + """t AS (SELECT vec_id AS qid, k, v, CASE k WHEN 0 THEN left(p, 32) || repeat('0', 32) WHEN 1 THEN repeat('0', 32) || right(p, 32) ELSE p END AS q FROM u, (SELECT unnest([0, 1, 2]) AS k)),
cut AS (SELECT qid, k, label, hamming(q, p) AS hd, list_dot_product(t.v, u.v) AS ncc FROM t JOIN u ON qid <> vec_id QUALIFY row_number() OVER (PARTITION BY qid, k ORDER BY hamming(q, p), vec_id) <= 48),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY qid, k, label ORDER BY ncc DESC, hd) = 1),
ranks AS (SELECT *, row_number() OVER w AS rank, lead(ncc) OVER w AS next FROM best WINDOW w AS (PARTITION BY qid, k ORDER BY ncc DESC, hd, label)),
conf AS (SELECT qid, k, round(sqrt(greatest(0, least(1, (ncc - 0.45) / 0.15)) * greatest(0, least(1, (CASE WHEN next IS NULL THEN 1.0 ELSE ncc - next END - 0.02) / 0.04))), 9) AS c FROM ranks WHERE rank = 1),
live AS (SELECT * FROM conf a WHERE NOT EXISTS (SELECT 1 FROM conf b WHERE b.qid = a.qid AND b.k < a.k AND b.c >= 0.6)),
one AS (SELECT qid, k, count(*) OVER (PARTITION BY qid) AS tried FROM live QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, k) = 1)
SELECT qid AS vec_id, CAST(k AS INTEGER) AS attempt, tried, CAST(rank AS INTEGER) AS rank, label, round(ncc, 6) AS ncc, CAST(hd AS INTEGER) AS hamming FROM ranks JOIN one USING (qid, k) WHERE rank <= 3"""
)


# Text.


_ROMAN, _KANA = "abcdefghijklmnopqrstuvwxyz", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"


def _noisy_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = _t(spark, sf_dir, "part").select("p_name").distinct()
    zones = names.select(F.col("p_name").alias("zone"), F.col("p_name").alias("ord"))
    cut = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.concat(F.substring("p_name", F.lit(1), i - 1), F.substring("p_name", i + 1, F.length("p_name"))))
    return names.select(F.explode(cut).alias("text")), zones


def zone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name with one letter lost, matched with all part names."""
    texts, zones = _noisy_names(spark, sf_dir)
    out = zon.match_zones(texts, zones, "latin")
    return out.select("text", "zone", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


def zone_match_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_match with all names written in kana, a letter for a letter, where single letters count as well."""
    texts, zones = _noisy_names(spark, sf_dir)
    kana = lambda c: F.translate(F.lower(c), _ROMAN, _KANA)
    out = zon.match_zones(texts.select(kana("text").alias("text")).distinct(), zones.select(kana("zone").alias("zone"), "ord"), "ja")
    return out.select("text", "zone", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


def zone_match_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts against part names: long texts that name none of them are refused."""
    zones = _noisy_names(spark, sf_dir)[1]
    return zon.match_zones(_t(spark, sf_dir, "benchmark").select("text"), zones, "latin").select("text", "zone")


def _loads():
    """A recogniser of bands that hold a status and the bytes of a text: it raises an error, finds nothing or is too slow where these say so."""
    import time

    def read(band):
        how, text = band[0, 0], band[0, 1:].tobytes().decode()
        if how == 1:
            raise ValueError("can't be read")
        if how == 2:
            time.sleep(5)
        return None if how == 3 else text

    return read


def zone_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names without their second letter, read within a second each and matched with all part names: the largest parts can't be read,
    every five hundredth takes too long, and the smallest show no text."""
    part, zones = _t(spark, sf_dir, "part"), _noisy_names(spark, sf_dir)[1]
    how = F.when(F.col("p_size") == 50, "01").when(F.col("p_partkey") % 500 == 7, "02").when(F.col("p_size") == 1, "03").otherwise("00")
    text = F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"))
    bands = part.select(F.col("p_partkey").alias("id"), F.concat(F.unhex(how), F.encode(text, "utf-8")).alias("data"))
    bands = bands.select("id", F.octet_length("data").alias("width"), F.lit(1).alias("height"), "data")
    return reader.zone_readings(bands, _loads, "part names", zones, "latin", 1000, lanes=8).select(F.col("id").cast("bigint").alias("p_partkey"), "text", "status", "zone")


def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in Latin normal form, as length and hash."""
    return _t(spark, sf_dir, "documents").withColumn("t", txt.normalise(F.col("text"), "latin")).select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("sha"))


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the bigrams of part names."""
    names = _t(spark, sf_dir, "part").select("p_name")
    return names.select(F.explode(txt.grams(F.col("p_name"), 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice similarity of all nation and region names, with their common beginning."""
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("a"))
    r = _t(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("b"))
    return n.join(F.broadcast(r)).select("n_nationkey", "r_regionkey", F.round(txt.dice(F.col("a"), F.col("b")), 6).alias("dice"), txt.common_prefix(F.col("a"), F.col("b")).cast("int").alias("prefix"))


_ZSCORE = """
names AS (SELECT DISTINCT p_name FROM part),
zones AS (SELECT p_name AS zone, row_number() OVER (ORDER BY p_name) AS ord, regexp_replace(strip_accents(replace(lower(p_name), 'ß', 'ss')), '[^a-z]', '', 'g') AS z FROM names),
t AS (SELECT text, regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z]', '', 'g') AS t FROM texts),
pair AS (SELECT text, zone, ord, t, z, left(t, length(z)) AS h FROM t, zones WHERE length(t) >= 3),
forms AS (SELECT DISTINCT s FROM (SELECT t AS s FROM pair UNION SELECT h FROM pair UNION SELECT z FROM pair)),
g1 AS (SELECT s, g, count(*) AS n FROM (SELECT s, substr(s, unnest(range(1, length(s) + 1)), 1) AS g FROM forms) GROUP BY s, g),
g2 AS (SELECT s, g, count(*) AS n FROM (SELECT s, substr(s, unnest(range(1, length(s))), 2) AS g FROM forms WHERE length(s) >= 2) GROUP BY s, g),
ab AS (SELECT DISTINCT t AS a, z AS b FROM pair UNION SELECT DISTINCT h, z FROM pair),
o2 AS (SELECT a, b, sum(least(x.n, y.n)) AS o FROM ab JOIN g2 x ON x.s = a JOIN g2 y ON y.s = b AND y.g = x.g WHERE length(a) >= 2 AND length(b) >= 2 GROUP BY a, b),
o1 AS (SELECT a, b, sum(least(x.n, y.n)) AS o FROM ab JOIN g1 x ON x.s = a JOIN g1 y ON y.s = b AND y.g = x.g WHERE length(a) < 2 OR length(b) < 2 GROUP BY a, b),
d AS (SELECT a, b, CASE WHEN length(a) >= 2 AND length(b) >= 2 THEN 2.0 * coalesce(o2.o, 0) / (length(a) + length(b) - 2)
   WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(o1.o, 0) / (length(a) + length(b)) END AS dice
   FROM ab LEFT JOIN o2 USING (a, b) LEFT JOIN o1 USING (a, b)),
sc AS (SELECT text, zone, ord, greatest(d1.dice, d2.dice) + 0.25 * len(list_filter(range(1, least(length(t), length(z)) + 1), lambda i: left(t, i) = left(z, i))) / nullif(length(z), 0) AS score
   FROM pair JOIN d d1 ON d1.a = t AND d1.b = z JOIN d d2 ON d2.a = h AND d2.b = z),
f AS (SELECT *, coalesce(lead(score) OVER w, 0.0) AS second, row_number() OVER w AS rn FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY text ORDER BY score DESC, ord))
"""
_ZKANA = (
    _ZSCORE.replace("regexp_replace(strip_accents(replace(lower(p_name), 'ß', 'ss')), '[^a-z]', '', 'g')", "regexp_replace(zone, '[^ア-ン]', '', 'g')")
    .replace("SELECT p_name AS zone, row_number() OVER (ORDER BY p_name) AS ord,", "SELECT zone, ord,").replace("AS z FROM names)", f"AS z FROM (SELECT translate(lower(p_name), '{_ROMAN}', '{_KANA}') AS zone, row_number() OVER (ORDER BY p_name) AS ord FROM names))")
    .replace("regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z]', '', 'g')", "regexp_replace(text, '[^ア-ン]', '', 'g')").replace("length(t) >= 3", "length(t) >= 2")
    .replace(" WHERE length(a) < 2 OR length(b) < 2 GROUP BY a, b)", " GROUP BY a, b)").replace("END AS dice\n", "END AS dice, CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(o1.o, 0) / (length(a) + length(b)) END AS one\n")
    .replace("greatest(d1.dice, d2.dice)", "greatest(d1.dice, d2.dice, 0.9 * d1.one, 0.9 * d2.one)")
)
_NOISY = "texts AS (SELECT DISTINCT left(p_name, i - 1) || substr(p_name, i + 1) AS text FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM (SELECT DISTINCT p_name FROM part)))"


# Catalogue view: suppliers are entries, nations zones; region names serve as the dictionary of every second nation.


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation")
    s = _t(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    entries = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone_id"), F.col("n_name").alias("zone"), (F.floor(F.col("s_acctbal")) / 10).alias("x"), (F.col("s_suppkey") / 10).alias("y"))
    region = _t(spark, sf_dir, "region")
    label = F.when(F.col("n_nationkey") % 5 == 4, "").otherwise(F.concat("r_name", F.lit(" "), (F.col("n_nationkey") % 3).cast("string")))
    names = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("zone_id"), F.lit("en").alias("lang"), label.alias("name"))
    gone = _t(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.lit("en").alias("lang"), F.col("s_suppkey").alias("id"))
    return cat.localized(entries, names, gone, "en")


def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.with_location(_view(spark, sf_dir)).select("id", "zone_key", "zone_label", "location")


def zone_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.zone_names(_view(spark, sf_dir)).select("zone_label", "zone_key", F.col("ord").cast("int").alias("ord"))


_VIEW = """
v AS (SELECT s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS zone_key, r_name || ' ' || (n_nationkey % 3) AS zone_label, floor(s_acctbal) / 10 AS x, s_suppkey / 10 AS y
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal >= 0 AND n_nationkey % 5 <> 4)
"""


# Decisions: an event is an observation of its user.


#: Where a row stands in its table: the file, by name, and the row of that.
_PLACE = ["at_file", "at_row"]


def _observations(events: DataFrame) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), ms.alias("ms"), F.col("event_type").alias("top_id"),
        (F.length("event_type") % 3).cast("string").alias("zone_key"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"),
        F.when(F.col("event_id") % 2 == 0, (F.expr("event_id div 2") % 3).cast("string")).alias("ocr_zone"), *[c for c in _PLACE if c in events.columns],
    )


def _placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with their place in the table, which orders those of a session with the same number."""
    return _t(spark, sf_dir, "events").select("*", F.col("_metadata.file_name").alias(_PLACE[0]), F.col("_metadata.row_index").alias(_PLACE[1]))


def scan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.decide(_observations(_placed_events(spark, sf_dir)), ties=_PLACE)


def scan_decisions_zone_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.decide(_observations(_placed_events(spark, sf_dir)), require_zone=True, ties=_PLACE)


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Run a query over the events file as a stream to its end and read its sink."""
    base = new_path(spark, "stream")
    schema = _t(spark, sf_dir, "events").schema
    rows = make(_observations(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_decisions as a stateful stream."""
    return _streamed(spark, sf_dir, lambda r: scan.decide_stream(r))


def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame ring as a stateful stream: frames of the last hour among the last five."""
    out = _streamed(spark, sf_dir, lambda r: scan.ring_stream(r, 5, 3_600_000))
    return out.select("session", "seq", F.array_join(F.transform("fresh", lambda x: x.cast("string")), ",").alias("fresh"))


def frame_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dec.ring(_observations(_t(spark, sf_dir, "events")), 5, 3_600_000)
    return out.select("session", "seq", F.array_join(F.transform("fresh", lambda x: x.cast("string")), ",").alias("fresh"))


def asof_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone each event's user signed up in last, if within eight hours."""
    rows = _observations(_t(spark, sf_dir, "events"))
    zones = rows.where("top_id = 'signup'").select("session", "seq", "ms", (F.col("seq") % 7).cast("string").alias("zone"))
    return dec.latest_zone(rows.where("top_id <> 'signup'"), zones, 8 * 3_600_000).select("session", "seq", "zone")


def stream_asof_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asof_zone as a stateful stream."""
    read = F.col("top_id") == "signup"
    kinds = lambda r: r.select("session", "seq", "ms", F.when(read, 0).otherwise(1).alias("kind"), F.when(read, (F.col("seq") % 7).cast("string")).alias("zone"))
    return _streamed(spark, sf_dir, lambda r: scan.latest_zone_stream(kinds(r), 8 * 3_600_000))


def recorded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of all vectors by label, read as a table: the number of each frame and the sum of its vector, in thousandths."""
    path, e = new_path(spark, "recording"), _t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    frames.record(e, path, ["label", "vec_id"])
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return frames.recorded(spark, path).select("frame", "vec_id", "label", F.round(total * 1000).cast("long").alias("total_milli"))


#: Frames of a micro-batch of a played recording, at most, and of one whose frames are matched.
_BATCH, _LIVE_BATCH = 1_000_000, 500_000


def _played(spark: SparkSession, sf_dir: str, sink) -> str:
    """Play a recording of the events, by their number, in micro-batches of a quarter of it or _BATCH frames; stop after the first, go on to the end.

    sink(frames, folder) gives the writer of a stream; its rows are in that folder.
    """
    path, base = new_path(spark, "recording"), new_path(spark, "played")
    total = frames.record(_observations(_t(spark, sf_dir, "events")), path, ["seq"])
    rows = frames.played(spark, path, batch=max(1, min(_BATCH, -(-total // 4))))
    writer = lambda: sink(rows, f"{base}/out").option("checkpointLocation", f"{base}/state")
    writer().trigger(availableNow=True).start().awaitTermination()
    if total:
        frames.Playback(lambda: writer().trigger(processingTime="0 seconds").start()).resume().until(total).pause()
    return f"{base}/out"


def played_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_decisions over frames that are played, stopped and played on."""
    return spark.read.schema(scan.OUTPUT).parquet(_played(spark, sf_dir, lambda rows, out: scan.decide_stream(rows).writeStream.format("parquet").option("path", out)))


def played_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest_wins over frames that are played: each micro-batch hands on its newest row of a user and hour, and the newest of these stays."""
    keys, order, schema = ["user_id", "hour_ms"], ["ms", "event_id"], "user_id long, hour_ms long, ms long, event_id long, event_type string"

    def sink(rows: DataFrame, out: str):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
        events = rows.select(F.col("session").alias("user_id"), (F.floor(F.col("ms") / 3_600_000) * 3_600_000).alias("hour_ms"), "ms", F.col("seq").alias("event_id"), F.col("top_id").alias("event_type"))
        return scan.latest_writer(events, keys, order, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))

    newest = dec.latest(spark.read.schema(schema).parquet(_played(spark, sf_dir, sink)), keys, order)
    return newest.select("user_id", "hour_ms", "event_id", "event_type")


def _live(spark: SparkSession, sf_dir: str) -> str:
    """Run the live match over a recording of the events, in micro-batches of _LIVE_BATCH frames at most, to its end; where its tables are.

    An event shows the vector that its user looks at for two days, disturbed by another one. Signups are readings of the
    shown vector's zone, a third of them one zone off.
    """
    e = _t(spark, sf_dir, "embeddings")
    path, base, n = new_path(spark, "variants"), new_path(spark, "live"), e.count()
    hash_index.write(_variants(spark, sf_dir).withColumn("zone_key", F.concat(F.lit("z"), F.col("entry") % 5)), path, "zone_key", ("p",))
    sim.mean_vector(e, "embedding").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")).select(F.transform("m", lambda s: s["mean"]).alias("vec")).write.parquet(f"{base}/mean")
    events, ms, tape = _t(spark, sf_dir, "events"), F.unix_millis(F.col("ts").cast("timestamp")), new_path(spark, "recording")
    events = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), ms.alias("ms"), F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("kind"))
    total = frames.record(events, tape, ["ms", "kind", "seq"])
    rows = frames.played(spark, tape, batch=_LIVE_BATCH).withColumn("read", F.col("kind") == 0)
    shown = F.pmod(F.col("session") * 31 + F.floor(F.col("ms") / 172_800_000), F.lit(n))
    side = lambda name: e.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"{name}_vec"), F.col("label").alias(f"{name}_label"))
    rows = rows.withColumns({"a": shown, "b": F.pmod(F.col("seq") * 7, F.lit(n))}).join(side("a"), "a").join(side("b"), "b")
    off = F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
    rows = rows.select(
        "session", "seq", "ms", F.when(F.col("read"), 0).otherwise(1).alias("kind"), F.when(F.col("read"), F.concat(F.lit("z"), ((F.col("a_label") + off) % 5).cast("string"))).alias("zone"),
        F.when(~F.col("read"), F.zip_with("a_vec", "b_vec", lambda x, y: x.cast("double") + y.cast("double"))).alias("vec"),
    )
    live.start(rows, hash_index.HashIndex(spark, path, "zone_key", ("p",)), spark.read.parquet(f"{base}/mean"), base, once=True, play=total, age_ms=86_400_000, ttl_ms=43_200_000)
    return base


def stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames matched within the zone read last, by their composite if that is surer, as a stream."""
    out = live.matches(spark, _live(spark, sf_dir))
    return out.select("session", "seq", "ocr_zone", "attempt", F.col("top_id").cast("int").alias("label"), F.round("conf", 5).alias("conf"), F.array_join(F.transform("candidates", lambda c: c["entry"]), ",").alias("candidates"))


def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions on these matches, as a stream."""
    return live.decisions(spark, _live(spark, sf_dir))


def _crowded(events: DataFrame) -> DataFrame:
    """Events where a third of all users are one."""
    return events.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")))


def scan_decisions_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_decisions where one session holds a third of all observations, in segments of a thousand."""
    return dec.decide(_observations(_crowded(_placed_events(spark, sf_dir))), segment=1000, ties=_PLACE)


def asof_zone_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asof_zone where one user has a third of all events."""
    rows = _observations(_crowded(_t(spark, sf_dir, "events")))
    zones = rows.where("top_id = 'signup'").select("session", "seq", "ms", (F.col("seq") % 7).cast("string").alias("zone"))
    return dec.latest_zone(rows.where("top_id <> 'signup'"), zones, 8 * 3_600_000).select("session", "seq", "zone")


def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as attempts of one query."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") / 60).alias("conf"))
    rows = rows.groupBy("qid", "attempt").agg(F.max("conf").alias("conf"))
    return dec.best_attempt(rows).select("qid", F.col("attempt").cast("int").alias("attempt"), F.round("conf", 6).alias("conf"), "tried")


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and hour."""
    e = _t(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "ts", "event_id", "event_type")
    return dec.latest(e, ["user_id", "h"], ["ts", "event_id"]).select("user_id", F.unix_millis("h").alias("hour_ms"), "event_id", "event_type")


def consecutive_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event repeats its user's last one, by hash."""
    e = _t(spark, sf_dir, "events").withColumn("sha", F.sha2("event_type", 256))
    return dec.consecutive_duplicates(e, "sha", "user_id", ["ts", "event_id"]).select("event_id", "repeated")


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.lower(F.hex(F.encode(F.substring("text", 1, 4), "utf-8"))).alias("head"))


_OBS = """
o AS (SELECT user_id AS session, event_id AS seq, epoch_ms(ts) AS ms, event_type AS top_id, CAST(length(event_type) % 3 AS VARCHAR) AS zone_key,
  least(value / 100, 1.0) AS conf, CASE WHEN event_id % 2 = 0 THEN CAST((event_id // 2) % 3 AS VARCHAR) END AS ocr_zone FROM events)
"""
_DECIDE = """
a AS (SELECT *, conf >= 0.6 AS sure, CASE WHEN conf >= 0.6 THEN top_id END AS cid, CASE WHEN conf >= 0.6 THEN zone_key END AS czone,
  coalesce(ocr_zone = zone_key, false) AS agrees,
  coalesce(lag(top_id) OVER s = top_id, false) AND coalesce(lag(top_id, 2) OVER s = top_id, false) AND coalesce(lag(top_id, 3) OVER s = top_id, false) AS same
  FROM o WINDOW s AS (PARTITION BY session ORDER BY seq)),
b AS (SELECT *, agrees AND conf >= 0.25 AND same AS by_zone,
  list(cid) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ids,
  list(czone) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS zs FROM a),
c AS (SELECT *, sure AND NOT by_zone AND %s AND len(list_filter(ids, lambda i: coalesce(i = cid, false))) >= 2
  AND len(list_filter(zs, lambda z: coalesce(z <> zone_key, false))) = 0 AS by_score, sure OR by_zone AS reset FROM b),
d AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c),
e AS (SELECT *, min(CASE WHEN NOT reset THEN ms END) OVER (PARTITION BY session, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS since FROM d)
SELECT session, seq, CASE WHEN by_zone OR by_score THEN top_id END AS confirmed, CASE WHEN by_zone THEN 'ocrStable' WHEN by_score THEN 'score' END AS via,
  NOT reset AND ms - since >= 5000 AS show_candidates FROM e
"""
_ASOF = f"WITH {_OBS}, z AS (SELECT session, ms, seq, CAST(seq % 7 AS VARCHAR) AS zone FROM o WHERE top_id = 'signup') SELECT o.session, o.seq, CASE WHEN o.ms - z.ms < 28800000 THEN z.zone END AS zone FROM o ASOF LEFT JOIN z ON o.session = z.session AND o.ms >= z.ms WHERE o.top_id <> 'signup'"
_CROWD = "SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS session"
_RING = """SELECT session, seq, array_to_string(list_transform(list_filter(r, lambda x: ms - x['ms'] <= 3600000), lambda x: CAST(x['seq'] AS VARCHAR)), ',') AS fresh
FROM (SELECT *, list({'seq': seq, 'ms': ms}) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM o)"""


# Numbers.


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_type", F.least(F.col("value") / 200, F.lit(1.0)).alias("v"))
    return hist.otsu(rows, "event_type", "v", None).select("event_type", "threshold")


def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.percentile(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.8)


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rounding rules, clamping, percents and sizes over all lines."""
    x = (F.col("l_quantity") - 25) / 2
    fit = num.fit_within(F.col("l_partkey") % 3000 + 1, F.col("l_suppkey") % 2000 + 1, F.lit(1200).cast("bigint"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", num.half_even(x).alias("even"), num.half_up(x).cast("bigint").alias("up"), F.floor(x).cast("bigint").alias("down"), num.clamp(x, -3.0, 3.0).alias("clamped"), num.percent(x / 16).alias("pct"), fit.alias("f"))
    return rows.select("l_orderkey", "l_linenumber", "even", "up", "down", "clamped", "pct", F.col("f.width").cast("bigint").alias("fit_w"), F.col("f.height").cast("bigint").alias("fit_h"))


def guide_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide frame of containers of all part sizes and the video pixels under it."""
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 17 + 100).cast("double").alias("w"), (F.col("p_partkey") % 900 + 100).cast("double").alias("h"))
    p = p.withColumn("g", num.guide_rect(F.col("w"), F.col("h")))
    c = num.cover_source_rect(F.lit(1920), F.lit(1080), F.col("w"), F.col("h"), F.col("g"))
    return p.withColumn("c", c).select("p_partkey", F.round("g.x", 4).alias("gx"), F.round("g.width", 4).alias("gw"), *[F.col(f"c.{k}").cast("bigint").alias(f"s{k[0]}") for k in ("x", "y", "width", "height")])


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_quantity").cast("int").alias("area"), (F.col("l_linenumber") * 20).alias("x0"), (F.col("l_partkey") % 9).cast("int").alias("y0"), F.lit(600).alias("strip_w"), F.lit(60).alias("strip_h"), (F.col("l_linenumber") * 20 + 4 + F.col("l_suppkey") % 12).cast("int").alias("x1"), (F.col("l_partkey") % 9 + 7 + F.col("l_suppkey") % 30).cast("int").alias("y1"))


def component_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph and text-line filters over boxes made of line items: an order is an image."""
    out = hist.text_line(hist.glyphs(_boxes(spark, sf_dir)))
    return out.select("image", "n", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of component_filter with their margin, of those with a tenth of the strip's width."""
    out = hist.line_box(hist.glyphs(_boxes(spark, sf_dir)))
    return out.select("image", "n", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])


def image_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as the bytes of pictures whose sides are made of sizes and keys."""
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 9 - 1).alias("w"), (F.col("p_partkey") % 4).alias("h"), F.encode("p_name", "utf-8").alias("data"))
    return p.select("p_partkey", images.fault(F.col("w"), F.col("h"), F.lit(1), F.col("data")).alias("fault"))


def scan_decisions_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_decisions where every purchase starts its user's session anew."""
    rows = _observations(_placed_events(spark, sf_dir))
    return dec.decide(rows.withColumn("reset", F.col("top_id") == "purchase"), ties=_PLACE)


def stream_decisions_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_decisions_reset as a stateful stream."""
    return _streamed(spark, sf_dir, lambda r: scan.decide_stream(r.withColumn("reset", F.col("top_id") == "purchase")))


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events start a reading of text, when a user's readings are six hours apart at least."""
    return _streamed(spark, sf_dir, lambda r: scan.throttle_stream(r, 6 * 3_600_000))


def identify_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best label of every vector by the mean of two correlations, those of its two halves."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("flat"), F.col("label").alias("entry"), F.col("embedding").alias("vec"))
    rows = e.withColumns({"p": num.sign_bits(F.col("vec")), "d": F.lit(0).cast("bigint"), "a": F.slice("vec", 1, 32), "b": F.slice("vec", 33, 32)})
    v = sim.with_units(sim.with_units(rows, rows, "a", "unit"), rows, "b", "unit_bp").drop("vec", "a", "b")
    out = sim.match(v.select(F.col("flat").alias("qid"), F.lit(0).alias("w"), "p", "d", "unit", "unit_bp"), v, other=True, top=1)
    return out.select(F.col("qid").alias("vec_id"), F.col("entry").alias("label"), F.round("ncc", 6).alias("ncc"))


def catalogue_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and vectors of a catalogue document, made of the suppliers, written and read again."""
    path = new_path(spark, "catalogue")
    h = lambda n: F.lpad(F.hex(F.col("s_suppkey") * n), 16, "F")
    vec = F.base64(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex((F.col("s_suppkey") + i * 3) % 256), 2, "0")), "")))
    one = F.struct(F.lower(h(7919)).alias("pHash"), F.lower(h(104729)).alias("dHash"), vec.alias("vec16"), vec.alias("vecBp"))
    entry = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.lit("g1").alias("grade"), F.lit("One").alias("gradeName"), F.col("s_name").alias("zone"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("zoneId"), F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.array(one, one).alias("variants"))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", entry.alias("e")).withColumn("doc", F.col("s_suppkey") % 8)
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "e"))).alias("l")).select(F.to_json(F.struct(F.lit(1).alias("version"), F.transform("l", lambda s: s["e"]).alias("entries"), F.lit(None).cast("map<string,map<string,string>>").alias("zoneNames"))).alias("value"))
    docs.write.text(path)
    read = doc.entries(spark.read.schema(doc.SCHEMA).json(path))
    v = doc.variants(read).join(read.select("id", "zone_id"), "id")
    return v.select("id", "zone_id", "p", "d", F.aggregate("vec", F.lit(0), lambda a, x: a + x).alias("total"), (F.col("flat") % 2).cast("int").alias("k"), F.get("vec_bp", F.lit(5)).alias("fifth"))


QUERIES = {
    f.__name__: f
    for f in (
        hamming_nearest, mean_vector, centered_ncc, raw_ncc, identify_top3, identify_confidence, identify_filtered, identify_windows, zone_match, zone_match_kana, zone_match_bench,
        normalised_texts, gram_counts, dice_pairs, catalog_view, zone_list, scan_decisions, scan_decisions_zone_required, stream_decisions, stream_ring, frame_ring, asof_zone, asof_zone_crowded, stream_asof_zone, scan_decisions_crowded,
        best_attempt, latest_wins, consecutive_duplicates, document_hashes, otsu_threshold, floor_percentile, rounding, guide_rects, component_filter,
        scan_decisions_reset, stream_decisions_reset, stream_throttle, identify_fused, catalogue_document, identify_zone, hamming_within, identify_staged, stream_matches, stream_live, zone_readings,
        recorded_frames, played_decisions, played_latest, line_boxes, image_faults,
    )
} | image_queries.QUERIES

#: The decision SQL with sessions that start anew at every purchase.
_RESET = _OBS.replace("user_id AS session", "{'user': user_id, 'life': sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)} AS session").replace("FROM events)", "FROM events)")
_RESET = f"""WITH RECURSIVE {_RESET}, all_ AS (SELECT * FROM o), {_DECIDE % 'true'}"""
_RESET = _RESET.replace("AS same\n  FROM o WINDOW", "AS same\n  FROM (SELECT * FROM o WHERE top_id <> 'purchase') WINDOW").replace("SELECT session, seq, CASE WHEN by_zone", "SELECT session['user'] AS session, seq, CASE WHEN by_zone", 1)
_RESET += " UNION ALL SELECT user_id, event_id, NULL, NULL, false FROM events WHERE event_type = 'purchase'"
_HALVES = """
v AS (SELECT vec_id, label, {signs} AS p, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings),
am AS (SELECT list(m ORDER BY i) AS ma FROM (SELECT i, avg(a[i]) AS m FROM v, (SELECT unnest(range(1, 33)) AS i) GROUP BY i)),
bm AS (SELECT list(m ORDER BY i) AS mb FROM (SELECT i, avg(b[i]) AS m FROM v, (SELECT unnest(range(1, 33)) AS i) GROUP BY i)),
s AS (SELECT vec_id, label, p, list_transform(list_zip(a, ma), lambda z: z[1] - z[2]) AS a, list_transform(list_zip(b, mb), lambda z: z[1] - z[2]) AS b FROM v, am, bm),
c AS (SELECT vec_id, label, p, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM s),
cut AS (SELECT q.vec_id AS qid, v.label, hamming(q.p, v.p) AS hd, (list_dot_product(q.a, v.a) / sqrt(list_dot_product(q.a, q.a) * list_dot_product(v.a, v.a)) + list_dot_product(q.b, v.b) / sqrt(list_dot_product(q.b, q.b) * list_dot_product(v.b, v.b))) / 2 AS ncc
  FROM c q JOIN c v ON q.vec_id <> v.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.p, v.p), v.vec_id) <= 48)
SELECT qid AS vec_id, label, round(ncc, 6) AS ncc FROM cut QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ncc DESC, hd, label) = 1
""".replace("{signs}", _SIGNS)
_LIVE = f"""
vm AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)),
ev AS (SELECT user_id AS session, event_id AS seq, epoch_ms(ts) AS ms, event_type = 'signup' AS read, a.label,
  list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: z[1] + z[2]) AS vec
  FROM events JOIN (SELECT count(*) AS n FROM embeddings) ON true JOIN embeddings a ON a.vec_id = (user_id * 31 + epoch_ms(ts) // 172800000) % n JOIN embeddings b ON b.vec_id = event_id * 7 % n),
z AS (SELECT session, ms, 'z' || ((label + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END) % 5) AS zone FROM ev WHERE read),
g AS (SELECT f.session, f.seq, f.ms, f.vec, CASE WHEN f.ms - z.ms < 43200000 THEN z.zone END AS gate FROM (SELECT * FROM ev WHERE NOT read) f ASOF LEFT JOIN z ON f.session = z.session AND f.ms >= z.ms),
r AS (SELECT *, list_filter(l, lambda x: ms - x['ms'] <= 86400000) AS fresh FROM (SELECT *, list({{'ms': ms, 'vec': vec}}) OVER (PARTITION BY session ORDER BY ms, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM g)),
w AS (SELECT session, seq, gate, 0 AS k, vec AS embedding FROM r UNION ALL SELECT session, seq, gate, 1, list_transform(range(1, 65), lambda i: list_avg(list_transform(fresh, lambda x: x['vec'][i]))) FROM r WHERE len(fresh) >= 3),
ws AS (SELECT session, seq, gate, k, {_SIGNS} AS p, list_transform(list_zip(embedding, m), lambda y: y[1] - y[2]) AS s FROM w, vm),
vs AS (SELECT vec_id, label, {_SIGNS} AS p, list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda y: y[1] - y[2]) AS s FROM embeddings, vm),
wc AS (SELECT session, seq, gate, k, p, list_transform(s, lambda x: x - list_avg(s)) AS s FROM ws), vc AS (SELECT vec_id, label, p, list_transform(s, lambda x: x - list_avg(s)) AS s FROM vs),
pairs AS (SELECT session, seq, k, vec_id, label, hamming(wc.p, vc.p) AS hd FROM wc JOIN vc ON gate IS NULL OR gate = 'z' || (label % 5) QUALIFY row_number() OVER (PARTITION BY session, seq, k ORDER BY hd, vec_id) <= 48),
ncc AS (SELECT session, seq, k, pairs.label, hd, list_dot_product(wc.s, vc.s) / sqrt(list_dot_product(wc.s, wc.s) * list_dot_product(vc.s, vc.s)) AS ncc FROM pairs JOIN wc USING (session, seq, k) JOIN vc USING (vec_id)),
be AS (SELECT * FROM ncc QUALIFY row_number() OVER (PARTITION BY session, seq, k, label ORDER BY ncc DESC, hd) = 1),
rk AS (SELECT *, row_number() OVER q AS rn, lead(ncc) OVER q AS nx FROM be WINDOW q AS (PARTITION BY session, seq, k ORDER BY ncc DESC, hd, label)),
cf AS (SELECT session, seq, k, label, round(sqrt(greatest(0, least(1, (ncc - 0.45) / 0.15)) * greatest(0, least(1, (coalesce(ncc - nx, 1.0) - 0.02) / 0.04))), 9) AS conf FROM rk WHERE rn = 1),
tk AS (SELECT x.session, x.seq, CASE WHEN x.conf < 0.6 AND y.conf > x.conf THEN 1 ELSE 0 END AS k FROM cf x LEFT JOIN cf y ON x.session = y.session AND x.seq = y.seq AND y.k = 1 WHERE x.k = 0),
mt AS (SELECT g.session, g.seq, g.ms, g.gate AS ocr_zone, tk.k AS attempt, cf.label, coalesce(cf.conf, 0.0) AS conf FROM g LEFT JOIN tk USING (session, seq) LEFT JOIN cf USING (session, seq, k)),
o AS (SELECT session, seq, ms, CAST(label AS VARCHAR) AS top_id, 'z' || (label % 5) AS zone_key, conf, ocr_zone FROM mt)
"""
_LINE = """WITH b AS (SELECT l_orderkey AS image, CAST(l_quantity AS INTEGER) AS area, l_linenumber * 20 AS x0, l_partkey % 9 AS y0, l_linenumber * 20 + 4 + l_suppkey % 12 AS x1, l_partkey % 9 + 7 + l_suppkey % 30 AS y1 FROM lineitem),
        g AS (SELECT *, (y0 + y1) / 2 AS cy, y1 - y0 + 1 AS h FROM b WHERE area >= 12 AND y1 - y0 + 1 >= 0.08 * 60 AND y1 - y0 + 1 <= 0.6 * 60 AND x1 - x0 + 1 <= 3 * (y1 - y0 + 1) AND x1 - x0 + 1 <= 0.2 * 600),
        k AS (SELECT *, count(*) OVER (PARTITION BY image) AS c, row_number() OVER (PARTITION BY image ORDER BY cy) AS rc, row_number() OVER (PARTITION BY image ORDER BY h) AS rh FROM g),
        m AS (SELECT image, max(CASE WHEN rc - 1 = c // 2 THEN cy END) AS my, max(CASE WHEN rh - 1 = c // 2 THEN h END) AS mh FROM k WHERE c >= 3 GROUP BY image)
        SELECT k.image, count(*) AS n, CAST(min(x0) AS INTEGER) AS x0, CAST(min(y0) AS INTEGER) AS y0, CAST(max(x1) AS INTEGER) AS x1, CAST(max(y1) AS INTEGER) AS y1 FROM k JOIN m ON k.image = m.image WHERE abs(cy - my) < mh GROUP BY k.image HAVING count(*) >= 3"""
_LATEST = "SELECT user_id, epoch_ms(date_trunc('hour', ts)) AS hour_ms, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1"
_LATIN_NORMAL = "regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z]', '', 'g')"
SQL = image_queries.SQL | {
    "stream_matches": f"""WITH {_LIVE} SELECT session, seq, ocr_zone, CAST(attempt AS INTEGER) AS attempt, label, round(conf, 5) AS conf,
        (SELECT string_agg(CAST(rk.label AS VARCHAR), ',' ORDER BY rn) FROM rk WHERE rk.session = mt.session AND rk.seq = mt.seq AND rk.k = mt.attempt AND rn <= 3) AS candidates FROM mt""",
    "stream_live": f"WITH {_LIVE}, {_DECIDE % 'true'}",
    "recorded_frames": "SELECT row_number() OVER (ORDER BY label NULLS FIRST, vec_id) - 1 AS frame, vec_id, label, CAST(round(list_sum(CAST(embedding AS DOUBLE[])) * 1000) AS BIGINT) AS total_milli FROM embeddings",
    "played_decisions": f"WITH {_OBS}, {_DECIDE % 'true'}",
    "scan_decisions_reset": _RESET,
    "stream_decisions_reset": _RESET,
    "stream_throttle": f"""WITH RECURSIVE {_OBS}, n AS (SELECT session, seq, ms, row_number() OVER (PARTITION BY session ORDER BY ms, seq) AS i FROM o),
        go(session, seq, i, last, started) AS (SELECT session, seq, i, ms, true FROM n WHERE i = 1 UNION ALL
          SELECT n.session, n.seq, n.i, CASE WHEN n.ms - go.last >= 21600000 THEN n.ms ELSE go.last END, n.ms - go.last >= 21600000 FROM go JOIN n ON n.session = go.session AND n.i = go.i + 1)
        SELECT session, seq, started FROM go""",
    "identify_fused": f"WITH {_HALVES}",
    "catalogue_document": """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS zone_id, CAST(('0x' || lpad(printf('%X', s_suppkey * 7919), 16, 'F'))::UBIGINT::HUGEINT - 18446744073709551616 AS BIGINT) AS p,
        CAST(('0x' || lpad(printf('%X', s_suppkey * 104729), 16, 'F'))::UBIGINT::HUGEINT - 18446744073709551616 AS BIGINT) AS d, CAST(list_sum(list_transform(range(0, 256), lambda i: (s_suppkey + i * 3) % 256)) AS INTEGER) AS total,
        CAST(k AS INTEGER) AS k, CAST((s_suppkey + 15) % 256 AS INTEGER) AS fifth FROM supplier, (SELECT unnest([0, 1]) AS k)""",
    "hamming_nearest": f"WITH s AS (SELECT vec_id, {_SIGNS} AS p FROM embeddings) SELECT a.vec_id, b.vec_id AS nearest, CAST(hamming(a.p, b.p) AS INTEGER) AS hamming FROM s a JOIN s b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY hamming(a.p, b.p), b.vec_id) = 1",
    "mean_vector": "SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY pos",
    "centered_ncc": "WITH " + _MATCH % "" + " SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS ncc FROM u a JOIN u b ON b.vec_id = a.vec_id + 1",
    "raw_ncc": "WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS v FROM c) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS ncc FROM d a JOIN d b ON b.vec_id = a.vec_id + 1",
    "identify_top3": "WITH " + _MATCH % "" + _TOP3,
    "identify_staged": "WITH " + _STAGED,
    "identify_zone": "WITH " + _MATCH % "AND v.label % 5 = 2" + _TOP3,
    "hamming_within": f"WITH s AS (SELECT vec_id, {_SIGNS} AS p FROM embeddings) SELECT a.vec_id, b.vec_id AS other, CAST(hamming(a.p, b.p) AS INTEGER) AS hamming FROM s a JOIN s b ON a.vec_id <> b.vec_id WHERE hamming(a.p, b.p) <= 17",
    "identify_filtered": "WITH " + _MATCH % "AND v.label < 5" + _TOP3,
    "identify_confidence": "WITH " + _MATCH % "" + """, k AS (SELECT qid, label, sqrt(greatest(0, least(1, (ncc - 0.45) / 0.15)) * greatest(0, least(1, (CASE WHEN next IS NULL THEN 1.0 ELSE ncc - next END - 0.02) / 0.04))) AS confidence FROM ranks WHERE rank = 1)
        SELECT qid AS vec_id, label, round(confidence, 5) AS confidence, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS pct, confidence >= 0.6 AS is_confident FROM k""",
    "identify_windows": f"""WITH s AS (SELECT vec_id, {_SIGNS} AS p FROM embeddings), q AS (SELECT vec_id, p AS w0, left(p, 32) || repeat('0', 32) AS w1, repeat('0', 32) || right(p, 32) AS w2 FROM s),
        h AS (SELECT q.vec_id AS qid, v.vec_id AS flat, hamming(w0, p) AS h0, hamming(w1, p) AS h1, hamming(w2, p) AS h2 FROM q JOIN s v ON q.vec_id <> v.vec_id),
        c AS (SELECT qid, 0 AS w, flat, h0 AS hd, row_number() OVER (PARTITION BY qid ORDER BY h0, flat) AS rn FROM h UNION ALL
              SELECT qid, 1, flat, h1, row_number() OVER (PARTITION BY qid ORDER BY h1, h0, flat) FROM h UNION ALL SELECT qid, 2, flat, h2, row_number() OVER (PARTITION BY qid ORDER BY h2, h1, h0, flat) FROM h)
        SELECT qid AS vec_id, CAST(w AS INTEGER) AS w, count(*) AS n, CAST(sum(hd) AS BIGINT) AS total, CAST(sum(flat * (hd + 1)) AS BIGINT) AS digest FROM c WHERE rn <= 48 GROUP BY qid, w""",
    "zone_match": f"WITH {_NOISY}, {_ZSCORE} SELECT t.text, CASE WHEN score >= 0.4 AND score - second >= 0.06 THEN zone END AS zone, round(score, 6) AS score, round(score - second, 6) AS gap FROM t LEFT JOIN f ON f.text = t.text AND rn = 1",
    "zone_match_kana": f"WITH {_NOISY.replace('texts AS (SELECT DISTINCT left(', f'texts AS (SELECT DISTINCT translate(lower(left(').replace(' AS text FROM', f"), '{_ROMAN}', '{_KANA}') AS text FROM")}, {_ZKANA} SELECT t.text, CASE WHEN score >= 0.4 AND score - second >= 0.06 THEN zone END AS zone, round(score, 6) AS score, round(score - second, 6) AS gap FROM t LEFT JOIN f ON f.text = t.text AND rn = 1",
    "zone_match_bench": f"WITH texts AS (SELECT DISTINCT text FROM benchmark), {_ZSCORE} SELECT t.text, CASE WHEN score >= 0.4 AND score - second >= 0.06 THEN zone END AS zone FROM t LEFT JOIN f ON f.text = t.text AND rn = 1",
    "zone_readings": f"""WITH texts AS (SELECT DISTINCT left(p_name, 1) || substr(p_name, 3) AS text FROM part), {_ZSCORE},
        k AS (SELECT p_partkey, left(p_name, 1) || substr(p_name, 3) AS t, CASE WHEN p_size = 50 THEN 'failed' WHEN p_partkey % 500 = 7 THEN 'timeout' WHEN p_size = 1 THEN 'empty' ELSE 'read' END AS status FROM part)
        SELECT p_partkey, CASE WHEN status = 'read' THEN k.t END AS text, status, CASE WHEN status = 'read' AND score >= 0.4 AND score - second >= 0.06 THEN zone END AS zone FROM k LEFT JOIN f ON f.text = k.t AND rn = 1""",
    "normalised_texts": f"SELECT doc_id, length({_LATIN_NORMAL}) AS n, sha256({_LATIN_NORMAL}) AS sha FROM documents",
    "gram_counts": "SELECT g AS gram, count(*) AS n FROM (SELECT substr(p_name, unnest(range(1, length(p_name))), 2) AS g FROM part) GROUP BY g",
    "dice_pairs": """WITH p AS (SELECT n_nationkey, r_regionkey, lower(n_name) AS a, lower(r_name) AS b FROM nation, region),
        x AS (SELECT n_nationkey, r_regionkey, g, count(*) AS n FROM (SELECT n_nationkey, r_regionkey, substr(a, unnest(range(1, length(a))), 2) AS g FROM p) GROUP BY ALL),
        y AS (SELECT n_nationkey, r_regionkey, g, count(*) AS n FROM (SELECT n_nationkey, r_regionkey, substr(b, unnest(range(1, length(b))), 2) AS g FROM p) GROUP BY ALL),
        o AS (SELECT n_nationkey, r_regionkey, sum(least(x.n, y.n)) AS o FROM x JOIN y USING (n_nationkey, r_regionkey, g) GROUP BY ALL)
        SELECT n_nationkey, r_regionkey, round(2.0 * coalesce(o, 0) / (length(a) + length(b) - 2), 6) AS dice,
          CAST(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS INTEGER) AS prefix FROM p LEFT JOIN o USING (n_nationkey, r_regionkey)""",
    "catalog_view": f"WITH {_VIEW} SELECT id, zone_key, zone_label, printf('%s (X:%.1f, Y:%.1f)', zone_label, x, y) AS location FROM v",
    "zone_list": f"WITH {_VIEW} SELECT zone_label, max_by(zone_key, id) AS zone_key, CAST(row_number() OVER (ORDER BY min(id)) AS INTEGER) AS ord FROM v GROUP BY zone_label",
    "scan_decisions": f"WITH {_OBS}, {_DECIDE % 'true'}",
    "stream_decisions": f"WITH {_OBS}, {_DECIDE % 'true'}",
    "scan_decisions_zone_required": f"WITH {_OBS}, {_DECIDE % 'agrees'}",
    "frame_ring": f"WITH {_OBS} {_RING}",
    "stream_ring": f"WITH {_OBS} {_RING}",
    "asof_zone": _ASOF,
    "stream_asof_zone": _ASOF,
    "asof_zone_crowded": _ASOF.replace("SELECT user_id AS session", _CROWD),
    "scan_decisions_crowded": f"WITH {_OBS}, {_DECIDE % 'true'}".replace("SELECT user_id AS session", _CROWD),
    "best_attempt": """WITH r AS (SELECT l_orderkey AS qid, l_linenumber AS attempt, max(l_quantity / 60) AS conf FROM lineitem GROUP BY ALL),
        t AS (SELECT *, coalesce(max(CASE WHEN conf >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM r)
        SELECT qid, CAST(attempt AS INTEGER) AS attempt, round(conf, 6) AS conf, count(*) OVER (PARTITION BY qid) AS tried FROM t WHERE over = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY conf DESC, attempt) = 1""",
    "latest_wins": _LATEST,
    "played_latest": _LATEST,
    "consecutive_duplicates": "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type, false) AS repeated FROM events",
    "document_hashes": "SELECT doc_id, sha256(text) AS sha, lower(hex(encode(left(text, 4)))) AS head FROM documents",
    "otsu_threshold": """WITH b AS (SELECT event_type, CAST(least(63, greatest(0, floor(least(value / 200, 1.0) * 64))) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER u AS nb, sum(n * bin) OVER u AS sb, sum(n) OVER (PARTITION BY event_type) AS nt, sum(n * bin) OVER (PARTITION BY event_type) AS st FROM b WINDOW u AS (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING))
        SELECT event_type, (bin + 1) / 64 AS threshold FROM c WHERE nb < nt QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CAST(nb AS DOUBLE) * (nt - nb) * pow(sb / nb - (st - sb) / (nt - nb), 2) DESC, bin) = 1""",
    "floor_percentile": "SELECT l_returnflag, l_extendedprice AS percentile FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 = least(count(*) OVER (PARTITION BY l_returnflag) - 1, floor(count(*) OVER (PARTITION BY l_returnflag) * 0.8))",
    "rounding": """WITH r AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 2 AS x, l_partkey % 3000 + 1 AS w, l_suppkey % 2000 + 1 AS h FROM lineitem)
        SELECT l_orderkey, l_linenumber, round_even(x, 0) + 0.0 AS even, CAST(floor(x + 0.5) AS BIGINT) AS up, CAST(floor(x) AS BIGINT) AS down, greatest(-3.0, least(3.0, x)) AS clamped,
          CAST(floor(greatest(x / 16, 0) * 100 + 0.5) AS INTEGER) AS pct, CAST(least(w, 1200) AS BIGINT) AS fit_w, CAST(CASE WHEN w <= 1200 THEN h ELSE greatest(1, floor(h * 1200.0 / w + 0.5)) END AS BIGINT) AS fit_h FROM r""",
    "guide_rects": """WITH p AS (SELECT p_partkey, CAST(p_size * 17 + 100 AS DOUBLE) AS w, CAST(p_partkey % 900 + 100 AS DOUBLE) AS h FROM part),
        g AS (SELECT *, least(w * 0.85 / (439.0::DOUBLE / 380), h * 0.85) AS gh, CASE WHEN w * 0.85 / (439.0::DOUBLE / 380) > h * 0.85 THEN h * 0.85 * (439.0::DOUBLE / 380) ELSE w * 0.85 END AS gw, greatest(w / 1920, h / 1080) AS s FROM p),
        c AS (SELECT *, CAST(greatest(0, least(1919, floor(((w - gw) / 2 - (w - 1920 * s) / 2) / s + 0.5))) AS BIGINT) AS sx, CAST(greatest(0, least(1079, floor(((h - gh) / 2 - (h - 1080 * s) / 2) / s + 0.5))) AS BIGINT) AS sy FROM g)
        SELECT p_partkey, round((w - gw) / 2, 4) AS gx, round(gw, 4) AS gw, sx, sy, CAST(greatest(1, least(1920 - sx, floor(gw / s + 0.5))) AS BIGINT) AS sw, CAST(greatest(1, least(1080 - sy, floor(gh / s + 0.5))) AS BIGINT) AS sh FROM c""",
    "component_filter": _LINE,
    "line_boxes": f"""SELECT * FROM (SELECT image, n, greatest(0, x0 - 4) AS x0, greatest(0, y0 - 4) AS y0, least(599, x1 + 4) AS x1, least(59, y1 + 4) AS y1 FROM ({_LINE})) WHERE y1 - y0 + 1 >= 10 AND x1 - x0 + 1 >= 0.1 * 600""",
    "image_faults": """SELECT p_partkey, CASE WHEN p_size % 9 - 1 <= 0 OR p_partkey % 4 <= 0 THEN 'size' WHEN strlen(p_name) <> (p_size % 9 - 1) * (p_partkey % 4) THEN 'bytes' END AS fault FROM part""",
}
