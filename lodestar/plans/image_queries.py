"""Registered queries of the image half, over images drawn from the nations, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as txt
from lodestar.operators import catalog_view as cat
from lodestar.operators import decisions as dec
from lodestar.operators import histogram as hist
from lodestar.operators import identify as ident
from lodestar.operators import zones as zon
from lodestar.sources import images as src

#: Brightness of the pixel (x, y) of nation k's picture, in both dialects; and of its frame, a bright box on a dark ground.
TEXTURE = "(k * 37 + x * (3 + k % 5) + y * (8 + k % 3) + {div}(x * y * (1 + k % 4), 7)) % 256"
BOX_X, BOX_Y, BOX_W, BOX_H = "(10 + k % 5 * 4)", "(8 + k % 4 * 5)", "(60 + k * 7 % 70)", "(40 + k * 5 % 50)"
BOX = f"CASE WHEN x >= {BOX_X} AND x < {BOX_X} + {BOX_W} AND y >= {BOX_Y} AND y < {BOX_Y} + {BOX_H} THEN 160 + (x - {BOX_X}) % 80 ELSE 25 END"


def _drawn(spark: SparkSession, sf_dir: str, width: int, height: int, pixel: str) -> DataFrame:
    """(id, width, height, channels, data): one gray picture for each nation."""
    value = pixel.format(div="idiv").replace("idiv(x * y * (1 + k % 4), 7)", "((x * y * (1 + k % 4)) div 7)")
    value = " ".join({"x": f"(i % {width})", "y": f"(i div {width})"}.get(t, t) for t in value.replace("(", " ( ").replace(")", " ) ").split())
    data = F.expr(f"unhex(array_join(transform(sequence(0L, {width * height - 1}L), i -> lpad(hex({value}), 2, '0')), ''))")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey")
    return rows.select(F.col("k").cast("string").alias("id"), "n_regionkey", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(1).alias("channels"), data.alias("data"))


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, 48, 48, TEXTURE)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, 160, 120, BOX)


def _px(width: int, height: int, pixel: str) -> str:
    """px(k, x, y, v, g): the pixels, as bytes and as single-precision brightness."""
    value = pixel.format(div="idiv").replace("idiv(x * y * (1 + k % 4), 7)", "((x * y * (1 + k % 4)) // 7)")
    return f"""px AS MATERIALIZED (SELECT k, n_regionkey, x, y, v, CAST(v / 255.0 AS FLOAT) AS g FROM (SELECT k, n_regionkey, x, y, {value} AS v
      FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_regionkey FROM nation), (SELECT unnest(range(0, {width})) AS x), (SELECT unnest(range(0, {height})) AS y)))"""


def _mean(of: str, width: int, height: int, to_w: int, to_h: int) -> str:
    """small(k, u, w, m): box means of an image of the size, in single precision."""
    return f"""small AS MATERIALIZED (SELECT k, u, w, CAST(avg(CAST(g AS DOUBLE)) AS FLOAT) AS m FROM {of},
      (SELECT u, u * {width} // {to_w} AS x0, greatest(u * {width} // {to_w} + 1, (u + 1) * {width} // {to_w}) AS x1 FROM (SELECT unnest(range(0, {to_w})) AS u)),
      (SELECT w, w * {height} // {to_h} AS y0, greatest(w * {height} // {to_h} + 1, (w + 1) * {height} // {to_h}) AS y1 FROM (SELECT unnest(range(0, {to_h})) AS w))
      WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY k, u, w)"""


def image_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture as 30 x 60 box means: smaller one way, larger the other."""
    out = src.resized(_squares(spark, sf_dir), 30, 60)
    return out.select("id", F.posexplode("values").alias("pos", "v")).select("id", "pos", F.round("v", 5).alias("v"))


def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both 64-bit hashes of each whole picture."""
    return src.window_features(_squares(spark, sf_dir)).where("w = 0").select("id", "p", "d")


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brightness and the band-pass vector of each whole picture, by position."""
    rows = src.window_features(_squares(spark, sf_dir)).where("w = 0")
    return rows.select("id", F.posexplode(F.arrays_zip("vec", "vec_bp")).alias("pos", "z")).select("id", "pos", F.col("z.vec").alias("vec"), F.col("z.vec_bp").alias("vec_bp"))


def image_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference hash of all ten windows of each picture and of its three crops."""
    return src.window_features(_squares(spark, sf_dir), ident.INSETS).select("id", "attempt", "w", "d")


def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected bright parts of each picture."""
    return src.shapes(_drawn(spark, sf_dir, 20, 14, TEXTURE), 0.7).select(F.col("image").alias("id"), "area", "x0", "y0", "x1", "y1")


def image_largest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of each picture's three largest bright parts."""
    from pyspark.sql import Window as W

    rows = src.shapes(_drawn(spark, sf_dir, 20, 14, TEXTURE), 0.7)
    rank = F.row_number().over(W.partitionBy("image").orderBy(F.desc("area"), "shape"))
    return rows.withColumn("rank", rank).where("rank <= 3").select(F.col("image").alias("id"), "rank", "area")


def image_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clamped threshold of each picture's pixels."""
    rows = src.resized(_squares(spark, sf_dir), 48, 48).select("id", F.explode("values").alias("v"))
    return hist.otsu(rows, "id", "v")


def image_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each picture's strip of text, those that look like ink, and whether their share is plausible."""
    out = src.inks(_drawn(spark, sf_dir, 120, 80, TEXTURE))
    return out.select("id", "pixels", "ink", (F.col("ink") / F.col("pixels")).between(0.005, 0.35).alias("plausible"))


def image_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of each plausible bright box."""
    out = src.quads(_boxes(spark, sf_dir))
    return out.select("id", "found", F.array_join(F.transform("corners", lambda c: F.format_string("%.3f", c)), " ").alias("corners"))


def image_rectified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 73rd pixel, across and down, of the boxes seen from the front."""
    return src.rectified(_boxes(spark, sf_dir), 73).select("id", F.posexplode("values").alias("pos", "v")).select("id", "pos", F.round("v", 4).alias("v"))


def image_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last three pictures of each region, by position."""
    rows = _drawn(spark, sf_dir, 20, 14, TEXTURE).withColumn("id", F.lpad("id", 3, "0"))
    out = src.averaged(rows, "n_regionkey", 3)
    return out.select("n_regionkey", "n", F.posexplode("values").alias("pos", "v")).select("n_regionkey", "n", "pos", F.round("v", 6).alias("v"))


def image_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each picture's RGBA bytes."""
    return src.preview(_squares(spark, sf_dir)).select("id", F.octet_length("rgba").alias("size"), F.sha2("rgba", 256).alias("sha"))


def _match(spark: SparkSession, sf_dir: str, images: DataFrame, call, **more) -> DataFrame:
    own = _squares(spark, sf_dir)
    variants = ident.catalogue(src.window_features(own), F.col("id").cast("long"))
    variants = variants.withColumn("zone_key", (F.col("entry") % 5).cast("string"))
    return call(images, variants, **more)


def match_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture, matched as it is, is found as itself, at once and in full agreement."""
    out = _match(spark, sf_dir, _squares(spark, sf_dir), ident.match_with_crops)
    return out.select("id", "entry", F.round("ncc", 6).alias("ncc"), F.col("hamming").cast("int").alias("hamming"), (F.col("confidence") >= 0.6).alias("sure"))


def match_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture inside a dark frame is found as itself by the crop that takes the frame off."""
    inner = TEXTURE.replace("x", "(x - 2)").replace("y", "(y - 2)").replace("{div}((x - 2) * (y - 2)", "{div}(x * y").replace("idiv(x * y", "idiv((x - 2) * (y - 2)")
    value = inner.format(div="idiv").replace("idiv(x * y * (1 + k % 4), 7)", "(((x - 2) * (y - 2) * (1 + k % 4)) div 7)")
    framed = f"CASE WHEN x >= 2 AND x < 50 AND y >= 2 AND y < 50 THEN {value} ELSE 12 END"
    return _match(spark, sf_dir, _drawn(spark, sf_dir, 52, 52, framed), ident.match_smart, options=ident.MatchOptions(rectified=False, insets=(0.04,))).select("id", "entry", F.round("ncc", 6).alias("ncc"))


def match_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture, matched within one zone, finds an entry of that zone, and itself if it is one."""
    out = _match(spark, sf_dir, _squares(spark, sf_dir), ident.match_screenshots, zone_key="3")
    return out.select("id", (F.col("entry") % 5).cast("int").alias("zone"), (F.col("entry") == F.col("id").cast("long")).alias("itself"))


def zone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone names, as read, with the keys of the zones they name."""
    letters = F.translate(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "0123456789", "abcdefghij")
    zones = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.repeat(letters, 4).alias("zone_label"), F.col("n_nationkey").cast("string").alias("zone_key"), F.col("n_nationkey").alias("ord"))
    found = zon.match_zones(zones.select(F.concat(F.upper("zone_label"), F.lit(" 7")).alias("text")), zones.select(F.col("zone_label").alias("zone"), "ord"), "latin")
    return cat.keyed(found, zones).select("text", "zone_key")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each customer: a saved code, else the first known one of three, else en; its script, and a message in it."""
    code = lambda n: F.get(F.array(*map(F.lit, ("ja", "pt-BR", "fr-CA", "xx", "KO", "zh_TW", "de-AT", ""))), ((F.col("c_custkey") * n) % 8).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", code(1).alias("saved"), F.array(code(3), code(5), code(7)).alias("browser"), "c_mktsegment")
    rows = rows.withColumn("lang", txt.pick_language(F.col("saved"), F.col("browser")))
    said = txt.filled(F.lit("{who} reads {lang}, {who}"), {"who": F.col("c_mktsegment"), "lang": F.col("lang")})
    return rows.select("c_custkey", "lang", txt.is_language(F.col("saved")).alias("known"), txt.script_of(F.col("lang")).alias("script"), said.alias("said"))


def normalised_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each script keeps of a mixed text."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    mixed = F.concat(F.lit("クル ザス西部-"), "p_name", F.lit(" 얀샤!延夏12ー "), F.col("p_size").cast("string"), F.lit("ァ東萨"))
    return part.select("p_partkey", *[txt.normalise(mixed, s).alias(s) for s in ("ja", "ko", "zh", "latin")])


def grade_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by their translation where there is one."""
    own = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Grade "), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lit(""))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", cat.grade_name(own, F.col("c_mktsegment")).alias("grade"))


def scan_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the widget is too small in the frame, and the message that goes first."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    small = dec.too_small(F.when(F.col("p_size") != 7, F.col("p_size").cast("double")), F.lit(100.0))
    return part.select("p_partkey", small.alias("small"), dec.hint(F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 3 == 0, small).alias("hint"))


def read_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a one-shot query, without those that came after its time-out."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", src.within(F.col("p_name"), F.col("p_partkey") * 7 % 8000).alias("text"))

QUERIES = {
    f.__name__: f
    for f in (
        image_resized, image_hashes, image_vectors, image_windows, image_shapes, image_largest_shapes, image_otsu, image_ink, image_quads, image_rectified, image_average, image_preview,
        match_crops, match_framed, match_in_zone, zone_keys, languages, normalised_scripts, grade_names, scan_hints, read_in_time,
    )
}

_PARTS = f"""WITH RECURSIVE {_px(20, 14, TEXTURE)}, on_ AS (SELECT k, x, y, y * 20 + x AS n FROM px WHERE g > 0.7),
reach(k, x, y, n) AS (SELECT k, x, y, n FROM on_ UNION SELECT o.k, o.x, o.y, r.n FROM reach r JOIN on_ o ON o.k = r.k AND abs(o.x - r.x) + abs(o.y - r.y) = 1),
label AS (SELECT k, x, y, min(n) AS n FROM reach GROUP BY k, x, y),
part AS (SELECT CAST(k AS VARCHAR) AS id, n, CAST(count(*) AS INTEGER) AS area, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y1 FROM label GROUP BY k, n)"""
_BITS = "CAST(CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END AS BIGINT)"
_BIT = "sum(CASE WHEN {0} THEN CAST(1 AS HUGEINT) << CAST({1} AS INTEGER) ELSE 0 END)"
_VALID = f"bw * bh / 19200.0 BETWEEN 0.05 AND 0.97 AND bw - 1 >= 160 * 0.22 AND bh - 1 >= 120 * 0.22 AND (bw - 1) / CAST(bh - 1 AS DOUBLE) BETWEEN 0.85 AND 1.7"
_BOXES = f"box AS (SELECT k, {BOX_X} AS bx, {BOX_Y} AS by_, {BOX_W} AS bw, {BOX_H} AS bh FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation))"
_LANG = "('ja', 'en', 'de', 'fr', 'ko', 'zh')"
SQL = {
    "image_resized": f"WITH {_px(48, 48, TEXTURE)}, {_mean('px', 48, 48, 30, 60)} SELECT CAST(k AS VARCHAR) AS id, CAST(w * 30 + u AS INTEGER) AS pos, round(CAST(m AS DOUBLE), 5) AS v FROM small",
    "image_hashes": f"""WITH {_px(48, 48, TEXTURE)}, {_mean('px', 48, 48, 9, 8)}, dh AS (SELECT k, {_BIT.format('m < r', 'w * 8 + u')} AS b FROM (SELECT *, lead(m) OVER (PARTITION BY k, w ORDER BY u) AS r FROM small) WHERE u < 8 GROUP BY k),
        {_mean('px', 48, 48, 32, 32).replace('small', 'big')},
        co AS (SELECT k, f, h, sum(CAST(m AS DOUBLE) * cos((2 * u + 1) * f * pi() / 64) * cos((2 * w + 1) * h * pi() / 64)) AS c FROM big, (SELECT unnest(range(0, 8)) AS f), (SELECT unnest(range(0, 8)) AS h) GROUP BY k, f, h),
        cut AS (SELECT k, avg(c) AS t FROM (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY c) AS rn FROM co WHERE f + h > 0) WHERE rn IN (31, 32) GROUP BY k),
        ph AS (SELECT k, {_BIT.format('f + h > 0 AND c > t', 'h * 8 + f')} AS b FROM co JOIN cut USING (k) GROUP BY k)
        SELECT CAST(p.k AS VARCHAR) AS id, p.p, d.d FROM (SELECT k, {_BITS} AS p FROM ph) p JOIN (SELECT k, {_BITS} AS d FROM dh) d USING (k)""",
    "image_vectors": f"""WITH {_px(48, 48, TEXTURE)}, {_mean('px', 48, 48, 16, 16)},
        near AS (SELECT k, u, w, sum(CAST(s.m AS DOUBLE)) / 9 AS a FROM (SELECT a.k, a.u, a.w, least(15, greatest(0, a.u + i)) AS nu, least(15, greatest(0, a.w + j)) AS nw FROM small a, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j)) n
          JOIN (SELECT k AS sk, u AS su, w AS sw, m FROM small) s ON s.sk = n.k AND s.su = nu AND s.sw = nw GROUP BY k, u, w)
        SELECT CAST(k AS VARCHAR) AS id, CAST(w * 16 + u AS INTEGER) AS pos, CAST(round_even(CAST(m AS DOUBLE) * 255, 0) AS INTEGER) AS vec,
          CAST(least(255, greatest(0, round_even((CAST(m AS DOUBLE) - a) * 400, 0) + 128)) AS INTEGER) AS vec_bp FROM small JOIN near USING (k, u, w)""",
    "image_windows": f"""WITH {_px(48, 48, TEXTURE)},
        tries AS (SELECT attempt, CASE WHEN s = 0 THEN 0 ELSE CAST(round_even(48 * s, 0) AS INTEGER) END AS o, CASE WHEN s = 0 THEN 48 ELSE CAST(round_even(48 * (1 - 2 * s), 0) AS INTEGER) END AS n
          FROM (VALUES (0, 0.0::DOUBLE), (1, 0.04), (2, 0.08), (3, 0.12)) t(attempt, s)),
        wins AS (SELECT 0 AS win, 0.0::DOUBLE AS fx, 0.0::DOUBLE AS fy, 1.0::DOUBLE AS e UNION ALL
          SELECT 1 + i * 3 + j, i * 0.06::DOUBLE, j * 0.06::DOUBLE, 0.88 FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 3)) AS j)),
        area AS (SELECT attempt, win, o + CAST(round_even(n * fx, 0) AS INTEGER) AS ox, o + CAST(round_even(n * fy, 0) AS INTEGER) AS oy, CAST(round_even(n * e, 0) AS INTEGER) AS n FROM tries, wins),
        cell AS (SELECT attempt, win, u, w, ox + u * n // 9 AS x0, ox + greatest(u * n // 9 + 1, (u + 1) * n // 9) AS x1, oy + w * n // 8 AS y0, oy + greatest(w * n // 8 + 1, (w + 1) * n // 8) AS y1
          FROM area, (SELECT unnest(range(0, 9)) AS u), (SELECT unnest(range(0, 8)) AS w)),
        m AS (SELECT k, attempt, win, u, w, CAST(avg(CAST(g AS DOUBLE)) AS FLOAT) AS m FROM cell JOIN px ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL),
        h AS (SELECT k, attempt, win, {_BIT.format('m < r', 'w * 8 + u')} AS b FROM (SELECT *, lead(m) OVER (PARTITION BY k, attempt, win, w ORDER BY u) AS r FROM m) WHERE u < 8 GROUP BY ALL)
        SELECT CAST(k AS VARCHAR) AS id, attempt, CAST(win AS INTEGER) AS w, {_BITS} AS d FROM h""",
    "image_shapes": f"{_PARTS} SELECT id, area, x0, y0, x1, y1 FROM part",
    "image_largest_shapes": f"{_PARTS} SELECT id, CAST(rank AS INTEGER) AS rank, area FROM (SELECT id, area, row_number() OVER (PARTITION BY id ORDER BY area DESC, n) AS rank FROM part) WHERE rank <= 3",
    "image_otsu": f"""WITH {_px(48, 48, TEXTURE)}, b AS (SELECT k, CAST(least(63, floor(CAST(g AS DOUBLE) * 64)) AS INTEGER) AS bin, count(*) AS n FROM px GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER u AS nb, sum(n * bin) OVER u AS sb, sum(n) OVER (PARTITION BY k) AS nt, sum(n * bin) OVER (PARTITION BY k) AS st FROM b WINDOW u AS (PARTITION BY k ORDER BY bin ROWS UNBOUNDED PRECEDING))
        SELECT CAST(k AS VARCHAR) AS id, least(0.8, greatest(0.3, (bin + 1) / 64)) AS threshold FROM c WHERE nb < nt QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(nb AS DOUBLE) * (nt - nb) * pow(sb / nb - (st - sb) / (nt - nb), 2) DESC, bin) = 1""",
    "image_ink": f"""WITH {_px(120, 80, TEXTURE)},
        strip AS MATERIALIZED (SELECT k, x, y, CAST(avg(CAST(g AS DOUBLE)) AS FLOAT) AS s FROM (SELECT a.k, a.x, a.y, b.g FROM px a, (SELECT unnest(range(-2, 3)) AS i) JOIN px b ON b.k = a.k AND b.y = a.y AND b.x = least(119, greatest(0, a.x + i)) WHERE a.x < 84 AND a.y < 16) GROUP BY k, x, y),
        near AS (SELECT a.k, a.x, a.y, a.s, CAST(avg(CAST(b.s AS DOUBLE)) AS FLOAT) AS l FROM strip a JOIN strip b ON b.k = a.k AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5 GROUP BY ALL),
        bright AS (SELECT k, s AS b FROM strip QUALIFY row_number() OVER (PARTITION BY k ORDER BY s) - 1 = floor(count(*) OVER (PARTITION BY k) * 0.8)),
        ink AS (SELECT k, count(*) AS pixels, count(*) FILTER (CAST(s AS DOUBLE) - CAST(l AS DOUBLE) > 0.08 AND l < CAST(CAST(b AS DOUBLE) - 0.06 AS FLOAT)) AS ink FROM near JOIN bright USING (k) GROUP BY k)
        SELECT CAST(k AS VARCHAR) AS id, CAST(pixels AS INTEGER) AS pixels, CAST(ink AS INTEGER) AS ink, ink / pixels BETWEEN 0.005 AND 0.35 AS plausible FROM ink""",
    "image_quads": f"""WITH {_BOXES} SELECT CAST(k AS VARCHAR) AS id, {_VALID} AS found, CASE WHEN {_VALID} THEN
        printf('%.3f %.3f %.3f %.3f %.3f %.3f %.3f %.3f', bx + 0.5, by_ + 0.5, bx + bw - 0.5, by_ + 0.5, bx + bw - 0.5, by_ + bh - 0.5, bx + 0.5, by_ + bh - 0.5) ELSE '' END AS corners FROM box""",
    "image_rectified": f"""WITH {_px(160, 120, BOX)}, {_BOXES},
        at_ AS (SELECT k, CAST(j * 7 + i AS INTEGER) AS pos, bx + 0.5 + i * 73 * (bw - 1) / 439.0::DOUBLE AS sx, by_ + 0.5 + j * 73 * (bh - 1) / 380.0::DOUBLE AS sy FROM box, (SELECT unnest(range(0, 7)) AS i), (SELECT unnest(range(0, 6)) AS j) WHERE {_VALID})
        SELECT CAST(a.k AS VARCHAR) AS id, pos, round(sum(CAST(g AS DOUBLE) * (1 - abs(sx - x)) * (1 - abs(sy - y))), 4) AS v FROM at_ a JOIN px p ON p.k = a.k AND abs(sx - x) < 1 AND abs(sy - y) < 1 GROUP BY a.k, pos""",
    "image_average": f"""WITH {_px(20, 14, TEXTURE)}, r AS (SELECT *, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY k DESC) AS rk FROM px)
        SELECT n_regionkey, count(*) AS n, CAST(y * 20 + x AS INTEGER) AS pos, round(avg(v) / 255, 6) AS v FROM r WHERE rk <= 3 GROUP BY n_regionkey, x, y HAVING count(*) >= 3""",
    "image_preview": f"WITH {_px(48, 48, TEXTURE)} SELECT CAST(k AS VARCHAR) AS id, CAST(48 * 48 * 4 AS INTEGER) AS size, sha256(unhex(string_agg(repeat(printf('%02X', v), 3) || 'FF', '' ORDER BY y, x))) AS sha FROM px GROUP BY k",
    "match_crops": "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS BIGINT) AS entry, 1.0::DOUBLE AS ncc, CAST(0 AS INTEGER) AS hamming, true AS sure FROM nation",
    "match_framed": "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS BIGINT) AS entry, 1.0::DOUBLE AS ncc FROM nation",
    "match_in_zone": "SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(3 AS INTEGER) AS zone, n_nationkey % 5 = 3 AS itself FROM nation",
    "zone_keys": "SELECT upper(repeat(translate(lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), '0123456789', 'abcdefghij'), 4)) || ' 7' AS text, CAST(n_nationkey AS VARCHAR) AS zone_key FROM nation",
    "languages": f"""WITH c AS (SELECT c_custkey, c_mktsegment, lower(left(l[c_custkey * 3 % 8 + 1], 2)) AS b1, lower(left(l[c_custkey * 5 % 8 + 1], 2)) AS b2, lower(left(l[c_custkey * 7 % 8 + 1], 2)) AS b3, l[c_custkey % 8 + 1] AS saved
          FROM customer, (SELECT ['ja', 'pt-BR', 'fr-CA', 'xx', 'KO', 'zh_TW', 'de-AT', ''] AS l)),
        p AS (SELECT *, CASE WHEN saved IN {_LANG} THEN saved WHEN b1 IN {_LANG} THEN b1 WHEN b2 IN {_LANG} THEN b2 WHEN b3 IN {_LANG} THEN b3 ELSE 'en' END AS lang FROM c)
        SELECT c_custkey, lang, saved IN {_LANG} AS known, CASE WHEN lang IN ('en', 'de', 'fr') THEN 'latin' ELSE lang END AS script, c_mktsegment || ' reads ' || lang || ', ' || c_mktsegment AS said FROM p""",
    "normalised_scripts": """WITH t AS (SELECT p_partkey, 'クル ザス西部-' || p_name || ' 얀샤!延夏12ー ' || p_size || 'ァ東萨' AS t FROM part)
        SELECT p_partkey, array_to_string(regexp_extract_all(t, '[ぁ-んァ-ヶー一-龯]'), '') AS ja, array_to_string(regexp_extract_all(t, '[가-힣]'), '') AS ko, array_to_string(regexp_extract_all(t, '[一-鿿]'), '') AS zh,
          array_to_string(regexp_extract_all(lower(t), '[a-z]'), '') AS latin FROM t""",
    "grade_names": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Grade ' || c_mktsegment WHEN 1 THEN '' ELSE c_mktsegment END AS grade FROM customer",
    "scan_hints": "SELECT p_partkey, p_size <> 7 AND p_size < 30 AS small, CASE WHEN p_partkey % 5 = 0 THEN 'low_confidence' WHEN p_partkey % 3 = 0 THEN 'zone_locked' WHEN p_size <> 7 AND p_size < 30 THEN 'too_small' ELSE 'default' END AS hint FROM part",
    "read_in_time": "SELECT p_partkey, CASE WHEN p_partkey * 7 % 8000 < 4000 THEN p_name END AS text FROM part",
}
