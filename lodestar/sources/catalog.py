"""The catalogue document as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.numeric import hex_bits

SCHEMA = (
    "version int, entries array<struct<id: string, grade: string, gradeName: string, zone: string, zoneId: int, x: double, y: double,"
    " variants: array<struct<pHash: string, dHash: string, vec16: string, vecBp: string>>>>,"
    " zoneNames map<string, map<string, string>>, gradeNames map<string, map<string, string>>, unavailable map<string, array<string>>"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; the schema is given, so nothing is inferred and missing parts are null."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def entries(doc: DataFrame) -> DataFrame:
    """(entry_idx, id, grade, grade_name, zone, zone_id, x, y, variants); an entry without variants is an error."""
    e = doc.select(F.posexplode("entries").alias("entry_idx", "e"))
    whole = F.when(F.size("e.variants") > 0, F.col("e.variants")).otherwise(F.raise_error(F.concat(F.lit("entry without variants: "), F.coalesce("e.id", F.lit("?")))))
    return e.select("entry_idx", "e.id", "e.grade", F.col("e.gradeName").alias("grade_name"), "e.zone", F.col("e.zoneId").alias("zone_id"), "e.x", "e.y", whole.alias("variants"))


def byte_values(data) -> object:
    """A binary column as an array of 0..255."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))


def variants(rows: DataFrame) -> DataFrame:
    """(flat, entry, id, p, d, vec, vec_bp) of entries(); flat numbers all variants in order."""
    v = rows.select(F.col("entry_idx").alias("entry"), "id", F.posexplode("variants").alias("k", "v"))
    flat = F.col("entry").cast("long") * (1 << 20) + F.col("k")
    return v.select(flat.alias("flat"), "entry", "id", hex_bits(F.col("v.pHash")).alias("p"), hex_bits(F.col("v.dHash")).alias("d"), byte_values(F.unbase64("v.vec16")).alias("vec"), byte_values(F.unbase64("v.vecBp")).alias("vec_bp"))


def names(doc: DataFrame, column: str = "zoneNames") -> DataFrame:
    """(zone_id, lang, name) of a dictionary; the key is a whole number for zones and text for grades."""
    outer = doc.select(F.explode(column).alias("k", "m")).select("k", F.explode("m").alias("lang", "name"))
    return outer.select(F.col("k").cast("int").alias("zone_id"), "lang", "name") if column == "zoneNames" else outer.select(F.col("k").alias("grade"), "lang", "name")


def unavailable(doc: DataFrame) -> DataFrame:
    """(lang, id)."""
    return doc.select(F.explode("unavailable").alias("lang", "ids")).select("lang", F.explode("ids").alias("id"))


def has_names(doc: DataFrame) -> bool:
    return not doc.where(F.col("zoneNames").isNotNull()).isEmpty()


def write_tables(doc: DataFrame, path: str) -> None:
    """The ingest job: entries and variants as Parquet."""
    e = entries(doc)
    e.drop("variants").write.mode("overwrite").parquet(f"{path}/entries")
    variants(e).write.mode("overwrite").parquet(f"{path}/variants")
