"""A reader that fails, is slow or can't be loaded gives statuses, and is loaded anew."""

import os

from lodestar.sources import reader

BANDS = "id string, width int, height int, data binary"


def bands(spark, texts):
    return spark.createDataFrame([(f"{k:02}", None if t is None else len(t), 1, None if t is None else t.encode()) for k, t in enumerate(texts)], BANDS).coalesce(1)


def test_statuses_and_reload(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import time
        import uuid

        open(f"{log}/{uuid.uuid4().hex}", "w").close()

        def read(band):
            text = band.tobytes().decode()
            if text == "bad":
                raise RuntimeError(text)
            if text == "slow":
                time.sleep(3)
            return "" if text == "none" else text

        return read

    texts = ["one", "two", "bad", "three", "slow", "none", "four", None, "", "bad"]
    got = [(r.text, r.status) for r in reader.recognised(bands(spark, texts), load, "first", 500).orderBy("id").collect()]
    assert got == [("one", "read"), ("two", "read"), (None, "failed"), ("three", "read"), (None, "timeout"), (None, "empty"), ("four", "read"), (None, "empty"), (None, "empty"), (None, "failed")]
    assert len(os.listdir(log)) == 3  # at first, after the failure, after the time-out
    assert reader.recognised(bands(spark, []), load, "first").count() == 0


def test_load_that_fails_is_repeated(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import uuid

        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        if len(os.listdir(log)) < 3:
            raise OSError("no model")
        return lambda band: band.tobytes().decode()

    got = [(r.text, r.status) for r in reader.recognised(bands(spark, ["a", "b", "c", "d"]), load, "second").orderBy("id").collect()]
    assert got == [(None, "unavailable"), (None, "unavailable"), ("c", "read"), ("d", "read")] and len(os.listdir(log)) == 3


def test_model_is_kept_over_tasks(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import uuid

        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        return lambda band: band.tobytes().decode()

    rows = bands(spark, [str(k) for k in range(200)]).repartition(100)
    assert reader.recognised(rows, load, "kept").where("status = 'read'").count() == 200 and len(os.listdir(log)) < 50


def test_zone_of_a_reading(spark):
    def load():
        return lambda band: band.tobytes().decode()

    zones = spark.createDataFrame([("Northern Harbour", 0), ("Silver Meadow", 1)], "zone string, ord long")
    got = reader.zone_readings(bands(spark, ["nothern harbor", "silvr meadow", "silvr meadow", "qqqq", None]), load, "third", zones, "latin").orderBy("id").collect()
    assert [(r.status, r.zone) for r in got] == [("read", "Northern Harbour"), ("read", "Silver Meadow"), ("read", "Silver Meadow"), ("read", None), ("empty", None)]


def test_slow_bands_of_one_file_are_dealt(spark):
    """Forty bands in one partition that take too long: half a minute one after the other."""
    import time

    from pyspark.sql import functions as F

    def load():
        def read(band):
            time.sleep(3)

        return read

    bands = spark.range(40).coalesce(1).select("id", F.lit(1).alias("width"), F.lit(1).alias("height"), F.unhex(F.lit("01")).alias("data"))
    began = time.monotonic()
    rows = reader.recognised(bands, load, "slow", 750, lanes=4).collect()
    assert {r.status for r in rows} == {"timeout"} and len({r.id for r in rows}) == len(rows) == 40 and time.monotonic() - began < 20
