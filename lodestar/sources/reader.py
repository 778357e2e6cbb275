"""A recogniser of text called within tasks: its model kept by the worker, a deadline for each call, and a status."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.zones import match_zones
from lodestar.sources.images import READ_MS
from lodestar.sources.shared import stored

READ = "id string, text string, status string"
#: The models that this Python worker has loaded, by name; a worker serves one task at a time.
_loaded: dict[str, Any] = {}


def _by(seconds: float, f: Callable[[], Any]) -> tuple[str, Any]:
    """(status, what f gives), `timeout` if it takes longer; then it goes on in a thread that nobody waits for."""
    box: list[tuple[str, Any]] = []

    def call() -> None:
        try:
            box.append(("read", f()))
        except Exception as e:  # whatever a recogniser raises is a status of its row
            box.append(("failed", e))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    return box[0] if box else ("timeout", None)


def _read(row: Any, load: Callable, name: Any, limit_ms: int, load_ms: int) -> tuple[str | None, str]:
    """(text, status) of one band by the model that _loaded holds under a name. At the module's top, so that all tasks of a worker share _loaded."""
    if row.data is None or pd.isna(row.width) or pd.isna(row.height) or not row.width * row.height:
        return None, "empty"
    if name not in _loaded:
        status, model = _by(load_ms / 1000, load)
        if status != "read":
            return None, "unavailable"
        _loaded[name] = model
    model, band = _loaded[name], np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width))
    status, text = _by(limit_ms / 1000, lambda: model(band))
    if status != "read":
        del _loaded[name]
        return None, status
    return (text, status) if text else (None, "empty")


def recognised(bands: DataFrame, load: Callable[[], Callable[[np.ndarray], str | None]], name: str, limit_ms: int = READ_MS, load_ms: int = 60_000, lanes: int = 1) -> DataFrame:
    """(id, text, status) of bands (id, width, height, data), by a recogniser that load() gives. None comes with the library.

    Statuses: read; empty (it found no text, or there is no band to read); failed (it raised an error); timeout (it took
    longer than limit_ms); unavailable (load() raised an error, or took longer than load_ms). Only read has a text. The
    model is kept under `name` by each Python worker, over tasks and micro-batches. After a failure or a time-out it is
    dropped and the next row loads it anew, and so does the row after a load that failed: no row is lost, and none waits
    longer than both limits. Recognisers are not safe to call twice at once, so a model reads rows one by one; a worker has
    one model in each of its `lanes`, and a row waits for those of its own lane only. With several lanes rows come
    back in any order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(lanes) as pool:
            for batch in batches:
                rows: Iterator[Any] = batch.itertuples()
                turn, out = threading.Lock(), []

                def lane(k: int, rows: Iterator[Any] = rows, turn: threading.Lock = turn, out: list = out) -> None:
                    while True:
                        with turn:
                            row = next(rows, None)
                        if row is None:
                            return
                        out.append((row.id, *_read(row, load, (name, k), limit_ms, load_ms)))

                list(pool.map(lane, range(lanes)))
                yield pd.DataFrame(out, columns=["id", "text", "status"])

    return bands.select(F.col("id").cast("string").alias("id"), "width", "height", "data").mapInPandas(run, READ)


def zone_readings(bands: DataFrame, load: Callable, name: str, zones: DataFrame, script: str, limit_ms: int = READ_MS, lanes: int = 1) -> DataFrame:
    """(id, text, status, zone): the zone of zones (zone, ord) that the text of each band names in a script, null if it names none.

    Equal texts are matched once. Bands are dealt over all tasks of a shuffle, however few files they come in. Rows are written before that, so that a recogniser is asked once for each band.
    """
    dealt = bands.repartition(int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = stored(recognised(dealt, load, name, limit_ms, lanes=lanes), "readings")
    named = match_zones(read.where("text is not null").select("text").distinct(), zones, script).where("zone is not null").select(F.col("text").alias("_t"), "zone")
    return read.join(named, F.col("text") == F.col("_t"), "left").drop("_t")
