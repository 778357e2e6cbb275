"""Substring dedup with a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, sized_broadcast, table, written
from lodestar.llm.repeats import LAST_ID, Windows, copies, digested, merged, named, once, repeated, sampled, with_lists, word_lists

#: Windows of 35 words, named by the 12 consecutive words of least hash in them.
WINDOWS = Windows(35, 12, words=True)
#: Batches that the query adds to the index one after the other, and the runs from which on they are compacted.
BATCHES, MOST_RUNS = 5, 4


class FingerprintIndex:
    """Sorted immutable runs of (key, n): how many window fingerprints of past batches have the key."""

    def __init__(self, windows: Windows = WINDOWS):
        self.windows, self.runs = windows, []

    def add(self, texts: DataFrame) -> DataFrame:
        """Store a batch (rk, text) as a run; returns (key), written, of its keys that repeat, within the batch or with any earlier run (merge joins)."""
        batch = sampled(texts, self.windows).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        batch = written(batch, "run", sort=["key"])
        seen = batch
        for run in self.runs:
            past = run.select("key", F.col("n").alias("past"))
            seen = seen.join(past, "key", "left").select("key", (F.col("n") + F.coalesce("past", F.lit(0))).alias("n"))
        found = written(seen.where("n > 1").select("key"), "keys")
        self.runs.append(batch)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.union(run)
        past, self.runs = self.runs, [written(merged.groupBy("key").agg(F.sum("n").alias("n")), "run", sort=["key"])]
        discard(*past)

    def drop(self) -> None:
        """Delete the runs, for when no batch is to come."""
        discard(*self.runs)
        self.runs = []


def candidates(texts: DataFrame, windows: Windows = WINDOWS, batches: int = BATCHES) -> DataFrame:
    """(rk, place), written, of the runs of windows whose fingerprint repeats.

    The batches enter the index in turn; keys known to repeat, from any of them, select the runs of all documents.
    """
    index, found = FingerprintIndex(windows), []
    for i in range(batches):
        found.append(index.add(texts.where(F.pmod(F.xxhash64("rk"), F.lit(batches)) == i)))
    index.drop()
    keys = found[0]
    for more in found[1:]:
        keys = keys.union(more)
    places = written(sampled(texts, windows).join(written(keys.distinct(), "keys"), "key").select("rk", "place"), "places")
    discard(*found)
    return places


def passages(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, th, low, high) of repeated windows of the texts (id, th, text), and the texts that are copies, of copies()."""
    known = copies(texts, earlier=False)
    first = once(texts, known)
    return repeated(first, candidates(first), WINDOWS, earlier=False), known


def _kept(text: bytes, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(words, kept words) of the text, part by part: those outside start..stop-1. A copy too short for a window keeps all."""
    base = 0
    for words in word_lists(text):
        n = len(words)
        if len(stop) and stop[-1] == LAST_ID:
            yield n, [] if base or n >= WINDOWS.size else words
        else:
            left, at = [], 0
            for a, b in zip(start, stop, strict=True):
                if b > base and a < base + n:
                    left += words[at : max(a - base, at)]
                    at = min(b - base, n)
            yield n, left + words[at:]
        base += n


def _digest(text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[int, int, str]:
    total = left = 0
    name = hashlib.sha256()
    for n, words in _kept(text, start, stop):
        name.update((b" " if left and words else b"") + b" ".join(words))
        total, left = total + n, left + len(words)
    return total, total - left, name.hexdigest()


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A null text has no words; an empty table gives no rows; a null doc_id is kept and its text judged like the others;
    of texts that occur twice or more all words go if they have a window; a text of any length is worked on in pieces.
    Windows are taken as equal if their words are, by a 128-bit cryptographic digest.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranges, known = passages(named(docs))
    columns = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]
    return digested(docs, ranges, known, WINDOWS, _digest, columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i : i + 34], ' ') END AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS rep FROM p),
m AS (SELECT doc_id, i, word, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def removed(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text, and n_chars, if there is one, set to what is left.

    A document that loses nothing keeps its text as it is; else its kept words are joined by one space, also if none is left.
    Null texts stay null, repeated rows stay rows; all columns stay.
    """
    ranges, known = passages(named(docs.select("doc_id", "text")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("th"))
    both = with_lists(rows.join(sized_broadcast(known.select("id", "th", "gone")), ["id", "th"], "left"), ranges, by=["id", "th"], lists=["low", "high"], how="left")
    hit = F.col("low").isNotNull() | F.coalesce("gone", F.lit(False))
    both = both.select("row", F.when(hit, F.col("row.text")).alias("text"), "low", "high", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for text, low, high, gone in zip(batch.column("text"), batch.column("low"), batch.column("high"), batch.column("gone"), strict=True):
                if not text.is_valid:
                    out.append(None)
                    continue
                whole = text.as_py().encode()
                cut = (np.array([0]), np.array([LAST_ID])) if gone.as_py() else merged(low.values.to_numpy(), high.values.to_numpy(), WINDOWS.size)
                parts = [(n, words) for n, words in _kept(whole, *cut)]
                left = [w for _, words in parts for w in words]
                out.append(None if len(left) == sum(n for n, _ in parts) else b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "left"])

    got = both.mapInArrow(run, f"row {both.schema['row'].dataType.simpleString()}, left string")
    text = F.coalesce("left", F.col("row.text"))
    new = {"text": text, "n_chars": F.coalesce(F.length("left").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return got.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
