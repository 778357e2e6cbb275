"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, table, written

#: Labelled rows that the fit takes at most, terms of the lexicon, and the least documents and log-odds of a term.
SAMPLE, TERMS, LEAST_DOCS, LEAST_ODDS = 6000, 300, 5, 1.3
#: Terms are whole words, or beginnings of words of these lengths.
STEMS = range(4, 9)
AT = 0.7
#: What a text is measured by; all but the last grow with its hits.
FEATURES = 5
#: Look-alikes of Latin letters, and letters that digits stand for.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмнтвαβεικνορτυχ0123456789@", "aeopcyxijshdqwkmhtbabeikvoptuxoizeasgtbga", strict=True))


class _Fold(dict):
    """Code point -> folded letter, or a space for what is no letter; filled as characters occur."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        plain = LOOKALIKES.get(c)
        if plain is None:
            wide = unicodedata.normalize("NFKC", c).lower()
            plain = "" if unicodedata.category(c) in ("Cf", "Mn") else "i" if wide == "l" else wide if wide.isalpha() else " "
        self[cp] = plain
        return plain


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Lower case, look-alikes and digits as letters, l as i, format characters gone, all else one space each; a space at both ends."""
    return f" {(text or '').lower().translate(_FOLD)} "


def word_terms(text: str | None) -> Counter:
    """Counts of the lexicon's possible terms: ` word ` and ` stem`."""
    out: Counter = Counter()
    for w, n in Counter(folded(text).split()).items():
        out[f" {w} "] += n
        for k in STEMS:
            if len(w) >= k:
                out[f" {w[:k]}"] += n
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: list[str]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    low: np.ndarray = field(default_factory=lambda: np.full(FEATURES, -np.inf))
    high: np.ndarray = field(default_factory=lambda: np.full(FEATURES, np.inf))
    coef: np.ndarray = field(default_factory=lambda: np.array([-2.0] + [0.0] * FEATURES))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), term, weight))
        for term in self.exceptions:
            found.add_word(term, (len(term), None, 0.0))
        if len(found):
            found.make_automaton()
        return found

    def measure(self, found: ahocorasick.Automaton, text: str | None) -> list[float]:
        """Logarithms of the weighted hits by length, of the hits with and without repeats, of those of different words, and of the length; hits inside an exception don't count."""
        s = folded(text)
        hits, spared = [], []
        if len(found):
            for end, (n, term, weight) in found.iter(s):
                if term is None:
                    spared.append((end - n + 1, end))
                else:
                    hits.append((end - n + 1, end, term, weight))
        if spared:  # whole words, none inside another, in the order of the text
            starts = [a for a, _ in spared]
            hits = [h for h in hits if not ((k := bisect_right(starts, h[0])) and h[1] <= spared[k - 1][1])]
        words_hit = {(s[h[0] + 1 : s.find(" ", h[0] + 1)], h[2]) for h in hits}
        each = Counter(h[2] for h in hits)
        total = sum(self.weights[t] * n for t, n in each.items())
        capped = sum(self.weights[t] * min(n, 3) for t, n in each.items())
        different = sum(self.weights[t] for _, t in words_hit)
        words = len(s.split())
        return [math.log1p(100 * total / (words + 20)), math.log1p(total), math.log1p(capped), math.log1p(different), math.log1p(words)]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)  # no further than the rows of the fit
        z = self.coef[0] + ((x - self.mean) / self.scale) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _calibrated(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Logistic regression by Newton steps with a small ridge. More hits never lower a score: features of hits whose
    coefficient would be negative are left out one by one."""
    if len(y) == 0 or y.min() == y.max():
        return model
    model.mean, model.scale, model.low, model.high = x.mean(0), np.maximum(x.std(0), 0.1), x.min(0), x.max(0)
    full = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    used = list(range(full.shape[1]))
    while True:
        z, w = full[:, used], np.zeros(len(used))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (y - p) - 0.5 * w)
        low = [(c, k) for c, k in zip(w, used, strict=True) if 0 < k < FEATURES and c < 0]
        if not low:
            break
        used.remove(min(low)[1])
    model.coef = np.zeros(full.shape[1])
    model.coef[used] = w
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms, capped at 3 a document, in toxic and other texts."""
    bad, good, docs = Counter(), Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for term, n in word_terms(text).items():
                (bad if toxic else good)[term] += min(n, 3)
                docs[term] += toxic
    terms = list(bad | good)
    yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "bad": pa.array([bad[t] for t in terms], pa.int64()), "good": pa.array([good[t] for t in terms], pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most `sample` labelled rows (those of least hash); rows without id, label or document are left out.

    Terms are counted by Spark; the driver gets the best few thousand and the features of the sample.
    Exceptions are whole words that begin like a term but occur, repeatedly, in texts that aren't toxic only.
    """
    some = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `sample` rows of 12 bytes
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")  # one row of a repeated id
    n_bad, n_all = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    counts = rows.mapInArrow(_counted, "term string, bad long, good long, docs long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("docs").alias("docs"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_all - n_bad + 1))
    counts = written(counts.withColumn("odds", odds), "terms")
    best = counts.where((F.col("docs") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS)).orderBy((F.col("bad") * F.col("odds")).desc(), "term").limit(10 * TERMS).collect()
    weights: dict[str, float] = {}
    for r in best:
        stem = r["term"].strip()
        if len(weights) < TERMS and not any(stem.startswith(t.strip()) or t.strip().startswith(stem) for t in weights):
            weights[r["term"]] = r["odds"]
    stems = [t for t in weights if not t.endswith(" ")]
    spared = counts.where(F.endswith("term", F.lit(" ")) & (F.col("bad") == 0) & (F.col("good") >= 3)).where(
        F.exists(F.array(*map(F.lit, stems)) if stems else F.array().cast("array<string>"), lambda s: F.startswith("term", s))
    )
    exceptions = [r["term"] for r in spared.orderBy(F.col("good").desc(), "term").limit(10 * TERMS).select("term").collect()]
    model = ToxicityModel(weights, exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            xs = [model.measure(found, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(xs, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.mapInArrow(measured, "toxic int, x array<double>").toPandas()
    discard(counts, rows)
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    order = np.lexsort(x.T)
    return _calibrated(model, x[order], got["toxic"].to_numpy(float)[order])


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts are scored as texts of no words; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.automaton()
        for batch in batches:
            xs = np.array([model.measure(found, t.as_py()) for t in batch.column("text")], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(xs))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out() -> Column:
    """True where the label must not be learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null or empty text is scored as one of no words; a null doc_id is not held out; repeated rows are scored alike, each
    on its own; a text of any length is read once; an empty table gives no rows, and without labels no term has a weight.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
