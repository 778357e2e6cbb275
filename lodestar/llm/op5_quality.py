"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import flat_bytes, packets, table
from lodestar.llm.words import Prefix, word_hashes

#: Number of shared weights; labelled rows that the fit takes at most (the ones of least hash, so reruns agree).
BUCKETS = 1 << 15
SAMPLE = 4000
#: A feature's value is SCALE times the root of its share of the words, so that a few telling words count in a long text.
SCALE = 3.0
#: A document is kept if the chance that its grade is KEEP_GRADE or more is KEEP_AT or more.
KEEP_GRADE, KEEP_AT = 1, 0.5
#: Byte classes of a word's ending: letters and non-ASCII are alike, so are digits, other marks stand for themselves.
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(1000)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(sum of weights times values - thresholds[k - 1])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -40, 40)))


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number): two features of each word, itself, and the classes of its last three bytes with whether it repeats the word before."""
    h, start, stop, text = word_hashes(raw, offsets)
    ends = Prefix(_CLASS[raw] * np.uint64(0x9E3779B97F4A7C15), 1).of(np.maximum(stop - 3, start), stop)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    ends += again * np.uint64(0xD6E8FEB86659FD93)
    low = np.uint64(buckets // 2 - 1)
    return np.concatenate([(h & low).astype(np.int64), (ends & low).astype(np.int64) + buckets // 2]), np.concatenate([text, text])


def sparse(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value) of the features of an Arrow column of texts."""
    col, text = features(*flat_bytes(column), buckets)
    words = np.maximum(np.bincount(text, minlength=len(column)) / 2, 1)
    keys, counts = np.unique(text * buckets + col, return_counts=True)
    text = keys // buckets
    return text, keys % buckets, SCALE * np.sqrt(counts / words[text])


def fit(x: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, buckets: int = BUCKETS, rounds: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by Adam; x holds (buckets, values) of each text. Thresholds keep their order as a first value plus positive steps."""
    rows = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    cols = np.concatenate([i for i, _ in x]) if x else np.empty(0, np.int64)
    vals = np.concatenate([v for _, v in x]) if x else np.empty(0)
    w = np.zeros(buckets)
    share = np.array([np.clip((grades >= k).mean() if len(grades) else 0.5, 1e-3, 1 - 1e-3) for k in range(1, levels)])
    first = np.log((1 - share) / share)
    steps = np.log(np.maximum(np.diff(first), 0.1))
    state = [np.concatenate([w, first[:1], steps]), 0.0, 0.0]
    y = grades[:, None] >= np.arange(1, levels)[None, :]
    for t in range(1, rounds + 1 if len(x) else 1):
        p, m, v = state
        theta = p[buckets] + np.concatenate([[0.0], np.cumsum(np.exp(p[buckets + 1 :]))])
        score = np.bincount(rows, vals * p[cols], len(x))
        # ordinal likelihood: log(P(>= g) - P(>= g + 1)), with P(>= 0) = 1 and P(>= levels) = 0
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
        full = np.concatenate([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))], 1)
        slope = full * (1 - full)
        at = np.arange(len(x))
        mass = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        d_score = (slope[at, grades] - slope[at, grades + 1]) / mass / len(x)
        d_theta = np.array([(-(slope[:, k]) / mass * ((grades == k).astype(float) - (grades == k - 1))).sum() for k in range(1, levels)]) / len(x)
        grad = np.concatenate([np.bincount(cols, vals * d_score[rows], buckets) - ridge * p[:buckets], [d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * np.exp(p[buckets + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * np.concatenate([np.full(buckets, 10.0), np.ones(levels - 1)])
        state = [p, m, v]
    p = state[0]
    assert y.shape == (len(x), levels - 1)
    return OrdinalModel(p[:buckets].copy(), p[buckets] + np.concatenate([[0.0], np.cumsum(np.exp(p[buckets + 1 :]))]))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in packets(batch, "text"):
            part = batch.slice(a, b - a)
            text, col, value = sparse(part.column("text"), BUCKETS)
            cut = np.searchsorted(text, np.arange(len(part) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (col.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("grade"), *lists], ["grade", "cols", "vals"])


def train(docs: DataFrame, graded: DataFrame, levels: int, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` rows of graded (doc_id, grade), the rest of the corpus being scored only.

    Rows without id or document and those whose grade is not one of 0..levels-1 are left out; of a repeated doc_id one
    text is taken. Without any rows all documents get a chance of one half. The driver gets at most BUCKETS values a row.
    """
    some = graded.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1)).select("doc_id", F.col("grade").cast("int").alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `sample` rows of 12 bytes
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    got = rows.mapInArrow(_sparse, "grade int, cols array<int>, vals array<float>").toPandas()
    got = got.iloc[np.lexsort((got["cols"].map(len), got["grade"]))]
    x = [(np.asarray(c, np.int64), np.asarray(v, float)) for c, v in zip(got["cols"], got["vals"], strict=True)]
    return fit(x, got["grade"].to_numpy(np.int64), levels)


def scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with expected_grade and tails, an array of P(grade >= 1), P(grade >= 2), ...

    A null or empty text has no features. Rows stay as they are, repeated ones too; an empty table gives none; docs may not
    have columns of these names.
    """
    levels, at = len(model.thresholds), docs.columns.index("text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), [at])
            for a, b in packets(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
                text, col, value = sparse(texts.slice(a, b - a), BUCKETS)
                tails = model.tails(np.bincount(text, value * model.weights[col], b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * levels, pa.int32()), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(tails.sum(1)), lists], ["row", "expected_grade", "tails"])

    kinds = f"row {packed.schema['row'].dataType.simpleString()}, expected_grade double, tails array<double>"
    got = packed.mapInArrow(run, kinds)
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "expected_grade", "tails")


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for quality 0, 1 for quality 1 that is marked toxic, 2 for quality 1 that is not."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose chance of grade KEEP_GRADE or more is KEEP_AT or more, with their columns."""
    model = train(docs, grades(labels), 3)
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    bare = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    good = scored(bare, model).where(F.get("tails", F.lit(KEEP_GRADE - 1)) >= KEEP_AT)
    return good.select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_good (grade 1 or more), p_best (grade 2), keep of every row.

    A null or empty text is graded by the thresholds alone; repeated rows and null ids are graded like others, each row on
    its own; a text of any length is read whole; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, grades(table(spark, sf_dir, "labels")), 3))
    return out.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_good"), F.get("tails", F.lit(1)).alias("p_best"), (F.get("tails", F.lit(KEEP_GRADE - 1)) >= KEEP_AT).alias("keep"))
