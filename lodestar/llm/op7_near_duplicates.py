"""MinHash near-duplicates with BagMinHash signatures of word shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import discard, flat_bytes, packets, sized_broadcast, table, unwrapped, wrapped, written
from lodestar.llm.graph import components
from lodestar.llm.words import counted, mixed, shingles

#: Words of a shingle and the similarity, sum of least counts over sum of largest counts, from which two texts link.
WORDS, SIMILAR = 5, 0.8
#: Two texts of similarity 0.8 miss each other in all bands with a chance of (1 - 0.8 ** ROWS) ** BANDS, 3 in 100,000.
BANDS, ROWS = 20, 4
#: Rounds that link bucket members to another hub each; what they leave apart is then looked up pair by pair.
STARS = 1
_SEED = np.uint64(0x5851F42D4C957F2D)


def bag_signature(key: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, texts x size; rows of texts without elements are 0.

    An element of weight w owns a Poisson process over time and weight level up to w, cut into dyadic blocks of
    levels (0, 1], (1, 2], (2, 4], ... so that a weight needs as many processes as it has bits. Points come in order of
    time; each belongs to a random component, and a component keeps its earliest point. All elements are followed only
    to the time by which every component is likely filled; texts where one is not are followed twice as long.
    The points hang on the element, block and number alone, hence components of two texts agree with a chance that is
    their weighted Jaccard similarity.
    """
    out = np.zeros((texts, size), np.uint64)
    total = np.bincount(text, weight, texts)
    todo = np.flatnonzero(total > 0)
    until = size * (np.log(size) + 4) / np.maximum(total, 1)
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(key)), blocks)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    seed = mixed(key[owner] + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.where(block > 0, 2.0 ** (block - 1), 0.0)
    width = np.where(block > 0, 2.0 ** (block - 1), 1.0)
    while len(todo):
        chosen = np.zeros(texts, bool)
        chosen[todo] = True
        at = np.flatnonzero(chosen[text[owner]])
        time = np.zeros(len(at))
        slots, times, points = [], [], []
        step = 0
        while len(at):
            h = mixed(seed[at] + np.uint64(step * int(_SEED) % 2**64))
            time = time - np.log(((h >> np.uint64(11)).astype(float) + 0.5) / 2**53) / width[at]
            soon = time <= until[text[owner[at]]]
            at, time, h = at[soon], time[soon], h[soon]
            g = mixed(h ^ _SEED)
            level = low[at] + width[at] * ((g >> np.uint64(32)).astype(float) + 0.5) / 2**32
            real = level <= weight[owner[at]]
            slots.append(text[owner[at]][real] * size + (g[real] & np.uint64(0xFFFFFFFF)).astype(np.int64) % size)
            times.append(time[real])
            points.append(mixed(g[real] + np.uint64(1)))
            step += 1
        slot, when, point = np.concatenate(slots), np.concatenate(times), np.concatenate(points)
        first = np.full(texts * size, np.inf)
        np.minimum.at(first, slot, when)
        best = when == first[slot]
        flat = np.zeros(texts * size, np.uint64)
        flat[slot[best]] = point[best]
        full = np.isfinite(first).reshape(texts, size).all(1) & chosen
        out[full] = flat.reshape(texts, size)[full]
        todo = todo[~full[todo]]
        until[todo] *= 2
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in packets(batch, "text"):
            part = batch.slice(a, b - a)
            key, text, weight = counted(*shingles(*flat_bytes(part.column("text")), WORDS))
            sig = bag_signature(key, text, weight, len(part)).reshape(len(part), BANDS, ROWS)
            odd = np.uint64(0x9E3779B97F4A7C15)
            bands = np.zeros((len(part), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = mixed(bands * odd + sig[:, :, r])
            some = np.bincount(text, minlength=len(part)) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "h1", "h2")] + [pa.array(some), lists], ["doc_id", "h1", "h2", "some", "bands"])


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with (h1, h2), a 128-bit name of the text."""
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), F.col("text"))})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, some, bands): a 128-bit name of the text, whether it has words, and its band keys; written to the shared folder."""
    base = _hashed(docs.where("doc_id is not null").select("doc_id", "text")).select("doc_id", "h1", "h2", F.coalesce("text", F.lit("")).alias("text"))
    return written(base.mapInArrow(_sketched, "doc_id long, h1 long, h2 long, some boolean, bands array<long>"), "sketches")


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose texts are similar enough."""
    for batch in batches:
        for lo, hi in packets(batch, "text_a"):
            part = batch.slice(lo, hi - lo)
            (ka, ga), (kb, gb) = (shingles(*flat_bytes(part.column(c)), WORDS) for c in ("text_a", "text_b"))
            key, group = np.concatenate([ka, kb]), np.concatenate([ga, gb])
            order = np.lexsort((key, group))
            key, group, left = key[order], group[order], order < len(ka)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])) if len(key) else np.empty(0, np.int64)
            n_a = np.add.reduceat(left.astype(np.int64), new) if len(new) else new
            n_b = np.diff(np.concatenate([new, [len(key)]])) - n_a
            least = np.bincount(group[new], np.minimum(n_a, n_b), len(part))
            most = np.bincount(group[new], np.maximum(n_a, n_b), len(part))
            yield part.select(["a", "b"]).filter(pa.array((most > 0) & (least >= SIMILAR * most - 1e-9)))


def _texts(nodes: DataFrame, copies: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node), written. Each text is taken from the least doc_id that has it."""
    names = ["doc_id", "h1", "h2"]
    some = _hashed(docs.select("doc_id", "text")).join(sized_broadcast(written(nodes.join(copies.select("node", *names), "node"), "wanted")), names)
    return written(some.groupBy("node").agg(F.max("text").alias("text")), "texts")


def _verified(pairs: DataFrame, copies: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; the texts of the nodes concerned are gathered once."""
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), copies, docs)
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    links = written(pairs.join(left, "a").join(right, "b").mapInArrow(_similarities, "a long, b long"), "links")
    discard(texts)
    return links


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, u): the shingles of each text, numbered so that the bag is a set."""
    for batch in batches:
        ids = batch.column("node").to_numpy()
        for a, b in packets(batch, "text"):
            key, text, weight = counted(*shingles(*flat_bytes(batch.column("text").slice(a, b - a)), WORDS))
            at = np.repeat(np.arange(len(key)), weight)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
            unit = mixed(key[at] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][text[at]]), pa.array(unit.view(np.int64))], ["node", "u"])


def _bounds(named: DataFrame, copies: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (node, n, useful), (node, u) and (u, df): a node's shingles, how many of them occur in another component too,
    all shingles of the nodes kept, and in how many nodes each useful one is.

    A link to another component shares only useful shingles. Similarity s of texts of n and m shingles needs
    s / (1 + s) * (n + m) shared ones, so nodes and pairs with fewer are left out without losing a link.
    """
    nodes = named.select("node", "c").distinct()
    texts = _texts(nodes.select("node"), copies, docs)
    units = written(texts.mapInArrow(_units, "node long, u long"), "units")
    discard(texts)
    useful = units.join(nodes, "node").groupBy("u").agg(F.min("c").alias("l"), F.max("c").alias("m"), F.count(F.lit(1)).alias("df")).where("l < m")
    useful = written(useful.select("u", "df"), "useful")
    some = units.join(useful, "u").groupBy("node").agg(F.count(F.lit(1)).alias("useful"))
    bounds = units.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(some, "node").where(F.col("useful") >= SIMILAR * F.col("n") - 1e-6)
    return written(bounds, "bounds"), units, useful


def _probed(few: DataFrame, every: DataFrame, units: DataFrame, useful: DataFrame) -> DataFrame:
    """(x, y) in different components that may be similar. few: (x, cx, nx, ux); every: (y, cy, ny, uy).

    The useful shingles of every node are ranked from the rarest on, in one order for all. If x and y share t of them, the
    rarest shared one is among the first ux - t + 1 of x and the first uy - t + 1 of y, so only those are looked up.
    A pair of which both are among the few is found once.
    """
    rank = F.row_number().over(W.partitionBy("y").orderBy("df", "u"))
    ranked = every.join(units.withColumnRenamed("node", "y"), "y").join(useful, "u").withColumn("ry", rank)
    rare = written(ranked.where(F.col("ry") <= F.col("uy") - F.ceil(SIMILAR * F.col("ny") - 1e-6) + 1), "rare")
    mine = few.join(rare.select(F.col("y").alias("x"), "u", F.col("ry").alias("rx")), "x")
    theirs = rare.join(few.select(F.col("x").alias("y"), F.lit(True).alias("both")), "y", "left").withColumnRenamed("u", "u2").drop("df")
    shared = F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("nx") + F.col("ny")) - 1e-6)
    near = (F.col("u") == F.col("u2")) & (F.col("cx") != F.col("cy")) & (F.least(F.col("ux") - F.col("rx"), F.col("uy") - F.col("ry")) + 1 >= shared)
    return mine.join(theirs, near & (F.col("both").isNull() | (F.col("x") < F.col("y")))).select("x", "y")


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, class_id, c1, c2) of every distinct doc_id and text: the text's name, and the least doc_id and text of its class, which stand for it.

    Texts without words (null, empty, white space) link with nothing; equal texts are one node, whatever their ids;
    texts that share a doc_id are apart unless they are similar; null ids and their rows are left out; other columns
    are ignored; an empty table gives no rows. Classes of unrelated texts may have the same class_id where a doc_id
    repeats; (class_id, c1, c2) tells them apart.

    Nodes are numbers given to the 128-bit names. Nodes that share a band key are candidates. A large bucket is not
    expanded into pairs: its members are compared
    with one hub, the components found so far are taken together, and another hub follows for what stays apart. Members
    of different components that still share a bucket are then looked up by their rarest shareable shingles, and what
    can share enough is compared pair by pair, so that no link is lost.
    """
    found = sketches(docs)
    copies = found.where("some").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands"))
    copies = written(copies.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = copies.select("node", F.explode("bands").alias("k"))
    shared = keys.groupBy("k").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("k", "least")
    members = written(keys.join(shared, "k"), "buckets")
    tried = written(members.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = _verified(tried, copies, docs)
    bounds = units = useful = None
    for star in range(STARS + 1):
        known = components(links)
        named = members.join(known.withColumnRenamed("component", "c"), "node", "left").select("k", "node", F.coalesce("c", "node").alias("c"))
        if bounds is not None:
            named = named.join(bounds, "node")
        apart = named.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("k")
        named = written(named.join(apart, "k"), "apart")
        if named.isEmpty():
            break
        if bounds is None:
            bounds, units, useful = _bounds(named, copies, docs)
            named = written(named.join(bounds, "node"), "apart")
        major = named.groupBy("k", "c").agg(F.count(F.lit(1)).alias("size")).groupBy("k").agg(F.max(F.struct("size", "c")).alias("m")).select("k", F.col("m.c").alias("major"))
        split = named.join(major, "k")
        few = split.where("c <> major").select("k", "major", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("useful").alias("ux"))
        if star < STARS:
            hub = F.min(F.struct("n", F.xxhash64("node").alias("h"), "node"))
            pairs = few.join(split.where("c = major").groupBy("k").agg(hub.alias("s")).select("k", F.col("s.node").alias("y")), "k").select("x", "y")
        else:
            every = named.select(F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("useful").alias("uy")).distinct()
            pairs = _probed(written(few.drop("k", "major").distinct(), "few"), written(every, "every"), units, useful)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        links = links.union(_verified(pairs, copies, docs))
        tried = tried.union(pairs)
    known = components(links)
    least = F.min(F.struct("doc_id", "h1", "h2"))
    stands = known.join(copies, "node").groupBy("component").agg(least.alias("least"))
    own = F.struct("doc_id", "h1", "h2")
    linked = known.join(stands, "component").select("node", "least")
    names = copies.join(linked, "node", "left").select("h1", "h2", F.coalesce("least", own).alias("least"))
    rows = found.select("doc_id", "h1", "h2").distinct().join(names, ["h1", "h2"], "left").withColumn("least", F.coalesce("least", own))
    return rows.select("doc_id", "h1", "h2", F.col("least.doc_id").alias("class_id"), F.col("least.h1").alias("c1"), F.col("least.h2").alias("c2"))


#: Whether a row of text_classes stands for its class.
STANDS = "doc_id = class_id AND h1 = c1 AND h2 = c2"


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every distinct doc_id and text, as in text_classes: class_id is the smallest doc_id that links of similarity >= 0.8 lead to."""
    return text_classes(docs).select("doc_id", "class_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept (the one document of its class that stays) of every distinct doc_id and text."""
    return text_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.expr(STANDS).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents but for all but one of each class, with their columns; rows with a null id stay; of rows that repeat an id and its text one stays."""
    names = ["doc_id", "h1", "h2"]
    rows = _hashed(wrapped(docs))
    drop = written(text_classes(rows.select("doc_id", "text")).where(f"NOT ({STANDS})").select(*names), "gone")
    left = rows.join(sized_broadcast(drop), names, "left_anti")
    again = rows.where("doc_id is not null").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        left = left.where("doc_id is not null").dropDuplicates(names).unionByName(left.where("doc_id is null"))
    return unwrapped(left)
