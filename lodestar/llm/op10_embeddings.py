"""Embedding near-dedup: dual traversal of cover trees, exact threshold pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import sized_broadcast, table, written
from lodestar.llm.graph import components

#: Cosine from which two vectors link; rows of a block, about the size of a leaf; the most leaves of a tree.
COSINE, BLOCK, LEAVES = 0.93, 768, 2048
_GROUP = ["label", "dim"]


def _again(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a second use in one cogroup."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as rows of length 1, in double precision."""
    m = np.stack([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 1))
    if not len(m):
        return m
    m = m / np.abs(m).max(1, keepdims=True)  # else squares of very large or small components leave the range of doubles
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, level, parent) of the nodes of a cover tree over unit vectors; the nodes of the last level are its leaves.

    Levels are nested: every centre of a level is, with itself as parent, one of the next. The radius of level i is
    2 / 2 ** i: centres of a level are farther than that from each other, and all points lie within it of one.
    """
    chosen, level, parent = [0], [0], [-1]
    current = [(0, 0)]  # (node, point) of the last level
    radius, depth = 2.0, 0
    while len(current) < len(points) and depth < 24:
        radius, depth = radius / 2, depth + 1
        centres = [p for _, p in current]
        near = np.sqrt(np.maximum(2 - 2 * points @ points[centres].T, 0))
        best, owner = near.min(1), near.argmin(1)
        following = []
        for node, p in current:
            chosen.append(p), level.append(depth), parent.append(node)
            following.append((len(chosen) - 1, p))
        while True:
            far = int(best.argmax())
            if best[far] <= radius:
                break
            chosen.append(far), level.append(depth), parent.append(current[owner[far]][0])
            following.append((len(chosen) - 1, far))
            best = np.minimum(best, np.sqrt(np.maximum(2 - 2 * points @ points[far], 0)))
        current = following
    return np.array(chosen), np.array(level), np.array(parent)


def dual_pairs(centres: np.ndarray, level: np.ndarray, parent: np.ndarray, leaf_radius: np.ndarray, reach: float) -> list[tuple[int, int, bool]]:
    """(u, v, sure) of leaves u <= v that may hold points within `reach` of each other, sure if all their points are; leaf_radius is negative for empty leaves.

    A node's covering radius bounds the distance of all points below it. A pair of nodes is dropped if its centres are
    farther apart than both radii and the reach; else the node of the larger radius is replaced by its children. Points of
    two leaves whose centres are no farther apart than the reach less both radii need not be compared.
    """
    n, last = len(level), level.max()
    radius = np.where(level == last, leaf_radius, -1.0)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        children[p].append(i)
    for i in sorted(range(n), key=lambda i: -level[i]):
        for c in children[i]:
            if radius[c] >= 0:
                radius[i] = max(radius[i], radius[c] + np.linalg.norm(centres[i] - centres[c]))
    out, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        if radius[a] < 0 or radius[b] < 0 or np.linalg.norm(centres[a] - centres[b]) > radius[a] + radius[b] + reach + 1e-9:
            continue
        if not children[a] and not children[b]:
            out.append((min(a, b), max(a, b), bool(np.linalg.norm(centres[a] - centres[b]) + radius[a] + radius[b] <= reach - 1e-6)))
        elif a == b:
            todo += [(x, y) for i, x in enumerate(children[a]) for y in children[a][i:]]
        elif not children[b] or (children[a] and radius[a] >= radius[b]):
            todo += [(x, b) for x in children[a]]
        else:
            todo += [(a, y) for y in children[b]]
    return sorted(set(out))


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node").head(LEAVES)
    points = _matrix(pdf["e"])
    chosen, level, parent = cover_tree(points)
    return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "id": np.arange(len(chosen)), "level": level, "parent": parent, "centre": list(points[chosen])})


def _assign(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
    """Each row's nearest leaf and its distance from the leaf's centre."""
    leaves = tree[tree["level"] == tree["level"].max()].sort_values("id")
    near = _matrix(rows["e"]) @ np.stack(leaves["centre"].to_numpy()).T
    at = near.argmax(1)
    out = rows[["label", "dim", "node", "mult", "e"]].copy()
    out["leaf"] = leaves["id"].to_numpy()[at]
    out["far"] = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(at)), at], 0))
    return out


def _traverse(reach: float):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id")
        pairs = dual_pairs(np.stack(nodes["centre"].to_numpy()), nodes["level"].to_numpy(), nodes["parent"].to_numpy(), nodes["radius"].to_numpy(), reach)
        u, v, sure = zip(*pairs, strict=True) if pairs else ((), (), ())
        return pd.DataFrame({"label": nodes["label"].iloc[0], "dim": nodes["dim"].iloc[0], "u": np.array(u, np.int64), "v": np.array(v, np.int64), "sure": np.array(sure, bool)})

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Numbers of the links that join something new."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(i)
    return kept


def _compare(cosine: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Two blocks: how many vectors each one links to, and links enough to connect what is connected."""
        own = not len(right)  # a block with itself
        other = left if own else right
        if not len(left):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        close = _matrix(left["e"]) @ _matrix(other["e"]).T >= cosine
        if own:
            np.fill_diagonal(close, False)
        ids, ids2 = left["node"].to_numpy(), other["node"].to_numpy()
        out = [pd.DataFrame({"a": ids, "b": 0, "n": close @ other["mult"].to_numpy()})]
        if not own:
            out.append(pd.DataFrame({"a": ids2, "b": 0, "n": close.T @ left["mult"].to_numpy()}))
        x, y = np.nonzero(np.triu(close) if own else close)
        kept = _forest(x, y + (0 if own else len(ids)), len(ids) + (0 if own else len(ids2)))
        out.append(pd.DataFrame({"a": ids[x[kept]], "b": ids2[y[kept]], "n": -1}))  # a link, not a count
        both = pd.concat(out)
        return both[both["n"] != 0].astype("int64")

    return run


def near(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link only within a label. Null labels, ids, vectors or components, zero vectors, infinities and NaN link with
    nothing; so do vectors of different length. Equal vectors are compared once and counted as often as they occur; an
    empty table gives no rows; other columns are ignored. Rows of one vec_id are vectors of
    their own, each with the other rows it links to.

    Each label's cover tree is grown from a bounded hash sample; all vectors go to their nearest leaf, whose covering
    radius is the largest distance found. The dual traversal yields leaf pairs, leaves are cut into blocks, and each
    pair of blocks is one small task, whatever the size of the label.
    """
    usable = F.col("e").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("e", lambda x: x != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("e"))
    equal = ["label", "e"]
    # a node is a distinct vector of a label, whatever ids it has; written, its number is fixed
    nodes = base.where(usable).groupBy(*equal).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"))
    nodes = written(nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("e")}), "vectors")
    kind, vector = nodes.schema["label"].dataType.simpleString(), nodes.schema["e"].dataType.simpleString()
    per = nodes.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("first"))
    per = written(per.withColumn("leaves", F.least(F.ceil(F.col("rows") / BLOCK), F.lit(LEAVES))).withColumn("parts", F.ceil(F.col("rows") / BLOCK)), "labels")
    rows = nodes.join(sized_broadcast(per), _GROUP)
    sample = rows.where((F.pmod(F.xxhash64("node"), F.col("rows")) < F.col("leaves")) | (F.col("node") == F.col("first")))
    trees = written(sample.select("label", "dim", "node", "e").groupBy(*_GROUP).applyInPandas(_grow, f"label {kind}, dim int, id long, level long, parent long, centre array<double>"), "trees")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.col("parts")))
    spread = trees.join(sized_broadcast(_again(per.select(*_GROUP, "parts"))), _GROUP).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    keys = [*_GROUP, "salt"]
    placed = written(salted.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_assign, f"label {kind}, dim int, node long, mult long, e {vector}, leaf long, far double"), "leaves")
    leaves = placed.groupBy(*_GROUP, "leaf").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"), F.sum("mult").alias("held"), F.min("node").alias("least")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long"))
    leaves = written(leaves.select(*_GROUP, "leaf", "blocks", "radius", "held", "least"), "radii")
    whole = trees.join(leaves.select(*_GROUP, F.col("leaf").alias("id"), "radius"), [*_GROUP, "id"], "left").withColumn("radius", F.coalesce("radius", F.lit(-1.0)))
    pairs = whole.groupBy(*_GROUP).applyInPandas(_traverse(float(np.sqrt(2 - 2 * cosine))), f"label {kind}, dim int, u long, v long, sure boolean")
    pairs = written(pairs, "pairs")
    # leaves that link as a whole: every vector links to all of the other leaf, and to the other ones of its own
    sure = pairs.where("sure")
    ways = sure.select(*_GROUP, F.col("u").alias("leaf"), F.col("v").alias("to")).union(sure.where("u < v").select(*_GROUP, F.col("v"), F.col("u")))
    ends = leaves.select(*_GROUP, F.col("leaf").alias("to"), "held", F.col("least").alias("other"))
    ways = written(ways.join(ends, [*_GROUP, "to"]).groupBy(*_GROUP, "leaf").agg(F.sum("held").alias("held"), F.min("other").alias("other"), F.max(F.col("to") == F.col("leaf")).alias("own")), "whole")
    met_all = placed.select(*_GROUP, "leaf", "node", "mult").join(sized_broadcast(ways), [*_GROUP, "leaf"])
    met_all = written(met_all.select("node", F.when(F.col("own"), F.col("held") - F.col("mult")).otherwise(F.col("held")).alias("n"), "other"), "met")
    pairs = pairs.where("not sure").drop("sure")
    of = lambda leaf, n: leaves.select(*_GROUP, F.col("leaf").alias(leaf), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1).alias(n))
    pairs = pairs.join(of("u", "bus"), [*_GROUP, "u"]).join(of("v", "bvs"), [*_GROUP, "v"])
    pairs = pairs.withColumn("bu", F.explode("bus")).withColumn("bv", F.explode("bvs")).where("u < v or bu <= bv").select(*_GROUP, "u", "bu", "v", "bv")
    pairs = written(pairs, "blocks")
    cut = placed.join(sized_broadcast(leaves.select(*_GROUP, "leaf", "blocks")), [*_GROUP, "leaf"]).withColumn("block", F.pmod(F.xxhash64(F.lit(2), F.col("node")), F.col("blocks")))
    cut = cut.select(*_GROUP, "leaf", "block", "node", "mult", "e")
    keys = [*_GROUP, "u", "bu", "v", "bv"]
    left = pairs.join(cut.withColumnsRenamed({"leaf": "u", "block": "bu"}), [*_GROUP, "u", "bu"])
    right = _again(pairs).where("u < v or bu < bv").join(_again(cut).withColumnsRenamed({"leaf": "v", "block": "bv"}), [*_GROUP, "v", "bv"])
    met = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(cosine), "a long, b long, n long"), "met")
    counts = met.where("n > 0").select("a", "n").union(met_all.where("n > 0").select("node", "n")).groupBy("a").agg(F.sum("n").alias("others")).select(F.col("a").alias("node"), "others")
    # a leaf that links as a whole to other leaves hangs on the least vector of one of them, all of which it links to
    firsts = sure.join(leaves.select(*_GROUP, F.col("leaf").alias("u"), F.col("least").alias("a")), [*_GROUP, "u"]).join(leaves.select(*_GROUP, F.col("leaf").alias("v"), F.col("least").alias("b")), [*_GROUP, "v"])
    joined = met.where("n < 0").select("a", "b").union(met_all.where("n > 0").select("node", "other")).union(firsts.select("a", "b"))
    known = components(joined).select("node", "component").join(nodes.select("node", "id"), "node")
    known = written(known, "components")
    least = known.groupBy("component").agg(F.min("id").alias("c"))
    result = nodes.join(counts, "node", "left").join(known.join(least, "component").select("node", "c"), "node", "left")
    result = result.select(*[F.col(c).alias(f"_{c}") for c in equal], (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("c", "id").alias("c"))
    every = base.withColumn("_ok", usable).join(result, (F.col("label") == F.col("_label")) & (F.col("e") == F.col("_e")) & F.col("_ok"), "left")
    component = F.coalesce("c", "vec_id")
    return every.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.n)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT n, min(c) AS c FROM reach GROUP BY n) r ON r.n = e.vec_id
"""
