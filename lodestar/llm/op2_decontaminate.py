"""Benchmark decontamination through a positional inverted index (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import sized_broadcast, table, unwrapped, wrapped, written

#: What stands between words after lower-casing A-Z: all ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rarest terms of a window whose posting lists are intersected, one after the other, before the exact check.
PROBES = 3
#: Documents without an id come last.
LAST_ID = (1 << 63) - 1
_DOC = ["id", "th"]


def tokens(text: Column) -> Column:
    """Words of a text column; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN), "")


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the benchmark: phrase, n (its words), words, items (ids of the items that hold it, as strings), pid (a hash)."""
    base = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = base.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    return cut.groupBy(F.array_join("words", " ").alias("phrase")).agg(
        F.first("words").alias("words"), F.max(F.size("words")).alias("n"), F.array_sort(F.collect_set("item")).alias("items")
    ).withColumn("pid", F.xxhash64("phrase"))


def _identified(docs: DataFrame) -> DataFrame:
    """docs with (id, th): a document is named by its id, last if null, and its text's hash, so that repeated ids with different texts stay apart."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "th": F.xxhash64(F.coalesce("text", F.lit("")))})


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of `terms` occurs in all documents."""
    words = docs.select(F.explode(tokens(F.col("text"))).alias("term"))
    return words.join(sized_broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of `terms` over docs (id, th, text): (term, id, th, pos), written to the shared folder."""
    words = docs.select("id", "th", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    return written(words.join(sized_broadcast(terms), "term").select("term", "id", "th", "pos"), "postings", sort=["term"])


def plan_probes(docs: DataFrame, found: DataFrame, probes: int = PROBES) -> DataFrame:
    """(pid, term, off, rank, n), written: the rarest terms of every phrase whose terms all occur in the documents, the rarest of rank 1."""
    spread = found.select("pid", "n", F.posexplode("words").alias("off", "term"))
    counts = term_counts(docs, spread.select("term").distinct())
    rated = spread.join(counts.withColumnRenamed("n", "freq"), "term")
    whole = W.partitionBy("pid", "n")
    plan = (
        rated.withColumn("there", F.count(F.lit(1)).over(whole))
        .where("there >= n")  # a term that occurs nowhere rules the phrase out
        .withColumn("rank", F.row_number().over(whole.orderBy("freq", "term", "off")))
        .where(F.col("rank") <= probes)
    )
    return written(plan.select("pid", "term", "off", "rank", "n"), "probes")


def _candidates(docs: DataFrame, found: DataFrame, *, exact: bool) -> DataFrame:
    """(id, th, pid, n, start), written: starts where the posting lists of the probes meet after offset adjustment; if not exact, the places of each phrase's rarest term.

    The list of the rarest term gives the first starts; each further list is only asked for the places that are left.
    """
    plan = plan_probes(docs, found, PROBES if exact else 1)
    index = postings(docs, plan.select("term").distinct())
    met = index.join(sized_broadcast(plan.where("rank = 1").drop("rank")), "term")
    if not exact:
        return written(met.select(*_DOC, "pid", "n", F.col("pos").alias("start")), "starts")
    met = written(met.select(*_DOC, "pid", "n", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0"), "starts")
    for k in range(2, PROBES + 1):
        probe = sized_broadcast(plan.where(F.col("rank") == k).select("pid", "term", "off"))
        asked = met.join(probe, "pid").withColumn("pos", F.col("start") + F.col("off"))
        left = asked.join(index, [*_DOC, "term", "pos"], "left_semi").select(*met.columns)
        met = written(left.union(met.where(F.col("n") < k)), "starts")  # shorter windows have no such term
    return met


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, start, n, items), written: exact occurrences of benchmark windows in the distinct documents, n words from start on.

    Null text has no words; an empty benchmark hits nothing; columns besides doc_id and text are ignored.
    """
    docs, found = _identified(docs.select("doc_id", "text")), written(phrases(benchmark, window), "phrases")
    starts = _candidates(docs, found, exact=True).groupBy(*_DOC).agg(F.collect_set(F.struct("start", "n")).alias("c"))
    some = docs.select(*_DOC, "text").join(sized_broadcast(written(starts, "lists")), _DOC).select(*_DOC, tokens(F.col("text")).alias("w"), "c")
    read = some.groupBy(*_DOC).agg(F.first("w").alias("w"), F.first("c").alias("c")).select(*_DOC, "w", F.explode("c").alias("c"))  # words before starts: else each start splits the text again
    said = read.select(*_DOC, "c.start", "c.n", F.array_join(F.slice("w", F.col("c.start") + 1, F.col("c.n")), " ").alias("phrase"))
    return written(said.join(sized_broadcast(found.select("phrase", F.col("n").alias("size"), "items")), "phrase").where("n = size").select(*_DOC, "start", "n", "items"), "hits")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 5) -> DataFrame:
    """(doc_id, phrase, start): all distinct words of the window occur, in any order, within the n + 2 * slack words from start.

    Each occurrence of the window's rarest term gives the first such stretch that contains it.
    """
    docs, found = _identified(docs.select("doc_id", "text")), written(phrases(benchmark, window), "phrases")
    full = _candidates(docs, found, exact=False).drop("n").join(sized_broadcast(found.drop("words", "items")), "pid")
    per = full.groupBy(*_DOC).agg(F.collect_list(F.struct("start", "n", "phrase")).alias("_c"))
    both = docs.join(sized_broadcast(written(per, "lists")), _DOC).select("doc_id", tokens(F.col("text")).alias("_w"), "_c")
    size = lambda c: c["n"] + 2 * slack
    first = lambda c: F.greatest(c["start"] - size(c) + 1, F.lit(0))
    whole = lambda c, start, length: F.size(F.array_except(F.split(c["phrase"], " "), F.slice("_w", start + 1, length))) == 0
    starts = lambda c: F.filter(F.sequence(first(c), c["start"]), lambda i: whole(c, i, size(c)))
    near = F.filter("_c", lambda c: whole(c, first(c), 2 * size(c) - 1))  # before any stretch is tested: all stretches together
    hits = both.select("doc_id", F.explode(F.transform(near, lambda c: F.struct(c["phrase"].alias("phrase"), F.get(starts(c), F.lit(0)).alias("start")))).alias("h"))
    return hits.select("doc_id", "h.phrase", "h.start").where("start is not null").distinct()


def digest(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, by hits of phrase_matches().

    Documents without hits have zeros; repeated documents each get their own row; a null doc_id stays null.
    """
    places = hits.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select(*_DOC, F.explode("items").alias("item")).distinct().groupBy(*_DOC).agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = written(places.join(items, _DOC).select(*_DOC, "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "digests")
    base = _identified(docs.select("doc_id", "text")).select("doc_id", *_DOC, F.size(tokens(F.col("text"))).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return base.join(sized_broadcast(per), _DOC, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents no benchmark window occurs in, with all their columns.

    A row goes if its (doc_id, text) has a hit; nulls and repeated rows as in digest().
    """
    hit = written(phrase_matches(docs, benchmark, window).select(*_DOC).distinct(), "contaminated")
    return unwrapped(_identified(wrapped(docs)).join(sized_broadcast(hit), _DOC, "left_anti"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = table(spark, sf_dir, "documents")
    return digest(docs, phrase_matches(docs, table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM pos) p
        JOIN win ON win.n = p.n AND win.phrase = p.phrase),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON words.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""
