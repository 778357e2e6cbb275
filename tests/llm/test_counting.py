"""Codes of vectors, periodic runs and token counts against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import op11_codes, op12_periods, op13_tokens

RNG = random.Random(5)
DOC = "doc_id long, text string, n_runs string, start string, code string, crc string"
VEC = "vec_id long, embedding array<float>, label int, error string, _label string, v string"


def doc_rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in texts], DOC)


# 11


def brute_codes(rows, rounds=6, parts=8, entries=16):
    """rows: (vec_id, label, components); the contract word by word, in Python's whole numbers."""
    kept = [(i, lab, [int(np.floor(float(x) * 4096)) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v: [tuple(v[j * width : (j + 1) * width]) for j in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(r[2])[j] for r in first] for j in range(parts)]
    near = lambda b, p: min((sum((x - y) ** 2 for x, y in zip(e, p, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(books[j], cut(r[2])[j])[1], []).append(cut(r[2])[j])
            books[j] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[j])]
    out = []
    for i, lab, v in kept:
        best = [near(b, p) for b, p in zip(books, cut(v), strict=True)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, err, sum(o[3] for o in out if o[1] == lab), name) for i, lab, code, err in out]


def vector_rows():
    base = [[RNG.choice((-1, 1)) * RNG.random() / 3 for _ in range(16)] for _ in range(25)]
    rows = [(k, [float(np.float32(x + RNG.gauss(0, 0.02))) for x in RNG.choice(base)], RNG.choice([0, 1, 1, None])) for k in range(150)]
    rows += [(7, rows[7][1], 1), (7, rows[9][1], 1), (None, rows[3][1], 0), (151, None, 1), (152, [float("nan")] + [0.0] * 15, 1), (153, [None] + [0.0] * 15, 1), (154, [float("inf")] + [0.0] * 15, 0), (155, [0.0] * 16, None)]
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_codes_are_those_of_brute_force(spark, broadcast, monkeypatch):
    rows = vector_rows()
    if not broadcast:
        monkeypatch.setattr(op11_codes, "sized_broadcast", lambda df: df.select("*"))
        monkeypatch.setattr(op11_codes, "HOT", 0.3)
    out, books = op11_codes.product_codes(spark.createDataFrame([(i, v, lab, "x", "x", "x") for i, v, lab in rows], VEC))
    got = [(r.vec_id, r.code, r.error, r.label_error, hashlib.sha256(op11_codes.books_text(books).encode()).hexdigest()) for r in op11_codes.label_sums(out, "label_error").collect()]
    assert sorted(got, key=str) == sorted(brute_codes([(i, lab, v) for i, v, lab in rows]), key=str)


def test_codes_of_few_vectors_of_none_and_of_bad_ones(spark):
    few = [(3, [1.0, 2.0] * 8, 1), (1, [0.5] * 16, 1), (3, [1.0, 2.0] * 8, 1)]
    out, books = op11_codes.product_codes(spark.createDataFrame([(i, v, lab, "x", "x", "x") for i, v, lab in few], VEC))
    assert sorted((r.vec_id, r.code, r.error) for r in out.collect()) == [(1, "00" * 8, 0), (3, "01" * 8, 0), (3, "01" * 8, 0)] and len(books[0]) == 3
    none, books = op11_codes.product_codes(spark.createDataFrame([(1, None, 1, "x", "x", "x")], VEC))
    assert none.count() == 0 and books == [] and op11_codes.label_sums(none, "label_error").count() == 0
    for bad in ([(1, [0.0] * 16, 1), (2, [0.0] * 8, 1)], [(1, [0.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            op11_codes.product_codes(spark.createDataFrame([(i, v, lab, "x", "x", "x") for i, v, lab in bad], VEC))


def test_nearest_entry_of_the_tree_is_the_first_of_equals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 16, 40):
        book, points = rng.integers(-3, 4, (n, 3)), rng.integers(-4, 5, (400, 3))
        far = ((points[:, None] - book[None]) ** 2).sum(2)
        at, best = op11_codes.nearest(book, op11_codes.kd_tree(book), points)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()


def test_codes_query_and_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(op11_codes.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, op11_codes.op11_codes(spark, "/root/testdata/sf0.001").select(*names).collect())) == sorted(want.fetchall())


# 12


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_periods(doc_id, text, plant=True):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = planted(doc_id, words) if plant and doc_id is not None else words
    runs = brute_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    names = ["".join(f"{a},{n},{q}\n" for a, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)]
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], *[hashlib.sha256(x.encode()).hexdigest() for x in names])


def run_texts():
    out = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a b " * 2000, "a b c d e f g h i " * 3, "a b c d e f g h " * 3, "é日 " * 40, "x" * 3000 + " x" * 30]
    for _ in range(250):
        letters = RNG.choice(["ab", "abc", "abcdefgh"])
        words = [RNG.choice(letters) for _ in range(RNG.randrange(120))]
        for _ in range(RNG.randrange(3)):
            at, base = RNG.randrange(len(words) + 1), [RNG.choice(letters) for _ in range(RNG.randrange(1, 12))]
            words[at:at] = (base * 30)[: RNG.randrange(5, 90)]
        out.append(RNG.choice([" ", "\n", " \t "]).join(words))
    return out


def test_runs_are_those_of_brute_force(spark):
    rows = list(enumerate(run_texts())) + [(None, "p q " * 30), (5, "p q " * 30), (5, "p q " * 30)]
    got = [tuple(r) for r in op12_periods.periodic_runs(doc_rows(spark, rows), planted=True).collect()]
    assert sorted(got, key=str) == sorted((brute_periods(*r) for r in rows), key=str)
    got = [tuple(r) for r in op12_periods.periodic_runs(doc_rows(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((brute_periods(*r, plant=False) for r in rows), key=str)
    assert op12_periods.periodic_runs(doc_rows(spark, [])).count() == 0


def test_runs_of_a_very_long_text_and_of_small_pair_blocks(spark, monkeypatch):
    words = [RNG.choice("abcdefghijklmnop") for _ in range(300_000)]
    words[1000:1000] = words[500:520] * 50
    base = words[:90_000]
    text = " ".join([*words, *base, *base, *base])
    row = op12_periods.periodic_runs(doc_rows(spark, [(None, text)])).first()
    assert row.n_runs == 5 and (row.start, row.period) == (1000, 20) and row.length >= 1000  # the run, its three copies, and the stretch that those make
    monkeypatch.setattr(op12_periods, "PAIRS", 7)
    for text in run_texts()[3:40]:
        words = text.split()
        ids = np.unique(words, return_inverse=True)[1].astype(np.uint64) + np.uint64(1) if words else np.empty(0, np.uint64)
        runs = op12_periods.grid_runs(ids * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(ids)]))
        assert list(zip(runs.start.tolist(), (runs.stop - runs.start).tolist(), runs.period.tolist(), strict=True)) == brute_runs(words)


def test_equal_hashes_of_different_words_are_noticed(monkeypatch):
    import pyarrow as pa

    texts = ["a b " * 20 + "c d " * 20, "a a a " * 9]
    whole = op12_periods.word_hashes
    monkeypatch.setattr(op12_periods, "word_hashes", lambda *a: (np.ones_like(whole(*a)[0]), *whole(*a)[1:]))
    for text, row in zip(texts, op12_periods._portion(pa.array(texts), [None, None]), strict=True):
        assert (None, *row) == brute_periods(None, text)


# 13


def test_tokens_are_those_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    some = "abc  \n\t'stre<|endoftext|>éß日本1२\x85\x1c😀՘\U00032800.."
    texts = ["".join(RNG.choice(some) for _ in range(RNG.randrange(60))) + RNG.choice(["", "<|endoftext|>", " "]) for _ in range(1500)]
    texts += [None, "", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a" * 60_000, "ab" * 30_000, " " * 50_000, "日" * 20_000, "it's we'll 'S 12 . " * 90_000]
    rows = [*enumerate(texts), (None, "x y"), (3, texts[3])]
    got = sorted((tuple(r) for r in op13_tokens.token_counts(doc_rows(spark, rows)).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 512) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert got == sorted(want, key=str)
    assert op13_tokens.token_counts(doc_rows(spark, [])).count() == 0


def test_pieces_end_where_the_library_ends_them():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library, count = tokenizers.Tokenizer.from_file(path), op13_tokens.counter(op13_tokens.vocabulary(path))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 50_000):
        text = "".join(f"a{c}1{c}.{c} b" for c in every[at : at + 50_000 : 3])
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_merges_of_low_rank_go_first():
    # ids 0..2 are a, b, c; ranks: bc -> 3, ab -> 4, abc -> 5, aa -> 6
    pairs, made = [{1: 1, 3: 2, 0: 3}, {2: 0}, {}, {}, {}, {}, {}], [3, 4, 5, 6]
    count = lambda text: op13_tokens.merged_count(["abc".index(c) for c in text], pairs, made)
    assert [count(t) for t in ("", "a", "ab", "abc", "abcabc", "aaa", "aaaa", "cba")] == [0, 1, 1, 1, 2, 2, 2, 3]


def test_new_queries_read_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    periods = op12_periods.op12_periods(spark, "/root/testdata/sf0.001").collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(map(tuple, periods), key=str) == sorted((brute_periods(r.doc_id, rows[r.doc_id]) for r in periods), key=str) and len(periods) == docs.count()
    tokens = op13_tokens.op13_token_counts(spark, "/root/testdata/sf0.001")
    assert tokens.count() == docs.count() == tokens.where((F.col("n_tokens") > 512) == F.col("over_limit")).count()
