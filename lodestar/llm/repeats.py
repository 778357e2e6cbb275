"""Repeated windows of bytes or words: content-defined samples, candidates, exact spans and removal.

A window is `size` consecutive symbols of one text. The `gram` symbols of least hash in it are its sample; neighbouring
windows with the same sample form a run. Equal windows have equal samples, so a window can only repeat if its sample
does: about 2 / (size - gram + 2) of the positions are sampled, sorted and compared instead of all.
Candidates are then judged by blake2b digests of the very bytes or words that they cover: first whole runs, cut in
halves, then window by window where runs differ. The fast hashes of words.py only choose what is compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, flat_bytes, packets, sized_broadcast, written
from lodestar.llm.words import Prefix, bytes_symbols, word_hashes

#: Documents without an id come last.
LAST_ID = (1 << 63) - 1
#: A text of more than twice as many bytes is worked on in pieces of this size, so that memory doesn't grow with it.
PIECE = 1 << 20
#: Rows that a task gathers before it combines equal ones.
GATHER = 1 << 18
#: Rows that a task holds before it hands on what it can.
HELD = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK, _WORD = re.compile(rb"[ \t-\r]"), re.compile(rb"[^ \t-\r]+")


@dataclass(frozen=True)
class Windows:
    size: int
    gram: int
    words: bool


class Portion:
    """Whole texts or one piece of a text: symbols in flat positions, first[i] where those of the i-th start, row[i] its
    number in the batch and base[i] the number of its first symbol in its text."""

    def __init__(self, windows: Windows, raw: np.ndarray, offsets: np.ndarray, row: np.ndarray, base: np.ndarray):
        self.windows, self.row, self.base = windows, row, base
        if windows.words:
            self.sym, start, stop, text = word_hashes(raw, offsets)
            self.first = np.searchsorted(text, np.arange(len(offsets)))
            size = stop - start
            self._stop = np.cumsum(size + 1) - 1  # words joined by one space
            self._start = self._stop - size
            joined = np.full(int(self._stop[-1]) if len(size) else 0, 32, np.uint8)
            number = np.repeat(np.arange(len(size)), size)
            within = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
            joined[self._start[number] + within] = raw[start[number] + within]
            self.text = joined.tobytes()
        else:
            self.sym, self.first = bytes_symbols(raw), offsets
            self.text = raw.tobytes()

    def digests(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of what the symbols start..stop-1 spell."""
        if self.windows.words:
            start, stop = self._start[start], self._stop[stop - 1]
        text, digest = self.text, hashlib.blake2b
        names = [digest(text[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def runs(self) -> Runs:
        """Runs of windows with the same sample, in flat positions."""
        w, sym, first, n = self.windows, self.sym, self.first, len(self.sym)
        grams, none = Prefix(sym, 1), np.empty(0, np.int64)
        if n < w.size:
            return Runs(self, grams, none, none, none, none)
        at = np.arange(n - w.gram + 1)
        low32 = np.uint64((1 << 32) - 1)
        least = (grams.of(at, at + w.gram) & ~low32) | at.astype(np.uint64)  # of equal grams the first
        width, have = w.size - w.gram + 1, 1
        while have < width:  # least over `have` positions from each on
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + w.size <= first[of + 1])
        sample = (least[start] & low32).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (sample[1:] != sample[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else none
        end = np.concatenate([new[1:], [len(start)]]) - 1 if len(start) else none
        return Runs(self, grams, start[new], start[end], sample[new], of[start[new]])

    def flat(self, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, flat position, flat position of the text's last window) of the windows of this portion among (row in the
        batch, number of the first symbol). The symbols at a piece's end with which no whole window starts are the next one's."""
        text = np.minimum(np.searchsorted(self.row, row), len(self.row) - 1)
        at, last = place - self.base[text], self.first[text + 1] - self.first[text] - self.windows.size
        some = np.flatnonzero((self.row[text] == row) & (at >= 0) & (at <= last))
        return some, at[some] + self.first[text[some]], last[some] + self.first[text[some]]


@dataclass
class Runs:
    portion: Portion
    grams: Prefix
    low: np.ndarray
    high: np.ndarray
    sample: np.ndarray
    text: np.ndarray

    def keys(self) -> np.ndarray:
        return self.grams.of(self.sample, self.sample + self.portion.windows.gram)

    def place(self) -> np.ndarray:
        """Number of the run's first window in its text."""
        return self.portion.base[self.text] + self.low - self.portion.first[self.text]

    def halves(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, d1, d2, text, low, high) of the chosen runs, cut where the sample passes the middle of the window.

        All windows of a half share more than half their symbols around the sample, whose hash is the half's key.
        (d1, d2) names all that the half's windows cover.
        """
        p, w = self.portion, self.portion.windows
        mid, out = (w.size - w.gram) // 2, []
        for right in (True, False):
            low = np.maximum(self.low[chosen], self.sample[chosen] - mid) if right else self.low[chosen]
            high = self.high[chosen] if right else np.minimum(self.high[chosen], self.sample[chosen] - mid - 1)
            some = low <= high
            low, high, s, text = low[some], high[some], self.sample[chosen][some], self.text[chosen][some]
            key = self.grams.of(s, s + w.size - mid) if right else self.grams.of(s - mid - 1, s + w.gram)
            move = p.base[text] - p.first[text]
            out.append(((key ^ np.uint64(0x55 if right else 0)).view(np.int64), *p.digests(low, high + w.size), text, low + move, high + move))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(text: bytes, w: Windows) -> Iterator[tuple[int, bytes]]:
    """(number of the first symbol, bytes) of pieces of a long text; each window starts and lies in one of them."""
    if not w.words:
        for a in range(0, max(len(text) - w.size + 1, 1), PIECE):
            yield a, text[a : a + PIECE + w.size - 1]
        return
    a = base = 0
    while a < len(text):
        cut = _BREAK.search(text, a + PIECE)
        b = end = cut.start() if cut else len(text)
        for _, m in zip(range(w.size - 1), _WORD.finditer(text, b), strict=False):
            end = m.end()
        yield base, text[a:end]
        base += len(text[a:b].split())
        a = b


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of one piece after the other."""
    a = 0
    while a < len(text):
        cut = _BREAK.search(text, a + PIECE)
        b = cut.start() if cut else len(text)
        yield text[a:b].split()
        a = b


def portions(column: pa.Array, w: Windows) -> Iterator[Portion]:
    """The texts of an Arrow column, many short ones or a piece of a long one at a time."""
    for a, b in packets(pa.RecordBatch.from_arrays([column], ["text"]), "text", min(1 << 18, PIECE)):
        raw, offsets = flat_bytes(column.slice(a, b - a))
        if b > a + 1 or len(raw) <= 2 * PIECE:
            yield Portion(w, raw, offsets, np.arange(a, b), np.zeros(b - a, np.int64))
        else:
            for base, part in _pieces(raw.tobytes(), w):
                yield Portion(w, np.frombuffer(part, np.uint8), np.array([0, len(part)]), np.array([a]), np.array([base]))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, id, rk, th, text): a document's id as it is and as the largest number if null, what names the row in lists (see once()),
    its text's hash and its text, empty if null."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.select("doc_id", "id", F.col("id").alias("rk"), "th", "text")


def copies(texts: DataFrame, *, earlier: bool) -> DataFrame:
    """(id, th, gone, again, rows) of texts that occur more than once, written: gone if all windows of the row count as repeated,
    again if the row need not be looked at since the text's first row stands for it; rows of an id that have the text. Texts go by their SHA-256."""
    marked = texts.select("id", "th", F.unhex(F.sha2("text", 256)).alias("sha"))
    sets = marked.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = F.col("id") > F.col("least")
    each = marked.join(sets, "sha").select("id", "th", (later if earlier else F.lit(True)).alias("gone"), later.alias("again"))
    return written(each.groupBy("id", "th", "gone", "again").agg(F.count(F.lit(1)).alias("rows")), "copies")


def once(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, th, rk, text): texts without the rows that known, of copies(), marks as again; of several rows of one id and text one stays.

    rk names the row in lists of places: its id, or a hash of id and text where an id, such as null, has several texts, so
    that no list holds the places of other texts.
    """
    left = texts.select("id", "th", "text").join(sized_broadcast(known.where("again or rows > 1").select("id", "th")), ["id", "th"], "left_anti")
    several = known.where("not again and rows > 1").select("id", "th")
    if not several.isEmpty():
        some = texts.join(sized_broadcast(several), ["id", "th"], "left_semi")
        left = left.unionByName(written(some.groupBy("id", "th").agg(F.first("text").alias("text")), "once"))
    shared = written(texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("shared")), "ids")
    left = left.join(sized_broadcast(shared), "id", "left")
    return left.select("id", "th", F.when(F.col("shared"), F.xxhash64("id", "th")).otherwise(F.col("id")).alias("rk"), "text")


def sampled(texts: DataFrame, w: Windows) -> DataFrame:
    """(key, rk, place) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rk").to_numpy()
            for p in portions(batch.column("text"), w):
                runs = p.runs()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (runs.keys().view(np.int64), ids[p.row[runs.text]], runs.place())], ["key", "rk", "place"])

    return texts.select("rk", "text").mapInArrow(run, "key long, rk long, place long")


def with_lists(texts: DataFrame, rows: DataFrame, *, by: list[str], lists: list[str], how: str) -> DataFrame:
    """texts joined with arrays of the rows of each document; how they meet is left to the planner."""
    per = rows.groupBy(*by).agg(F.collect_list(F.struct(*lists)).alias("_l"))
    return texts.join(per.select(*by, *[F.col(f"_l.{c}").alias(c) for c in lists]), by, how)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)


#: Columns of rows to be judged: key, the digest of what windows low..high of document (id, th) cover, and how many such
#: rows this one stands for, 2 for more.
_NAMES = ("key", "d1", "d2", "id", "th", "low", "high", "n")
#: Rows travel in blocks, one for each task and part of the keys; done: (id, th, low, high) that are known to repeat.
_BLOCKS = "part int, done boolean, block binary"
_RANGES = "id long, th long, low long, high long, over boolean, open boolean"


def packed(cols: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as a block, their first bytes first, which compresses better."""
    return np.ascontiguousarray(np.stack(cols).astype(np.int64, copy=False).view(np.uint8).reshape(len(cols), -1, 8).transpose(0, 2, 1)).tobytes()


def unpacked(block: pa.Scalar, n: int) -> list[np.ndarray]:
    """The n columns of a block."""
    raw = np.frombuffer(block.as_buffer(), np.uint8).reshape(n, 8, -1)
    return list(np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.int64)[:, :, 0])


def parts_for(rows: int, conf: str) -> int:
    """Parts that rows are dealt to, so that a task holds some hundred thousand of them, whatever their number."""
    return max(int(conf), -(-rows // HELD))


def _starts(cols: list[np.ndarray], by: int) -> np.ndarray:
    """Where the first `by` columns change."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols[:by]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _compared(cols: list[np.ndarray], *, earlier: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(cols in the order of key and digest, over, stays, several): rows that repeat, those that stand for their equals
    from now on, and those of a key with several digests."""
    order = np.lexsort((cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    n = len(order)
    span, key = _starts(cols, 3), _starts(cols, 1)
    size = np.diff(np.append(span, n))
    of_key = np.searchsorted(key, span, side="right") - 1
    several = np.repeat((np.bincount(of_key, minlength=len(key)) > 1)[of_key], size)
    if not n:
        return cols, several, several, several
    if earlier:
        over = cols[3] > np.repeat(np.minimum.reduceat(cols[3], span), size)
        return cols, over, ~over, several
    total = np.add.reduceat(cols[7], span)
    stays = np.zeros(n, bool)
    stays[span] = True
    cols[7] = np.minimum(np.repeat(total, size), 2)
    return cols, np.repeat(total > 1, size), stays, several


def _gathered(each: Callable, parts: int, *, earlier: bool) -> Callable:
    """A mapInArrow function that combines what each(batch) yields, some hundred thousand rows at a time, into _BLOCKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows = [], 0

        def out() -> pa.RecordBatch:
            cols, over, stays, _ = _compared([np.concatenate(c) for c in zip(*have, strict=True)], earlier=earlier)
            left = [c[stays] for c in cols]
            part = ((left[0] >> 32) + (1 << 31)) * parts >> 32  # keys are spread evenly: parts are ranges of them
            at = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(at))
            blocks = [packed([c[at[k] : at[k + 1]] for c in left]) for k in some]
            number, done = [*some.tolist()], [False] * len(some)
            if over.any():
                number.append((int(cols[3][0]) * 31 + int(cols[5][0])) % parts)
                done.append(True)
                blocks.append(packed([c[over] for c in cols[3:7]]))
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(done, pa.bool_()), pa.array(blocks, pa.binary())], ["part", "done", "block"])

        for batch in batches:
            for cols in each(batch):
                have.append(cols)
                rows += len(cols[0])
                if rows >= GATHER:
                    yield out()
                    have, rows = [], 0
        if have:
            yield out()

    return run


def _half_rows(w: Windows) -> Callable:
    def each(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        place, row = _flat(batch.column("place"))
        ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
        for p in portions(batch.column("text"), w):
            mark = np.zeros(len(p.sym) + 1, bool)
            mark[p.flat(row, place)[1]] = True
            runs = p.runs()
            key, d1, d2, text, low, high = runs.halves(mark[runs.low])
            at = p.row[text]
            yield [key, d1, d2, ids[at], ths[at], low, high, np.ones(len(key), np.int64)]

    return each


def _window_rows(w: Windows) -> Callable:
    def each(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        low, row = _flat(batch.column("low"))
        high, _ = _flat(batch.column("high"))
        ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
        for p in portions(batch.column("text"), w):
            some, flat, last = p.flat(row, low)
            count = np.minimum(high[some] - low[some], last - flat) + 1
            flat = np.unique(np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(flat, count))
            text = np.searchsorted(p.first, flat, side="right") - 1
            d1, d2 = p.digests(flat, flat + w.size)
            at, place = p.row[text], flat - p.first[text] + p.base[text]
            yield [d1, d2, np.zeros(len(flat), np.int64), ids[at], ths[at], place, place, np.ones(len(flat), np.int64)]

    return each


def _judge(*, earlier: bool, opens: bool) -> Callable:
    """A mapInArrow function over the _BLOCKS of a part: windows that repeat (over) and those that stand for their equals
    against other digests of the key (open).

    Where a part grows beyond HELD rows, those that stand for no others are handed on at once. If many are left and opens,
    keys with several digests hand on all of theirs as open, which leaves them to be judged window by window, and keep two
    rows each that stand for the several digests: memory does not grow with a key's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows, most = [], 0, HELD

        def out(cols: list[np.ndarray], over: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(over | open_)
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (*cols, over, open_)], ["id", "th", "low", "high", "over", "open"])

        for batch in batches:
            for done, block in zip(batch.column("done").to_pylist(), batch.column("block"), strict=True):
                if done:
                    cols = unpacked(block, 4)
                    sure = np.ones(len(cols[0]), bool)
                    yield out(cols, sure, ~sure)
                    continue
                have.append(unpacked(block, len(_NAMES)))
                rows += len(have[-1][0])
                if rows <= most:
                    continue
                cols, over, stays, several = _compared([np.concatenate(c) for c in zip(*have, strict=True)], earlier=earlier)
                yield out(cols[3:7], over, np.zeros(len(over), bool))
                cols, several = [c[stays] for c in cols], several[stays]
                if opens and len(several) > most // 2:
                    yield out(cols[3:7], np.zeros(len(several), bool), several)
                    span, key = _starts(cols, 3), _starts(cols, 1)
                    second = span[np.minimum(np.searchsorted(span, key) + 1, len(span) - 1)]
                    keeps = ~several
                    keeps[key] = True
                    keeps[second] = True
                    cols = [c[keeps] for c in cols]
                have, rows = [cols], len(cols[0])
                most = max(most, 2 * rows)
        if have:
            cols, over, stays, several = _compared([np.concatenate(c) for c in zip(*have, strict=True)], earlier=earlier)
            yield out(cols[3:7], over, stays & several)

    return run


def repeated(texts: DataFrame, candidates: DataFrame, w: Windows, *, earlier: bool) -> DataFrame:
    """(id, th, low, high), written: windows low..high of the document repeat. texts: those of once(); candidates: (rk, place)
    of the runs to be judged.

    earlier: a window counts if it also starts in a document with a smaller id; else if it also starts anywhere else.
    Rows of a task are sorted by key and digest, equal ones combined, and handed to the tasks of their keys in blocks.
    All windows of a half repeat if its digest does; where a key has several digests, one half of each is taken apart into
    windows, which are compared in the same way.
    """
    conf = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def judged(rows: DataFrame, each: Callable, n: int, *, opens: bool) -> DataFrame:
        parts = parts_for(n, conf)
        return rows.mapInArrow(_gathered(each, parts, earlier=earlier), _BLOCKS).repartitionById(parts, "part").mapInArrow(_judge(earlier=earlier, opens=opens), _RANGES)

    lists = with_lists(texts, candidates, by=["rk"], lists=["place"], how="inner")
    halves = written(judged(lists.select("id", "th", "text", "place"), _half_rows(w), 2 * candidates.count(), opens=True), "judged")
    opened = halves.where("open").select("id", "th", "low", "high")
    n = opened.agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0] or 0
    single = with_lists(texts, opened, by=["id", "th"], lists=["low", "high"], how="inner")
    found = judged(single.select("id", "th", "text", "low", "high"), _window_rows(w), n, opens=False).where("over")
    ranges = written(halves.where("over").union(found).select("id", "th", "low", "high"), "ranges")
    discard(halves)
    return ranges


def merged(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the maximal stretches of symbols that windows low..high cover."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    start, stop = low[order], np.maximum.accumulate((high + size)[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return start[new], stop[np.append(new[1:], len(start)) - 1]


def digested(docs: DataFrame, ranges: DataFrame, known: DataFrame, w: Windows, each: Callable, columns: list[tuple[str, str]]) -> DataFrame:
    """doc_id and what each(text bytes, start, stop) returns, for every row of docs; start, stop are the stretches to be
    removed, LAST_ID as stop for the whole text of a copy. columns: (name, Spark type)."""
    base = named(docs).join(sized_broadcast(known.select("id", "th", "gone")), ["id", "th"], "left")
    base = with_lists(base, ranges, by=["id", "th"], lists=["low", "high"], how="left")
    names, kinds = [c for c, _ in columns], ", ".join(f"{c} {t}" for c, t in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, row = _flat(batch.column("low"))
            high, _ = _flat(batch.column("high"))
            cut = np.searchsorted(row, np.arange(len(batch) + 1))
            gone = pc.fill_null(batch.column("gone"), False).to_pylist()
            out = []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                some = slice(cut[i], cut[i + 1])
                out.append(each(text.as_py(), *((np.array([0]), np.array([LAST_ID])) if gone[i] else merged(low[some], high[some], w.size))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.string() if t == "string" else pa.int64()) for x, (_, t) in zip(zip(*out, strict=True), columns, strict=True)]], ["doc_id", *names]) if out else pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([], pa.string() if t == "string" else pa.int64()) for _, t in columns]], ["doc_id", *names])

    return base.select("doc_id", "text", "low", "high", "gone").mapInArrow(run, f"doc_id long, {kinds}")
