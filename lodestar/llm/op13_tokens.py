"""Token counts by heap-and-linked-list byte-pair merging: the count is initial symbols less merges, and no token is named."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table

#: The vocabulary of the query, and the count above which a text is over the limit.
VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Distinct pieces whose counts a worker remembers, and the longest that it remembers.
REMEMBERED, SHORT = 1 << 18, 64
#: Texts of more characters are cut into pieces one at a time.
STREAMED = 1 << 20
#: Fixed value: how byte-level vocabularies cut a text into pieces; %s are letters and numbers.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """ids of the 256 bytes; for each id the ranks of the pairs that it begins, by their second id; the id that each rank
    makes; strings that are one token wherever they stand; and characters that the tokenizer's own Unicode tables, older
    than those of regex, don't take as letters or numbers."""

    bytes_: tuple[int, ...]
    pairs: list[dict[int, int]]
    made: list[int]
    added: tuple[str, ...]
    plain: str


def byte_names() -> list[str]:
    """The characters that stand for the bytes 0..255 in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def _plain(tokenizer) -> str:
    """Letters and numbers of regex's tables that the tokenizer takes as other characters: each stands between full stops, with which those merge."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    some = regex.findall(r"[\p{L}\p{N}]", every)
    alone = {piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str("." + ".".join(some) + ".")}
    names = byte_names()
    return "".join(c for c in some if "".join(names[b] for b in c.encode()) not in alone)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """A byte-level vocabulary file of the tokenizers library. Its size is that of the file; texts have no part in it."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    odd = [a for a in spec["added_tokens"] if a["single_word"] or a["lstrip"] or a["rstrip"]]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges") or odd:
        raise ValueError("only plain byte-level vocabularies are supported")
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
    for rank, (a, b) in enumerate(merges):
        pairs[ids[a]][ids[b]] = rank
    added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
    return Vocabulary(tuple(ids[c] for c in byte_names()), pairs, [ids[a + b] for a, b in merges], tuple(added), _plain(Tokenizer.from_file(path)))


def merged_count(symbols: list[int], pairs: list[dict[int, int]], made: list[int]) -> int:
    """How many symbols are left when the adjacent pair of lowest rank, the leftmost of equals, merges until none can.

    Symbols form a linked list; pairs wait in a heap as rank and place. A popped pair that has changed since is skipped.
    """
    n = len(symbols)
    if n < 2:
        return n
    shift = n.bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank: list[int | None] = [pairs[a].get(b) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
    heap = [r << shift | i for i, r in enumerate(rank) if r is not None]
    heapify(heap)
    rank.append(None)  # of the pair that starts at a place
    place, left = (1 << shift) - 1, n
    while heap:
        top = heappop(heap)
        i = top & place
        if rank[i] != top >> shift:
            continue
        one = symbols[i] = made[top >> shift]
        gone = after[i]
        rank[gone] = None
        follows = after[i] = after[gone]
        left -= 1
        if follows < n:
            before[follows] = i
            r = rank[i] = pairs[one].get(symbols[follows])
            if r is not None:
                heappush(heap, r << shift | i)
        else:
            rank[i] = None
        last = before[i]
        if last >= 0:
            r = rank[last] = pairs[symbols[last]].get(one)
            if r is not None:
                heappush(heap, r << shift | last)
    return left


class _Counts(dict):
    """Counts of pieces, merged when first asked for; those not asked for in a while are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.words, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            words = self.words
            n = merged_count([words.bytes_[b] for b in piece.encode()], words.pairs, words.made)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


def counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    fast = regex.compile(_CUT.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
    plain, some = regex.escape(vocabulary.plain), frozenset(vocabulary.plain)
    exact = regex.compile(_CUT.format(L=rf"[\p{{L}}--[{plain}]]", N=rf"[\p{{N}}--[{plain}]]", l=rf"[\p{{L}}--[{plain}]]", n=rf"[\p{{N}}--[{plain}]]"), regex.V1) if plain else fast
    added = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None
    counts = _Counts(vocabulary)

    def of(text: str) -> int:
        cut = fast if text.isascii() or some.isdisjoint(text) else exact
        pieces = cut.findall(text) if len(text) <= STREAMED else (m.group() for m in cut.finditer(text))
        return sum(map(counts.__getitem__, pieces))

    def run(text: str) -> int:
        if added is None or not added.search(text):
            return of(text)
        parts = added.split(text)
        return len(parts) - 1 + sum(map(of, parts))

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs, by the vocabulary file at path.

    Counts are those of the tokenizers library without begin and end tokens; a special token's string in a text is one
    token. Rows are counted where they are read: no shuffle, and nothing but the vocabulary is sent to the tasks. A null
    or empty text has 0 bytes and tokens; repeated rows stay; a null doc_id stays null; an empty table gives no rows;
    other columns are ignored; texts of any length are counted whole, and a piece of n bytes takes n log n steps.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # as large as the vocabulary file, 1.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(words.value)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            n = pa.array([count(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, as in token_counts()."""
    return token_counts(table(spark, sf_dir, "documents"))
