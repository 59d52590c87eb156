"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item are compared as token sequences: lower case, no
ASCII punctuation. A seed is a run of ``SEED`` tokens that both hold (all tokens
of a shorter item); texts without seeds are done. For the rest, tiling marks the
longest run that both hold unmarked, again and again, down to seeds; of equal
ones the first in the item, then in the text. Running Karp-Rabin hashes find it:
a length is tried on all unmarked windows of the text's seeded stretches and of
the item at once, the longest by bisection, and the tokens of a match are
compared. Lengths are distinct, so an item of m tokens takes at most some sqrt(2 m)
rounds, however often its words repeat. An item leaks into a text if tiles cover
at least ``COVER`` of its tokens, in whatever order they stand.

Items are the stated side: they are read in blocks of at most ``BLOCK_BYTES``
of text, each block is broadcast and meets every row; a larger benchmark means
more blocks, not a larger broadcast.

Null and empty texts and items match nothing. Repeated rows give repeated
results, repeated items one result each. Very long and very repetitive texts are
handled whole. Empty tables give empty results. Other columns are ignored or
passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import Scratch, U, as_table, frugal, shingle_hashes, word_hashes

SEED = 5
COVER = 0.6
BLOCK_BYTES = 32 << 20
TABLE_BITS = 22
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: str | None) -> np.ndarray:
    raw = text.lower().encode("utf-8", "replace") if text else b""
    return word_hashes(raw.translate(None, _PUNCTUATION).split())


class Items:
    """Seeds of a block of items: (seed, item) pairs and the seeds' places."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.words = [], []
        for item_id, text in rows:
            w = tokens(text)
            if len(w):
                self.ids.append(item_id)
                self.words.append(w)
        self.by_size = {}
        for size in {min(SEED, len(w)) for w in self.words}:
            seeds, item, times = [], [], []
            for i, w in enumerate(self.words):
                if min(SEED, len(w)) == size:
                    s, n = np.unique(shingle_hashes(w, size), return_counts=True)
                    seeds.append(s)
                    item.append(np.full(len(s), i))
                    times.append(n)
            seeds, item, times = map(np.concatenate, (seeds, item, times))
            order = np.argsort(seeds, kind="stable")
            maybe = np.zeros(1 << TABLE_BITS, bool)
            maybe[seeds >> U(64 - TABLE_BITS)] = True
            self.by_size[size] = (seeds[order], item[order], times[order], maybe)

    def leaks(self, text: str | None, cover: float = COVER) -> list[tuple[int, float, int]]:
        """(item_id, coverage, number of tiles) of the items that leak in."""
        w = tokens(text)
        out = []
        for size, (seeds, item, times, maybe) in self.by_size.items():
            if len(w) < size:
                continue
            h = shingle_hashes(w, size)
            at = np.flatnonzero(maybe[h >> U(64 - TABLE_BITS)])
            if not len(at):
                continue
            # each seed of the text once, whatever its number
            mine, of = np.unique(h[at], return_inverse=True)
            lo, hi = np.searchsorted(seeds, mine, "left"), np.searchsorted(seeds, mine, "right")
            n = hi - lo
            if not n.any():
                continue
            seed = np.repeat(np.arange(len(mine)), n)
            k = np.arange(len(seed)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            order = np.argsort(item[k], kind="stable")
            seed, k = seed[order], k[order]
            for one in np.split(np.arange(len(k)), np.flatnonzero(np.diff(item[k])) + 1):
                i = item[k[one[0]]]
                need, places = cover * len(self.words[i]), times[k[one]].sum()
                if places + size - 1 < need and places * size < need:
                    continue
                here = np.zeros(len(mine), bool)
                here[seed[one]] = True
                covered, tiles = tile(stretches(w, at[here[of]], size), self.words[i], size)
                if covered >= need:
                    out.append((self.ids[i], covered / len(self.words[i]), tiles))
        return out


def stretches(text: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The parts of a text that seeds at the places ``at`` cover."""
    cut = np.flatnonzero(np.diff(at) > size) + 1
    return [text[x[0] : x[-1] + size] for x in np.split(at, cut)] if len(at) else []


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Side:
    """One side of a tiling: tokens, and which of them are marked."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        self.words, self.marked, self.back = words, marked, powers(_BACK, len(words))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_BASE, len(words))[:-1], dtype=np.uint64)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, rolling hashes) of the windows of ``n`` unmarked tokens."""
        if n > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        used = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(used[n:] == used[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tile(text: list[np.ndarray], item: np.ndarray, size: int) -> tuple[int, int]:
    """(tokens of ``item`` covered, number of tiles of ``size`` tokens or more);
    tiles do not cross from one stretch of ``text`` to another."""
    if not text:
        return 0, 0
    gap = np.zeros(1, np.uint64)
    words = np.concatenate([x for part in text for x in (part, gap)])
    marked = np.zeros(len(words), bool)
    marked[np.cumsum([len(part) + 1 for part in text]) - 1] = True
    a, b = Side(item, np.zeros(len(item), bool)), Side(words, marked)

    def common(n: int) -> dict[int, tuple[list[int], list[int]]]:
        (p, x), (t, y) = a.windows(n), b.windows(n)
        both = np.intersect1d(x, y)
        p, x, t, y = p[np.isin(x, both)], x[np.isin(x, both)], t[np.isin(y, both)], y[np.isin(y, both)]
        if not len(both):
            return {}
        out = {h: ([], []) for h in both.tolist()}
        for place, h in zip(p.tolist(), x.tolist()):
            out[h][0].append(place)
        for place, h in zip(t.tolist(), y.tolist()):
            out[h][1].append(place)
        return out

    covered = tiles = 0
    most = min(len(item), max(map(len, text)))
    while most >= size:
        if not len(np.intersect1d(a.windows(size)[1], b.windows(size)[1])):
            break
        lo, hi = size, most
        while lo < hi:  # a common window of n tokens holds one of n - 1
            mid = (lo + hi + 1) // 2
            if len(np.intersect1d(a.windows(mid)[1], b.windows(mid)[1])):
                lo = mid
            else:
                hi = mid - 1
        n = most = lo
        found = common(n)
        next_ = dict.fromkeys(found, 0)
        for p, h in sorted((p, h) for h, (places, _) in found.items() for p in places):
            if a.marked[p] or a.marked[p + n - 1]:
                continue
            there, k = found[h][1], next_[h]
            while k < len(there) and (b.marked[there[k]] or b.marked[there[k] + n - 1] or not (words[there[k] : there[k] + n] == item[p : p + n]).all()):
                k += 1
            next_[h] = k
            if k < len(there):
                a.marked[p : p + n] = True
                b.marked[there[k] : there[k] + n] = True
                covered, tiles = covered + n, tiles + 1
        most = n - 1  # what is common and unmarked now is shorter
    return covered, tiles


def block_count(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = benchmark.where("text is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-total // block_bytes)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Yields the items in blocks whose texts have about ``block_bytes`` at most."""
    items = benchmark.select("item_id", "text").where("text is not null")
    n = block_count(items, block_bytes)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield Items(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32())])
LEAKS_DDL = "doc_id bigint, item_id bigint, coverage double, n_tiles int"


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per text and item that leaks into it. Of several blocks one at a time
    is with the executors: a block's rows are written before the next one is sent."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n, scratch, out = block_count(benchmark, block_bytes), Scratch(spark, "leaks"), None
    for i, block in enumerate(blocks(benchmark, block_bytes)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for x in shared.value.leaks(t, cover)]
                yield from as_table(LEAKS, **{f.name: [r[i] for r in rows] for i, f in enumerate(LEAKS)}).to_batches()

        part = docs.mapInArrow(frugal(run), LEAKS_DDL)
        if n > 1:
            part = scratch.put(part, f"block{i}")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], LEAKS_DDL) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that an item leaks into; no shuffle, one pass a
    block. What a block has left is written before the next one is sent."""
    n, scratch = block_count(benchmark, block_bytes), Scratch(docs.sparkSession, "clean")
    for i, block in enumerate(blocks(benchmark, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t, cover) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(frugal(run), docs.schema)
        if i < n - 1:
            docs = scratch.put(docs, f"block{i}")
            scratch.drop(f"block{i - 1}")
            shared.unpersist()
    return docs
