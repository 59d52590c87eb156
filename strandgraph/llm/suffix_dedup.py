"""Exact removal of repeated byte windows by a depth-limited radix sort.

Suffixes are ordered only through ``WINDOW`` bytes, by most-significant-digit
passes; a pass keeps the suffixes whose digit is shared and drops the rest:

1. digit one is a 64-byte anchor of the window (a minimiser, so that equal
   windows have equal anchors at equal places); only shared anchors go on;
2. digit two is the place in the anchor's block of sixteen neighbouring windows:
   a block whose whole extent is shared is settled, one whose common core is
   not shared is dropped;
3. only windows of undecided blocks are compared one by one, on 128 bits.

Equal groups after the last pass are exactly the repeated windows, up to
collisions of 128-bit hashes: digits travel as hashes, and bytes that merely look
alike never meet. Each pass is one shuffle of packed hashes: a group of documents
(``pid``) sends every distinct digit once, or twice if it repeats there, so a
passage that a third of all documents share costs two entries a group and never
one task. Texts are shuffled once and that exchange serves all passes. The first
pass sends its anchors' places along, two bytes an anchor, so later passes hash
anchors and the blocks of shared ones only.

Null and empty texts give no windows: nothing is removed and ``kept_sha256`` is
the hash of no bytes. Repeated rows are separate documents, and rows that tie in
everything get equal results. Texts under ``WINDOW`` bytes are kept. Very long
texts are scanned in pieces, so memory is bounded by a group's texts plus a fixed
buffer. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import U, as_table, capped, file_bytes, grouped, mix, number_of_groups, pack, partitions, unpack

WINDOW = 200
ANCHOR = 64
SPAN = WINDOW - ANCHOR + 1
BLOCK = 16
PIECE = 1 << 19
#: Bytes of input files for which a group is made, at most.
GROUP_BYTES = 32 << 20
PLACE = U((1 << 20) - 1)
SEEDS = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))

PACKED = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("pid", pa.int32()), ("items", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def places(size: int) -> list[int]:
    """Where the 8-byte words stand that cover ``size`` bytes."""
    return [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]


class Buffer:
    """Some pieces of texts side by side, as the 8-byte words from every place."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.pieces = pieces
        lens = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(lens)
        self.start, self.stop = ends - lens, ends - WINDOW + 1  # window starts of each piece
        raw = b"".join(p[2] for p in pieces)
        self.words = np.empty(len(raw) - 7, np.uint64)
        for k in range(8):
            self.words[k::8] = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, place of anchor, first window, number of windows) of each run of
        windows of a piece with one anchor."""
        low = self.words * SEEDS[0]
        low &= ~PLACE
        low |= np.arange(len(low), dtype=np.uint64)
        n = len(self.words) + 8 - WINDOW  # windows; the least of SPAN words each
        rows = -(-len(low) // SPAN)
        square = np.full(rows * SPAN, ~U(0))
        square[: len(low)] = low
        square = square.reshape(rows, SPAN)
        left = np.minimum.accumulate(square, axis=1).ravel()
        right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(right[:n], left[SPAN - 1 : SPAN - 1 + n]) & PLACE).astype(np.int64)
        mark = np.zeros(n + 1, np.int8)
        mark[self.start] = 1
        np.subtract.at(mark, np.minimum(self.stop, n), 1)
        at = np.flatnonzero(np.cumsum(mark[:n], dtype=np.int8))
        anchor = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        piece = np.searchsorted(self.start, at[first], side="right") - 1
        return piece, anchor[first], at[first], np.diff(np.append(first, len(at)))

    def hashes(self, at: np.ndarray, size: int, lanes: int = 1) -> list[np.ndarray]:
        """64-bit hashes of the ``size`` bytes from each place."""
        out = [np.full(len(at), seed) for seed in SEEDS[:lanes]]
        for place in places(size):
            word = self.words[at + place]
            for h, seed in zip(out, reversed(SEEDS)):
                h ^= word
                h *= seed
                h ^= h >> U(32)
        return out


def buffers(texts: list[bytes]):
    pieces, size = [], 0
    for i, t in enumerate(texts):
        for base in range(0, len(t) - WINDOW + 1, PIECE - WINDOW + 1):
            part = t[base : base + PIECE]
            if size + len(part) > 2 * PIECE - WINDOW:
                yield Buffer(pieces)
                pieces, size = [], 0
            pieces.append((i, base, part))
            size += len(part)
            if size >= PIECE:
                yield Buffer(pieces)
                pieces, size = [], 0
    if pieces:
        yield Buffer(pieces)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def fold(rows: np.ndarray) -> np.ndarray:
    """One word for a row of digits. What a group hears back names its own rows
    only, some hundred thousand, so 62 bits tell them apart."""
    key = rows[:, 0]
    for i in range(1, rows.shape[1]):
        key = mix(key, rows[:, i])
    return key


class Anchors:
    """The runs of windows of a group's texts, by text: what pass 1 has found, kept
    as the distance from anchor to anchor and a number of windows, a byte each."""

    def __init__(self, texts: list[bytes], blobs: list[bytes]):
        known = {}
        for blob in blobs:
            n = int(np.frombuffer(blob, np.uint64, 1)[0])
            keys, ends = (np.frombuffer(blob, np.uint64, n, 8 + 8 * n * i) for i in (0, 1))
            total = int(ends[-1]) if n else 0
            bytes_ = np.frombuffer(blob, np.uint8, 2 * total, 8 + 16 * n)
            for k, lo, hi in zip(keys.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                known[k] = (bytes_[lo:hi], bytes_[total + lo : total + hi])
        nothing = np.zeros(0, np.uint8)
        found = [known.get(xxhash.xxh3_64_intdigest(t), (nothing, nothing)) if len(t) >= WINDOW else (nothing, nothing) for t in texts]
        self.ends = np.cumsum([0, *(len(x) for x, _ in found)])
        self.anchor = np.concatenate([np.cumsum(x, dtype=np.int64) for x, _ in found] or [nothing])
        self.count = np.concatenate([x for _, x in found] or [nothing]).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.first -= np.repeat(np.append(self.first, 0)[self.ends[:-1]], np.diff(self.ends))

    @staticmethod
    def packed(texts: list[bytes], doc: np.ndarray, anchor: np.ndarray, count: np.ndarray) -> bytes:
        some = np.unique(doc)
        keys = np.array([xxhash.xxh3_64_intdigest(texts[i]) for i in some], np.uint64)
        step = np.diff(anchor, prepend=0)
        head = np.searchsorted(doc, some)
        step[head] = anchor[head]
        ends = np.append(head[1:], len(doc)).astype(np.uint64)
        return b"".join([np.uint64(len(some)).tobytes(), keys.tobytes(), ends.tobytes(), step.astype(np.uint8).tobytes(), count.astype(np.uint8).tobytes()])

    def of(self, b: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``Buffer.runs`` gives."""
        lo, hi, shift = [], [], []
        for (i, base, part), start in zip(b.pieces, b.start.tolist()):
            x, y = self.ends[i], self.ends[i + 1]
            mine = self.first[x:y]
            lo.append(x + (np.searchsorted(mine, base) if base else 0))
            hi.append(x + np.searchsorted(mine, base + len(part) - WINDOW + 1))
            shift.append(start - base)
        n = np.array(hi) - np.array(lo)
        piece = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) + (np.array(lo) - (np.cumsum(n) - n))[piece]
        shift = np.array(shift)[piece]
        return piece, self.anchor[at] + shift, self.first[at] + shift, self.count[at]


def blocks(b: Buffer, runs, shared: np.ndarray):
    """The blocks in which windows with a shared anchor stand: (hashed extents,
    and of each part of a run in a block: its block, its first and last window)."""
    piece, anchor, first, count = runs
    on = member(b.hashes(anchor, ANCHOR)[0], shared)
    if not on.any():
        return None
    piece, anchor, first, final = piece[on], anchor[on], first[on], first[on] + count[on] - 1
    least, most = (anchor - final) // BLOCK, (anchor - first) // BLOCK
    n = most - least + 1
    run = np.repeat(np.arange(len(n)), n)
    last = anchor[run] - BLOCK * (least[run] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    lo, hi = np.maximum(first[run], last - (BLOCK - 1)), np.minimum(final[run], last)
    # two anchors may name the same block: its place counts once
    last, one, block = np.unique(last, return_index=True, return_inverse=True)
    piece = piece[run[one]]
    start = last - (BLOCK - 1)
    whole = (start >= b.start[piece]) & (last < b.stop[piece])
    items = np.zeros((len(last), 3), np.uint64)
    items[:, 0] = b.hashes(last, WINDOW - BLOCK + 1)[0]
    items[whole, 1], items[whole, 2] = b.hashes(start[whole], WINDOW + BLOCK - 1, 2)
    return items, block, lo, hi


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from each lo to its hi."""
    n = hi - lo + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def pass_over(level: int, n_buckets: int):
    """The map side of pass ``level`` (1 to 3), or 4: the result."""

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        texts = [t or b"" for t in left.column("text").to_pylist()]
        pid = left.column("pid")[0].as_py() if left.num_rows else 0
        fed: dict[int, list[bytes]] = {0: [], 1: [], 2: [], 3: []}
        if right is not None:
            for n, items in zip(right.column("level").to_pylist(), right.column("items").to_pylist()):
                fed[n].append(items)
        if level == 1:
            return first_pass(texts, pid)
        shared = np.sort(unpack(fed[1], 1)[:, 0])
        status, windows = np.sort(unpack(fed[2], 1)[:, 0]), np.sort(unpack(fed[3], 1)[:, 0])
        anchors = Anchors(texts, fed[0]) if len(shared) else None
        sent, hits = [], []
        for b in buffers(texts) if len(shared) else ():
            found = blocks(b, anchors.of(b), shared)
            if found is None:
                continue
            items, block, lo, hi = found
            if level == 2:
                sent.append(capped(items))
                continue
            key = fold(items) & ~U(3)
            at = np.minimum(np.searchsorted(status, key), max(len(status) - 1, 0))
            says = (np.where((status[at] & ~U(3)) == key, status[at] & U(3), U(0)) if len(status) else key * U(0))[block]
            open_ = (says & U(1)) > 0
            single = ranges(lo[open_], hi[open_])
            digest = np.column_stack(b.hashes(single, WINDOW, 2))
            if level == 3:
                sent.append(capped(digest))
                continue
            single = single[member(fold(digest), windows)]
            whole = (says & U(2)) > 0
            lo, hi = np.concatenate([lo[whole], single]), np.concatenate([hi[whole], single]) + WINDOW
            piece = np.searchsorted(b.start, lo, side="right") - 1
            shift = np.array([base for _, base, _ in b.pieces])[piece] - b.start[piece]
            hits.append(np.column_stack([np.array([i for i, _, _ in b.pieces])[piece], lo + shift, hi + shift]))
        if level < 4:
            return sending(level, pid, np.concatenate(sent) if sent else None)
        out = {f.name: [] for f in RESULT}
        spans = merged(np.concatenate(hits)) if hits else np.zeros((0, 3), np.int64)
        edges = np.searchsorted(spans[:, 0], np.arange(len(texts) + 1))
        for i, (doc_id, t) in enumerate(zip(left.column("doc_id").to_pylist(), texts)):
            mine = spans[edges[i] : edges[i + 1], 1:].ravel().tolist()
            kept = t
            if mine:
                edge = [0, *mine, len(t)]
                kept = b"".join([t[a:z] for a, z in zip(edge[::2], edge[1::2])])
            for k, v in zip(out, (doc_id, len(t), len(t) - len(kept), len(mine) // 2, hashlib.sha256(kept).hexdigest(), mine)):
                out[k].append(v)
        return as_table(RESULT, **out)

    def first_pass(texts: list[bytes], pid: int) -> pa.Table:
        sent, doc, place, count = [], [], [], []
        for b in buffers(texts):
            piece, anchor, _, n = b.runs()
            sent.append(capped(b.hashes(anchor, ANCHOR)[0].reshape(-1, 1)))
            doc.append(np.array([i for i, _, _ in b.pieces])[piece])
            place.append(anchor - b.start[piece] + np.array([base for _, base, _ in b.pieces])[piece])
            count.append(n)
        out = sending(1, pid, np.concatenate(sent) if sent else None)
        if not sent:
            return out
        own = Anchors.packed(texts, *map(np.concatenate, (doc, place, count)))
        return pa.concat_tables([out, as_table(PACKED, level=[0], bucket=[n_buckets + pid], pid=[pid], items=[own])])

    def sending(level: int, pid: int, rows: np.ndarray | None) -> pa.Table:
        rows = np.zeros((0, 1), np.uint64) if rows is None else capped(rows)
        out = list(pack((rows[:, 0] % U(n_buckets)).astype(np.int64), n_buckets, *rows.T)) if len(rows) else []
        return as_table(PACKED, level=[level] * len(out), bucket=[x[0] for x in out], pid=[pid] * len(out), items=[x[1] for x in out])

    return run if level > 1 else lambda t: run(t)


def merged(spans: np.ndarray) -> np.ndarray:
    """(document, start, end) rows with those that touch or overlap as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = spans[:, 0] << 40
    end = np.maximum.accumulate(far + spans[:, 2])
    new = np.ones(len(spans), bool)
    new[1:] = far[1:] + spans[1:, 1] > end[:-1]
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], spans[first, 1], end[np.append(first[1:], len(spans)) - 1] - far[first]])


def meet(level: int):
    """The reduce side of a pass: which digits are shared, told to each group."""
    width = {1: 1, 2: 3, 3: 2}[level]

    def run(t: pa.Table) -> pa.Table:
        if t.column("level")[0].as_py() == 0:  # a group's own anchors, on their way back
            return t
        pids, blobs = t.column("pid").to_pylist(), t.column("items").to_pylist()
        rows = unpack(blobs, width)
        src = np.repeat(np.arange(len(blobs)), [len(x) // (8 * width) for x in blobs])
        order = np.lexsort(rows.T[::-1])
        rows, src = rows[order], src[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] >= 2
        if level == 2:
            top = np.ones(len(rows), bool)
            top[1:] = rows[1:, 0] != rows[:-1, 0]
            top = np.cumsum(top) - 1
            settled = often & (rows[:, 1:] != 0).any(axis=1)
            open_ = (np.bincount(top) >= 2) & (np.bincount(top, weights=~settled) > 0)
            state = 2 * settled.astype(np.uint64) + open_[top].astype(np.uint64)
            rows, often = np.column_stack([rows, state]), state > 0
        rows, src, group = rows[often], src[often], group[often]
        order = np.lexsort((group, src))
        rows, src, group = rows[order], src[order], group[order]
        once = np.ones(len(rows), bool)
        once[1:] = (group[1:] != group[:-1]) | (src[1:] != src[:-1])
        rows, src = rows[once], src[once]
        told = rows[:, 0] if level == 1 else fold(rows) if level == 3 else fold(rows[:, :3]) & ~U(3) | rows[:, 3]
        edges = np.searchsorted(src, np.arange(len(blobs) + 1))
        keep = [i for i in range(len(blobs)) if edges[i] < edges[i + 1]]
        return as_table(PACKED, level=[level] * len(keep), bucket=[0] * len(keep), pid=[pids[i] for i in keep], items=[told[edges[i] : edges[i + 1]].tobytes() for i in keep])

    return run


PACKED_DDL = "level int, bucket int, pid int, items binary"
RESULT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"


def remove_repeats(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: sizes, the hash of what is kept,
    and ``spans``, the removed byte runs as start, end, start, end, ...

    ``groups``: how many groups of documents; a task holds one group's texts at
    a time (default: two per shuffle partition, more for over ``GROUP_BYTES`` each)."""
    spark = docs.sparkSession
    n = partitions(spark)
    groups = groups or number_of_groups(spark, file_bytes(docs), GROUP_BYTES)
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = grouped(docs, groups, "doc_id", "text").repartition(n, "pid")
    of = texts.groupBy("pid")

    buckets = max(1, n // 2)

    def shared(level: int, sent: DataFrame) -> DataFrame:
        # dealt by group at once, so that later passes reuse the exchange
        return sent.groupBy("bucket").applyInArrow(meet(level), PACKED_DDL).repartition(n, "pid")

    first = shared(1, of.applyInArrow(pass_over(1, buckets), PACKED_DDL))
    second = shared(2, of.cogroup(first.groupBy("pid")).applyInArrow(pass_over(2, buckets), PACKED_DDL))
    fed = first.unionByName(second)
    third = shared(3, of.cogroup(fed.groupBy("pid")).applyInArrow(pass_over(3, buckets), PACKED_DDL))
    fed = fed.unionByName(third)
    return of.cogroup(fed.groupBy("pid")).applyInArrow(pass_over(4, buckets), RESULT_DDL)
