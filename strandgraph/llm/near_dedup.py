"""Near-duplicate classes by fast similarity sketching, banding and exact checks.

A document's set holds its distinct five-word shingles. A sketch has ``COORDS``
coordinates: each round throws every shingle into one coordinate by hash, a
coordinate keeps the least value of the first round that reaches it, and a last
pass visits the coordinates that no round has reached, so all are filled. Bands
of ``ROWS`` coordinates name buckets; documents that share a bucket are
compared on their full sets, and a link needs 100 * intersection >= 75 * union.

No group is expanded into rows of pairs, and no key is a task. Texts with equal
word sequences are one class from the start. Classes stand in groups by hash
(``pid``); a group sends each bucket key once, with what it knows of it, and
hears back what all groups know. So each bucket gets one pivot (the member whose
buckets hold most members, the centre of a group of copies), and every other
member is compared with it: a bucket of n copies costs n comparisons, in parts
of about ``PART`` shingles or more, each with a copy of the pivot's set. Where a bucket
then still holds several components, its members go on to an exact search, less
those that cannot have a link there: with s of a member's n shingles in any
other member of such buckets, a link needs s >= 0.75 n. The search deals a
bucket out in blocks of about ``BLOCK`` members, and a task, given two blocks,
rules pairs out by component, by size, by s, and by the triangle inequality of
the Jaccard distance to the pivot, counts the shingles that the others share, and
returns links only. Its work, and copies of the sets left, grow with the square of
the members that can have a link in one bucket. Components come from parents that
groups keep and shorten by messages, one exchange a step. State between steps is
written to the shared folder and deleted when its successor is.

Null, empty and blank texts have empty sets and stay alone. Texts under five
words are one shingle, very long ones are handled whole. Repeated rows share a
class. Texts, not doc_ids, are compared, so rows that share a doc_id or have none
are each compared by their own text; a class without a doc_id has no component_id.
Of a class the row with the least doc_id (null last), then the least hash of text
is kept; of tied pivots the one whose row was read first. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import Scratch, U, as_table, ascii_words, forget_words, frugal, give_back, mix, number_of_groups, pack, partitions, shingle_hashes, to_bytes, unpack, word_hashes

WORDS = 5
COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
#: Members of a bucket that one side of the exact search holds.
BLOCK = 512
#: Shingles of members that are compared with one copy of their pivot, at least,
#: and how many times those of the pivot, so copies add little.
PART, TIMES = 1 << 14, 16
#: Digests of texts that a task remembers, to sketch copies once.
MEMO = 1 << 17
_salt = np.random.default_rng(20240229).integers(1, 1 << 63, (2, COORDS), dtype=np.uint64)

INFO = pa.schema([("doc_id", pa.int64()), ("own", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.binary())])
INFO_DDL = "doc_id bigint, own binary, n_shingles bigint, digest binary, bands binary"
SAID = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("items", pa.binary())])
SAID_DDL = "bucket int, pid int, items binary"


def words_of(text: str | None) -> list[bytes]:
    return ascii_words(to_bytes(text))


def shingle_set(words: list[bytes]) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words), WORDS))


def sketch(s: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set of 64-bit hashes."""
    out, open_ = np.zeros(COORDS, np.uint64), np.ones(COORDS, bool)
    at_once = max(1, min(64, 3 * COORDS // len(s)))
    done = 0
    while done < COORDS and open_.any():
        rounds = np.arange(done, min(done + at_once, COORDS), dtype=np.uint64)
        v = mix(s[None, :] ^ _salt[0, done : done + len(rounds), None], s[None, :])
        place = ((v >> U(32)) * U(COORDS)) >> U(32)
        key = ((place << U(56)) | ((rounds - U(done))[:, None] << U(50)) | ((v & U(0xFFFFFFFF)) << U(18)) | ((v >> U(32)) & U(0x3FFFF))).ravel()
        key.sort()
        place = (key >> U(56)).astype(np.int64)
        first = np.ones(len(key), bool)
        first[1:] = place[1:] != place[:-1]
        place, key = place[first], key[first]
        new = open_[place]
        place, key = place[new], key[new]
        out[place] = mix(key & U((1 << 50) - 1), ((key >> U(50)) & U(63)) + U(done))
        open_[place] = False
        done += len(rounds)
    for i in np.flatnonzero(open_):
        out[i] = mix(s ^ _salt[1, i], s).min()
    return out


def bands(s: np.ndarray) -> np.ndarray:
    c = sketch(s).reshape(-1, ROWS)
    key = mix(c[:, 0], np.arange(len(c), dtype=np.uint64))
    for i in range(1, ROWS):
        key = mix(key, c[:, i])
    return key.view(np.int64)


def _info(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        out = {f.name: [] for f in INFO}
        for doc_id, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "text"))):
            n, digest, packed = 0, None, None
            if words := words_of(text):
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                n = known.get(digest)
                if n is None:  # of a task's copies the first one is sketched
                    if len(known) >= MEMO:
                        known.clear()
                    s = shingle_set(words)
                    known[digest] = n = len(s)
                    packed = bands(s).tobytes()
            for k, v in zip(out, (doc_id, own, n, digest, packed)):
                out[k].append(v)
        yield from as_table(INFO, **out).to_batches()
    forget_words()


# -- groups, what they send and what they hear ------------------------------------


def group_of(n_groups: int):
    """A class's group, as a column and as ``group_in`` for numpy."""
    return F.pmod(F.col("rep").bitwiseXOR(F.shiftright("rep", 33) * F.lit(7919).cast("long")), F.lit(n_groups).cast("long")).cast("int")


def group_in(rep: np.ndarray, n_groups: int) -> np.ndarray:
    return (rep ^ ((rep >> 33) * 7919)) % n_groups


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Of ``n`` lists; ``rows``, in order, says which list a value belongs to."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64)))


def said(pid: int, bucket: np.ndarray, n_buckets: int, *columns: np.ndarray) -> pa.Table:
    out = list(pack(bucket.astype(np.int64), n_buckets, *columns))
    return as_table(SAID, bucket=[b for b, _ in out], pid=[pid] * len(out), items=[x for _, x in out])


def meeting(width: int, summary):
    """The reduce side of an exchange of packed rows of ``width`` words, the first
    a key. ``summary(rows, first, group)``, given rows by key, returns what is to be
    told of each key (a matrix) and of which keys; every group that named a key hears it."""

    def run(t: pa.Table) -> pa.Table:
        give_back()
        blobs, pids = t.column("items").to_pylist(), column(t, "pid")
        rows = unpack(blobs, width)
        src = np.repeat(pids, [len(x) // (8 * width) for x in blobs])
        order = np.argsort(rows[:, 0], kind="stable")
        rows, src = rows[order], src[order]
        first = np.ones(len(rows), bool)
        first[1:] = rows[1:, 0] != rows[:-1, 0]
        group = np.cumsum(first) - 1
        told, keep = summary(rows, np.flatnonzero(first), group)
        on = keep[group]
        rows, src = told[group[on]], src[on]
        order = np.argsort(src, kind="stable")
        rows, src = rows[order], src[order]
        pids, at = np.unique(src, return_index=True)
        return as_table(SAID, bucket=[0] * len(pids), pid=pids, items=[x.tobytes() for x in np.split(rows, at[1:])] if len(pids) else [])

    return run


def _sizes(rows, first, group):
    n = np.add.reduceat(rows[:, 1], first)
    return np.column_stack([rows[first, 0], n]), n > 1


def _pivots(rows, first, group):
    """Rows are key, score, ~rep, shingles of rep, members, shingles of members."""
    best = np.lexsort((rows[:, 2], rows[:, 1], group))[np.append(first[1:], len(rows)) - 1]
    n, weight = np.add.reduceat(rows[:, 4], first), np.add.reduceat(rows[:, 5], first)
    return np.column_stack([rows[first, 0], ~rows[best, 2], rows[best, 3], n, weight]), np.ones(len(first), bool)


def _mixed(rows, first, group):
    lo, hi = np.minimum.reduceat(rows[:, 1], first), np.maximum.reduceat(rows[:, 2], first)
    return rows[first, :1], lo < hi


def heard(t: pa.Table, width: int) -> np.ndarray:
    rows = unpack(t.column("items").to_pylist(), width)
    return rows[np.argsort(rows[:, 0])]


def keys_of(t: pa.Table) -> np.ndarray:
    return unpack(t.column("bands").to_pylist(), BANDS)


def find(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are known, their places in ``known``, which is sorted)"""
    if not len(known):
        return np.zeros(keys.shape, bool), np.zeros(keys.shape, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def say_keys(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        key, n = np.unique(keys_of(t), return_counts=True)
        return said(column(t, "pid")[0] if t.num_rows else 0, key % U(n_buckets), n_buckets, key, n.astype(np.uint64))

    return run


def say_candidates(n_buckets: int):
    def run(t: pa.Table, sizes: pa.Table) -> pa.Table:
        known = heard(sizes, 2)
        if not t.num_rows or not len(known):
            return said(0, np.zeros(0), 1)
        keys, rep, n = keys_of(t), column(t, "rep").astype(np.uint64), column(t, "n").astype(np.uint64)
        hit, at = find(keys, known[:, 0])
        score = np.where(hit, known[at, 1], U(0)).sum(axis=1, dtype=np.uint64)
        row, _ = np.nonzero(hit)
        key = keys[hit]
        order = np.lexsort((~rep[row], score[row], key))
        key, row = key[order], row[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(key)) - 1
        count, weight = np.diff(np.append(first, len(key))).astype(np.uint64), np.add.reduceat(n[row], first)
        key, row = key[last], row[last]
        return said(column(t, "pid")[0], key % U(n_buckets), n_buckets, key, score[row], ~rep[row], n[row], count, weight)

    return run


MET = pa.schema([("pid", pa.int32()), ("rep", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("own", pa.binary()), *((x, pa.list_(pa.int64())) for x in ("pivots", "parts", "serves", "keys", "centres"))])
MET_DDL = "pid int, rep bigint, n bigint, doc_id bigint, own binary, pivots array<bigint>, parts array<bigint>, serves array<bigint>, keys array<bigint>, centres array<bigint>"


def meet(t: pa.Table, told: pa.Table) -> pa.Table:
    """The classes that share a bucket: pivots to compare with and into how many
    parts each one's members are dealt, the numbers of parts in which the class is a
    pivot itself, and its buckets of over two members with their pivots."""
    known = heard(told, 5)
    if not t.num_rows or not len(known):
        return MET.empty_table()
    keys, rep, n = keys_of(t), column(t, "rep"), column(t, "n")
    hit, at = find(keys, known[:, 0])
    t, keys, rep, n, at = (x.filter(pa.array(hit.any(axis=1))) if x is t else x[hit.any(axis=1)] for x in (t, keys, rep, n, at))
    hit = hit[hit.any(axis=1)]
    row, _ = np.nonzero(hit)
    key, at = keys[hit].view(np.int64), at[hit]
    pivot, pivot_n, size, weight = (known[at, i].astype(np.int64) for i in (1, 2, 3, 4))
    parts = (1 << np.ceil(np.log2(np.maximum(weight / np.maximum(PART, TIMES * pivot_n), 1))).astype(np.int64)).astype(np.int64)
    own = pivot == rep[row]
    far = 4 * np.minimum(n[row], pivot_n) < 3 * np.maximum(n[row], pivot_n)
    on = np.flatnonzero(~own & ~far)
    on = on[np.lexsort((-parts[on], pivot[on], row[on]))]
    new = np.ones(len(on), bool)
    new[1:] = (row[on][1:] != row[on][:-1]) | (pivot[on][1:] != pivot[on][:-1])
    on = on[new]
    serves = np.unique(np.column_stack([row[own], parts[own]]), axis=0) if own.any() else np.zeros((0, 2), np.int64)
    big = np.flatnonzero(size > 2)
    m = len(rep)
    columns = {"pivots": lists(row[on], pivot[on], m), "parts": lists(row[on], parts[on], m), "serves": lists(serves[:, 0], serves[:, 1], m), "keys": lists(row[big], key[big], m), "centres": lists(row[big], pivot[big], m)}
    return pa.table({f.name: columns.get(f.name, t.column(f.name) if f.name not in columns else None) for f in MET}).cast(MET)


# -- full sets and comparisons with pivots -------------------------------------------

SETS = pa.schema([("pid", pa.int32()), ("rep", pa.int64()), ("items", pa.binary()), *((x, pa.list_(pa.int64())) for x in ("pivots", "parts", "serves"))])
SETS_DDL = "pid int, rep bigint, items binary, pivots array<bigint>, parts array<bigint>, serves array<bigint>"


def _sets(batches):
    seen = set()  # rows of one doc_id and text, as many as the task holds
    for batch in batches:
        rep = batch.column("rep").to_pylist()
        new = [r not in seen and not seen.add(r) for r in rep]
        t = pa.Table.from_batches([batch]).filter(pa.array(new, pa.bool_()))
        items = [shingle_set(words_of(x)).tobytes() for x in t.column("text").to_pylist()]
        yield from pa.table({f.name: pa.array(items, f.type) if f.name == "items" else t.column(f.name) for f in SETS}).cast(SETS).to_batches()
    forget_words()


DEALT = pa.schema([("vid", pa.int32()), ("pivot", pa.int64()), ("part", pa.int64()), ("rep", pa.int64()), ("items", pa.binary())])
DEALT_DDL = "vid int, pivot bigint, part bigint, rep bigint, items binary"


def deal(n_groups: int):
    """Rows for comparisons: each member in its part of each pivot, each pivot in
    all of its parts. Parts of a pivot dealt in S are numbered from S up."""

    def run(batches):
        for batch in batches:
            rows = []
            for rep, items, pivots, parts, serves in zip(*(batch.column(c).to_pylist() for c in ("rep", "items", "pivots", "parts", "serves"))):
                code = rep * 0x9E3779B1 >> 7
                rows += [(p, s + code % s, rep, items) for p, s in zip(pivots, parts)]
                rows += [(rep, k, rep, items) for s in serves for k in range(s, 2 * s)]
                if len(rows) > 4096:
                    yield from tabled(rows)
                    rows = []
            yield from tabled(rows)

    def tabled(rows):
        pivot, part = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        vid = mix(pivot.view(np.uint64), part.view(np.uint64)) % U(n_groups)
        return as_table(DEALT, vid=vid.astype(np.int32), pivot=pivot, part=part, rep=[r[2] for r in rows], items=[r[3] for r in rows]).to_batches()

    return run


KNOWN = pa.schema([("pivot", pa.int64()), ("rep", pa.int64()), ("linked", pa.bool_()), ("distance", pa.float64())])
KNOWN_DDL = "pivot bigint, rep bigint, linked boolean, distance double"


def _compare(t: pa.Table) -> pa.Table:
    give_back()
    pivot, part, rep = (column(t, c) for c in ("pivot", "part", "rep"))
    blobs = t.column("items").to_pylist()
    order = np.lexsort((rep != pivot, part, pivot))  # the pivot stands first in its part
    new = np.ones(len(order), bool)
    new[1:] = (pivot[order][1:] != pivot[order][:-1]) | (part[order][1:] != part[order][:-1])
    out = []
    for rows in np.split(order, np.flatnonzero(new)[1:]):
        centre = np.frombuffer(blobs[rows[0]], np.uint64)
        members = {int(rep[i]): i for i in rows if rep[i] != pivot[i]}
        if not members:
            continue
        sets = [np.frombuffer(blobs[i], np.uint64) for i in members.values()]
        n = np.array([len(x) for x in sets])
        hit, _ = find(np.concatenate(sets), centre)
        both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        any_ = n + len(centre) - both
        out += zip([int(pivot[rows[0]])] * len(n), members, (100 * both >= 75 * any_).tolist(), (1 - both / any_).tolist())
    return as_table(KNOWN, **{f.name: [r[i] for r in out] for i, f in enumerate(KNOWN)})


# -- components ----------------------------------------------------------------------

STEP = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("items", pa.binary()), ("changed", pa.int64())])
STEP_DDL = "pid int, kind int, items binary, changed bigint"
PARENTS, HOOK, ASK, ANSWER = range(4)


def settled(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (vertex, parent) rows: each vertex with its least parent, and the other
    parents with that one as theirs, so nothing comes apart."""
    if not len(pairs):
        return pairs, pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:, 0] != pairs[:-1, 0]
    least = pairs[first]
    rest = np.column_stack([pairs[:, 1], least[np.cumsum(first) - 1, 1]])[~first]
    rest = rest[(rest[:, 0] != rest[:, 1]) & (rest[:, 0] != pairs[~first, 0])]
    return least, np.unique(rest, axis=0) if len(rest) else rest


def messages(n_groups: int, kind: int, rows: np.ndarray, to: np.ndarray | None = None) -> list[tuple]:
    to = group_in(rows[:, 0], n_groups) if to is None else to
    return [(b, kind, x, 0) for b, x in pack(to, n_groups, *rows.T)]


def hooks(n_groups: int):
    def run(batches):
        held, size = [], 0

        def flush():
            pairs = np.concatenate(held)
            while True:  # a vertex leaves with one parent, whatever its degree
                least, rest = settled(pairs)
                if not len(rest):
                    break
                pairs = np.concatenate([least, rest])
            rows = messages(n_groups, HOOK, least)
            return as_table(STEP, **{f.name: [r[i] for r in rows] for i, f in enumerate(STEP)}).to_batches()

        for batch in batches:
            a, b = column(batch, "a"), column(batch, "b")
            held.append(np.column_stack([np.maximum(a, b), np.minimum(a, b)]))
            size += len(a)
            if size > 1 << 20:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def step(n_groups: int):
    """One step of a group: parents of its vertices and messages in, the same out."""

    def run(t: pa.Table) -> pa.Table:
        pid, kind, blobs = column(t, "pid")[0], column(t, "kind"), t.column("items").to_pylist()
        rows = [unpack([x for x, k in zip(blobs, kind) if k == which], 2).view(np.int64) for which in range(4)]
        before = rows[PARENTS]
        before = before[np.argsort(before[:, 0])]
        now = before.copy()
        answers = rows[ANSWER][np.argsort(rows[ANSWER][:, 0])]
        hit, at = find(now[:, 1], answers[:, 0])
        now[hit, 1] = answers[at[hit], 1]
        asked = rows[ASK]
        own = np.unique(asked[:, 0])
        hit, _ = find(own, now[:, 0])
        own = np.column_stack([own, own])[~hit]
        now, rest = settled(np.concatenate([now, rows[HOOK], own]))
        _, at = find(asked[:, 0], now[:, 0])
        answer = np.column_stack([asked[:, 0], now[at, 1]]) if len(asked) else asked
        moved = answer[:, 0] != answer[:, 1]
        up = np.unique(now[now[:, 0] != now[:, 1], 1])
        out = messages(n_groups, HOOK, rest) + messages(n_groups, ASK, np.column_stack([up, np.full(len(up), pid)]))
        out += messages(n_groups, ANSWER, answer[moved], asked[moved, 1])
        # roots that are asked for the first time are no change
        old = now[find(now[:, 0], before[:, 0])[0] | (now[:, 0] != now[:, 1])]
        same = len(old) == len(before) and (old == before).all()
        out.append((pid, PARENTS, now.tobytes(), len(rest) + int(moved.sum()) + (not same)))
        return as_table(STEP, **{f.name: [r[i] for r in out] for i, f in enumerate(STEP)})

    return run


def parents(edges: DataFrame, scratch: Scratch, name: str, n_groups: int) -> DataFrame:
    """Packed (pid, kind, items) of (vertex, least vertex that it reaches), written as
    ``name``. Groups hold a parent for each vertex, never a greater one. Each step
    hooks parents that a vertex has besides its least one to that one, and puts the
    parent's parent in a parent's place. It ends with a step in which no parent
    changes and every parent, asked the step before, answers that it is a root."""
    n = max(1, partitions(edges.sparkSession) // 4)  # a vertex is some bytes only
    state = edges.select("a", "b").where("a <> b").mapInArrow(hooks(n_groups), STEP_DDL)
    i, changed = 0, True
    while changed:
        state = scratch.put(state.repartition(n, "pid").groupBy("pid").applyInArrow(step(n_groups), STEP_DDL), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
        changed = state.agg(F.sum("changed")).first()[0] or 0
        i += 1
    return state.where(F.col("kind") == PARENTS).select("pid", "kind", "items")


def roots_of(state: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = unpack(batch.column("items").to_pylist(), 2).view(np.int64)
            yield pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["v", "root"])

    return state.mapInArrow(run, "v bigint, root bigint")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(v, root) for every vertex of an edge between two vertices; root is the least
    vertex that v reaches. Vertices are integers from 0."""
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    return roots_of(parents(edges, Scratch(edges.sparkSession, "components"), "step", number_of_groups(edges.sparkSession)))


# -- buckets that hold several components ---------------------------------------------

OPEN = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("keys", pa.list_(pa.int64())), ("centres", pa.list_(pa.int64()))])
OPEN_DDL = "rep bigint, n bigint, root bigint, keys array<bigint>, centres array<bigint>"


def flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the values of a list column."""
    x = t.column(name).combine_chunks()
    n = x.value_lengths().to_numpy()
    return np.repeat(np.arange(len(x)), n), x.flatten().to_numpy()


def rooted(rep: np.ndarray, told: pa.Table) -> np.ndarray:
    known = heard(told.filter(pa.array(column(told, "kind") == PARENTS)), 2).view(np.int64)
    hit, at = find(rep, known[:, 0])
    return np.where(hit, known[at, 1], rep) if len(known) else rep


def say_roots(n_buckets: int):
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return said(0, np.zeros(0), 1)
        root = rooted(column(t, "rep"), told).astype(np.uint64)
        row, key = flat(t, "keys")
        key, row = key.view(np.uint64), row
        order = np.lexsort((root[row], key))
        key, root = key[order], root[row][order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(key)) - 1
        return said(column(t, "pid")[0], key[first] % U(n_buckets), n_buckets, key[first], root[first], root[last])

    return run


def open_(t: pa.Table, told: pa.Table) -> pa.Table:
    if not t.num_rows:
        return OPEN.empty_table()
    rep = column(t, "rep")
    mixed = heard(told.filter(pa.array(column(told, "kind") != PARENTS)), 1)[:, 0]
    row, key = flat(t, "keys")
    _, centre = flat(t, "centres")
    hit, _ = find(key.view(np.uint64), mixed)
    row, key, centre = row[hit], key[hit], centre[hit]
    some = np.unique(row)
    at = np.searchsorted(some, row)
    return pa.table([pa.array(rep[some]), pa.array(column(t, "n")[some]), pa.array(rooted(rep, told)[some]), lists(at, key, len(some)), lists(at, centre, len(some))], schema=OPEN)


def bucket_edges(u: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where the buckets of sorted 64-bit values begin and end: ranges of values."""
    return np.searchsorted(u >> U(32), (np.arange(1, n_buckets, dtype=np.uint64) << U(32)) // U(n_buckets))


def say_items(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        u = np.unique(unpack(t.column("items").to_pylist(), 1)[:, 0])
        parts = np.split(u, bucket_edges(u, n_buckets))
        some = [b for b, x in enumerate(parts) if len(x)]
        return as_table(SAID, bucket=some, pid=[column(t, "pid")[0]] * len(some), items=[parts[b].tobytes() for b in some])

    return run


def _common(t: pa.Table) -> pa.Table:
    """For each group's items, in their order, a bit that tells if another group has them."""
    blobs = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
    u, n = np.unique(np.concatenate(blobs), return_counts=True)
    u = u[n > 1]
    return as_table(SAID, bucket=column(t, "bucket"), pid=column(t, "pid"), items=[np.packbits(find(x, u)[0]).tobytes() for x in blobs])


ALIKE = pa.schema([*OPEN, ("items", pa.binary())])
ALIKE_DDL = OPEN_DDL + ", items binary"


def alike(n_buckets: int):
    """The classes that can have a link, with the shingles that others have too."""

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return ALIKE.empty_table()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        u, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        bits = dict(zip(told.column("bucket").to_pylist(), told.column("items").to_pylist()))
        shared = np.zeros(len(u), bool)
        edges = np.concatenate([[0], bucket_edges(u, n_buckets), [len(u)]])
        for b, x in bits.items():
            lo, hi = edges[b], edges[b + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(x, np.uint8), count=hi - lo)
        shared |= n > 1
        size = np.array([len(x) for x in sets])
        left = [x[on] for x, on in zip(sets, np.split(shared[at], np.cumsum(size)[:-1]))]
        keep = 4 * np.array([len(x) for x in left]) >= 3 * size
        t = t.set_column(t.column_names.index("items"), "items", pa.array([x.tobytes() for x in left], pa.binary()))
        return t.filter(pa.array(keep)).select(ALIKE.names).cast(ALIKE)

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links_between(left, right, rep, root, n, far, sets) -> list[tuple[int, int]]:
    """Pairs of roots to join: of links between two lists of members (places in the
    arrays) in different components, as many as join the components."""
    s = np.array([len(x) for x in sets])
    x, y = left[:, None], right[None, :]
    may = (root[x] != root[y]) & ~(np.abs(far[x] - far[y]) > 0.25 + 1e-9) & (7 * np.minimum(s[x], s[y]) >= 3 * (n[x] + n[y]))
    may &= (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
    out = []
    if may.any():
        left, right, may = left[may.any(axis=1)], right[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
        h, of = np.concatenate([sets[k] for k in right]), np.repeat(np.arange(len(right)), s[right])
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        both = np.zeros(may.shape, np.int64)
        for k, m in enumerate(left):
            lo, hi = np.searchsorted(h, sets[m], "left"), np.searchsorted(h, sets[m], "right")
            c = hi - lo
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
            both[k] = np.bincount(of[at], minlength=len(right))
        linked = may & (100 * both >= 75 * (n[left][:, None] + n[right][None, :] - both))
        own: dict[int, int] = {}

        def top(v):
            while own.setdefault(v, v) != v:
                v = own[v]
            return v

        for k, m in zip(*np.nonzero(linked)):
            a, b = top(int(root[left[k]])), top(int(root[right[m]]))
            if a != b:
                own[a] = b
                out.append((a, b))
    return out


def _search(t: pa.Table) -> pa.Table:
    key, i, j, block, rep, root, n = (column(t, c) for c in ("key", "i", "j", "block", "rep", "root", "n"))
    far = column(t, "distance").astype(float)
    sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
    order = np.lexsort((rep, j, i, key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, i, j)], axis=0)
    out = set()
    for at in np.split(order, np.flatnonzero(new)[1:]):
        left, right = at[block[at] == i[at[0]]], at[block[at] == j[at[0]]]
        if len(left) and len(right):
            out.update(links_between(left, right, rep, root, n, far, sets))
    return as_table(LINKS, a=[x[0] for x in out], b=[x[1] for x in out])


def further_links(scratch: Scratch, met: DataFrame, sets: DataFrame, known: DataFrame, state: DataFrame, n_groups: int) -> DataFrame | None:
    """Pairs of components to join by links that no comparison with a pivot shows."""
    n = partitions(scratch.spark)
    buckets = max(1, n // 2)
    some = met.where(F.size("keys") > 0).select("pid", "rep", "n", "keys", "centres").repartition(n, "pid").groupBy("pid")
    state = state.select("pid", "kind", "items").repartition(n, "pid")
    mixed = some.cogroup(state.groupBy("pid")).applyInArrow(say_roots(buckets), SAID_DDL).groupBy("bucket").applyInArrow(meeting(3, _mixed), SAID_DDL)
    told = state.unionByName(mixed.select("pid", F.lit(9).alias("kind"), "items").repartition(n, "pid"))
    opened = some.cogroup(told.groupBy("pid")).applyInArrow(open_, OPEN_DDL)

    full = sets.select("pid", "rep", "items").join(opened.hint("shuffle_hash"), "rep").repartition(n, "pid").groupBy("pid")
    common = full.applyInArrow(say_items(buckets), SAID_DDL).groupBy("bucket").applyInArrow(_common, SAID_DDL)
    left = scratch.put(full.cogroup(common.repartition(n, "pid").groupBy("pid")).applyInArrow(alike(buckets), ALIKE_DDL), "alike")

    # the pivot is compared with all; what is left of a bucket matters while it
    # holds two components
    of = left.select("rep", "root", F.explode(F.arrays_zip("keys", "centres")).alias("x")).select("rep", "root", F.col("x.keys").alias("key"), F.col("x.centres").alias("pivot")).where("rep <> pivot")
    still = scratch.put(of.groupBy("key").agg(F.count("*").alias("left"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "left"), "still")
    if still.isEmpty():
        scratch.drop("alike", "still")
        return None
    of = of.join(still, "key").withColumn("blocks", F.ceil(F.col("left") / BLOCK).cast("int"))
    of = of.join(known.select("pivot", "rep", "distance"), ["pivot", "rep"], "left")
    of = of.select("key", "rep", "distance", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    of = of.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    of = of.join(left.select("rep", "root", "n", "items"), "rep").withColumn("vid", F.pmod(F.xxhash64("key", "i", "j"), F.lit(2 * n_groups)).cast("int"))
    found = scratch.put(of.repartition(n, "vid").groupBy("vid").applyInArrow(_search, "a bigint, b bigint"), "found")
    scratch.drop("alike", "still")
    return None if found.isEmpty() else found


# -- the whole ------------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_shingles, component_id (the
    least doc_id that links reach) and kept (the row stands for its class)."""
    return classes(docs).drop("own")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, rows of one doc_id and text once; rows that have
    neither doc_id nor words are all kept. Texts are exchanged once."""
    def keyed(df):
        return df.select(F.coalesce("doc_id", F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("own", F.unhex(F.lit(""))).alias("own_key"), "*")

    names = docs.columns
    alone = (F.col("doc_id").isNull() & (F.col("n_shingles") == 0)).alias("alone")
    kept = keyed(classes(docs)).where("kept").select("id_key", "no_id", "own_key", alone).distinct()
    out = keyed(docs.withColumn("own", own())).join(kept, ["id_key", "no_id", "own_key"])
    out = out.withColumn("alone", F.when(F.col("alone"), F.monotonically_increasing_id()))
    return out.dropDuplicates(["id_key", "no_id", "own_key", "alone"]).select(*names)


def own():
    """Names a text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def classes(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with ``own``, the hash of each row's text."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "near"), partitions(spark)
    docs = docs.select("doc_id", own().alias("own"), "text")
    info = scratch.put(docs.mapInArrow(frugal(_info), INFO_DDL).withColumn("row", F.monotonically_increasing_id()), "info")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "own")).alias("first")
    one = info.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"), F.max("n_shingles").alias("n"), F.max("bands").alias("bands"), first)
    reps = scratch.put(one, "reps")

    groups, buckets = number_of_groups(spark, reps.count()), max(1, n // 2)
    each = reps.select(group_of(groups).alias("pid"), "rep", "n", "bands", "first.doc_id", "first.own").repartition(n, "pid").groupBy("pid")
    sizes = each.applyInArrow(say_keys(buckets), SAID_DDL).groupBy("bucket").applyInArrow(meeting(2, _sizes), SAID_DDL).repartition(n, "pid")
    pivots = each.cogroup(sizes.groupBy("pid")).applyInArrow(say_candidates(buckets), SAID_DDL).groupBy("bucket").applyInArrow(meeting(6, _pivots), SAID_DDL).repartition(n, "pid")
    met = scratch.put(each.cogroup(pivots.groupBy("pid")).applyInArrow(meet, MET_DDL), "met")

    wanted = met.select("pid", "rep", "pivots", "parts", "serves", F.col("doc_id").alias("its_id"), F.col("own").alias("its_own")).hint("shuffle_hash")
    full = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("own") == F.col("its_own"))).select("pid", "rep", "text", "pivots", "parts", "serves")
    sets = scratch.put(full.mapInArrow(frugal(_sets), SETS_DDL), "sets")
    dealt = sets.mapInArrow(frugal(deal(groups)), DEALT_DDL).repartition(n, "vid")
    known = scratch.put(dealt.groupBy("vid").applyInArrow(_compare, KNOWN_DDL), "known")

    state = parents(known.where("linked").select(F.col("pivot").alias("a"), F.col("rep").alias("b")), scratch, "tree", groups)
    more = further_links(scratch, met, sets, known, state, groups)
    scratch.drop("met", "sets", "known")
    roots = roots_of(state)
    if more is not None:
        joined = roots_of(parents(more, scratch, "joined", groups)).select(F.col("v").alias("root"), F.col("root").alias("top"))
        # roots that no link with a pivot has reached are vertices too
        roots = roots.join(joined, "root", "left").select("v", F.coalesce("top", "root").alias("root")).unionByName(joined.select(F.col("root").alias("v"), F.col("top").alias("root")))
        roots = roots.distinct()
    named = reps.select("digest", "rep", "first").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("digest", "first", F.coalesce("root", "rep").alias("root"))
    # written, so the join with it can split the rows of a large component
    least = scratch.put(named.groupBy("root").agg(F.min("first").alias("named")), "least")
    named = named.select("digest", "root").join(least, "root").select("digest", "named")
    out = info.select("doc_id", "own", "n_shingles", "digest").join(named, "digest", "left")
    kept = F.col("digest").isNull() | (F.col("doc_id").eqNullSafe(F.col("named.doc_id")) & (F.col("own") == F.col("named.own")))
    return out.select("doc_id", "own", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("named.doc_id")).alias("component_id"), kept.alias("kept"))
