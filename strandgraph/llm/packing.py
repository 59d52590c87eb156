"""Best-two-fit packing of token sequences.

Texts are tokenised whole, word by word: white space always ends a token of
this vocabulary, so the ids of each distinct word are looked up once and the
ids of a text are gathered. Documents longer than ``LENGTH`` are cut into
pieces of that length. Pieces are dealt by hash into groups of ``SEQUENCES``
sequences, and each group is packed on its own: a sequence takes the longest piece that is left, then again
and again the longest that fits; when none fits, its smallest piece gives way
to the two unpacked pieces that fill the widened gap best, if they fill it
better. A group's last sequences stay unfilled, so few large groups lose little;
their size goes by the tokens, not by the session's partitions. Only lengths and
checksums are shuffled.

Null and empty texts are the single id 0. Repeated rows are packed each on its
own. Ties go to the lower doc_id and piece. Very long texts are tokenised whole.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import Scratch, as_table, frugal, grouped

LENGTH = 2048
#: Sequences that a group fills, about.
SEQUENCES = 500
END = 0
VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT = 800_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED_DDL = PIECES_DDL + ", sequence_id bigint, offset bigint"
#: Byte-level vocabularies write bytes that are no printable Latin-1 character as
#: the characters from 256 on, in order; the space between words is kept.
_UNPRINTABLE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_UNPRINTABLE) if b != 32}
_SPACES = str.maketrans("\n\t\r", "   ")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(starts - ends + sizes, sizes)


class Codes(dict):
    """Numbers of words; ``new`` gathers those that have no ids yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordTokenizer:
    """Ids of texts through a memo of words, emptied at ``WORDS_KEPT`` words.

    The vocabulary lower-cases, so Latin-1 texts are lower-cased first and more
    words are alike. Letters and what follows them are tokenised apart, so a
    word with a closing "," or "." is put together from its parts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        # for words that are lower-case letters already: the same model without
        # normaliser and expressions, which then have nothing to do
        bare = json.loads(self.of.to_str())
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.closing = {c: np.array(self.ids_of(c), np.uint32) for c in ",."}
        vocabulary = self.of.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def ids_of(self, text: str) -> list[int]:
        return self.of.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def bare_ids(self, words: list[str]) -> list[int]:
        text = " ".join(words)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.ids_of(text)
        return self.bare.encode_batch_fast([text.encode().decode("latin-1").translate(BYTE_LETTERS)], add_special_tokens=False)[0].ids

    def clear(self):
        self.code = Codes()
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.n = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    def put(self, codes: np.ndarray, ids: np.ndarray, n: np.ndarray):
        while len(self.code) > len(self.at):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.at[codes], self.n[codes] = self.used + np.cumsum(n) - n, n
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self):
        """Ids of the new words: of those of letters from one string, by the
        ends of words in it."""
        plain, closed, other = [], {c: [] for c in self.closing}, []
        for w in self.code.new:
            if w.islower() and w.isalpha():
                plain.append(w)
            elif w[-1:] in self.closing and w.islower() and w[:-1].isalpha():
                closed[w[-1]].append(w)
                if w[:-1] not in self.code:
                    self.code[w[:-1]] = len(self.code)
                    plain.append(w[:-1])
            else:
                other.append(w)
        self.code.new.clear()
        code = self.code
        numbers = lambda words: np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        for part in range(0, len(plain), 512):
            some = plain[part : part + 512]
            ids = np.array(self.bare_ids(some), np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            self.put(numbers(some), ids, np.diff(ends, prepend=-1))
        if other:
            each = [x.ids for x in self.of.encode_batch_fast(other, add_special_tokens=False)]
            self.put(numbers(other), np.array(list(chain.from_iterable(each)), np.uint32), np.fromiter(map(len, each), np.int64, len(each)))
        for c, own in closed.items():
            if own:
                base = numbers([w[:-1] for w in own])
                n, more = self.n[base], len(self.closing[c])
                ids = np.empty(n.sum() + more * len(own), np.uint32)
                starts = np.cumsum(n + more) - n - more
                ids[_ragged(starts, n)] = self.ids[_ragged(self.at[base], n)]
                ids[_ragged(starts + n, np.full(len(own), more, np.int32))] = np.tile(self.closing[c], len(own))
                self.put(numbers(own), ids, n + more)

    def split(self, text: str) -> list[str]:
        try:
            if not text.isascii():
                text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return (text.translate(_SPACES) if "\t" in text or "\r" in text else text.replace("\n", " ")).split(" ")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > WORDS_KEPT:
            self.clear()
        code = self.code
        lists = [self.split(t) for t in texts]
        codes = [np.fromiter(map(code.__getitem__, words), np.int32, len(words)) for words in lists]
        if code.new:
            self.learn()
        return [self.ids[_ragged(self.at[c], self.n[c])] for c in codes]


@functools.lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker, so that its memo outlives a task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of every text: place, length and checksum of the ids."""

    def run(batches):
        import public_tokenizers

        tokenizer = tokenizer_of(path or public_tokenizers.path(VOCABULARY))
        for b in batches:
            out = {f.name: [] for f in PIECES}
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokenizer.encode_batch(texts)):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    for name, v in zip(out, (doc_id, k, start, len(part), zlib.crc32(part))):
                        out[name].append(v)
            yield from as_table(PIECES, **out).to_batches()

    return docs.select("doc_id", "text").mapInArrow(frugal(run), PIECES_DDL)


class Pool:
    """Unpacked pieces by length."""

    def __init__(self, lengths: list[int]):
        self.of: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            self.of.setdefault(lengths[i], []).append(i)
        self.sizes = sorted(self.of)

    def fitting(self, gap: int) -> int:
        i = bisect_right(self.sizes, gap)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int) -> int:
        i = self.of[size].pop()
        if not self.of[size]:
            del self.of[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return i

    def put(self, size: int, i: int):
        if size not in self.of:
            self.of[size] = []
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.of[size].append(i)

    def two(self, gap: int, least: int) -> tuple[int, int]:
        """The two sizes whose sum is greatest in (least, gap], or (0, 0)."""
        best, pair = least, (0, 0)
        lo, hi = 0, bisect_right(self.sizes, gap) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > gap or (lo == hi and len(self.of[a]) < 2):
                hi -= 1
                continue
            if a + b > best:
                best, pair = a + b, (b, a)
                if best == gap:
                    break
            lo += 1
        return pair


def best_two_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of piece numbers; every length is between 1 and ``room``."""
    pool, bins = Pool(lengths), []
    while pool.sizes:
        own = [(size := pool.sizes[-1], pool.take(size))]
        gap = room - own[0][0]
        while gap and (size := pool.fitting(gap)):
            own.append((size, pool.take(size)))
            gap -= size
        if gap:
            small = own[-1]
            a, b = pool.two(gap + small[0], small[0])
            if a:
                own.pop()
                own += [(a, pool.take(a)), (b, pool.take(b))]
                pool.put(*small)
        bins.append([i for _, i in own])
    return bins


def packed(cut: DataFrame, length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """``cut``, rows of ``pieces``, each with its sequence and its place there.

    Pieces are written and their ids counted first; then groups, by hash, are sized
    to fill about ``sequences`` sequences each, whatever the number of partitions."""
    spark = cut.sparkSession
    cut = Scratch(spark, "pieces").put(cut, "cut")
    n = -(-(cut.agg(F.sum("length")).first()[0] or 0) // (length * sequences)) or 1

    def run(t: pa.Table) -> pa.Table:
        pid = t.column("pid")[0].as_py()
        t = t.drop_columns(["pid"]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = t.column("length").to_pylist()
        seq, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, own in enumerate(best_two_fit(sizes, length)):
            at = 0
            for i in own:
                seq[i], offset[i] = (pid << 40) + k, at
                at += sizes[i]
        return t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset)).cast(PACKED)

    return grouped(cut, n, "doc_id", "piece", "ids_crc32").groupBy("pid").applyInArrow(run, PACKED_DDL)
