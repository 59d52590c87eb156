"""Telephony audio columns: mu-law, A-law and ADPCM, expanded to PCM.

``store`` wraps bytes as 8-bit mu-law samples of a WAVE file, without loss.
``expand`` reads such a file back, expands its samples by lookup tables, decodes
4-bit ADPCM blocks (all blocks of a batch at once, one numpy step per sample of
a block) and resamples PCM. ``describe`` gives the figures of a stored file.

Null and empty texts are 64 zero bytes. Equal texts and repeated rows give equal
files. Very long texts are handled whole; what is decoded at once is bounded by
``PART_BYTES`` or one text. Empty tables give empty results. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandgraph.llm.common import as_table, to_bytes

UNIT = 64
RATE, TARGET = 8000, 16000
MULAW, ALAW = 7, 6

# Fixed values of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
STEP_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    v = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -v, v).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    low, seg = (a & 15) << 4, (a >> 4) & 7
    v = np.where(seg == 0, low + 8, low + 264 << np.maximum(seg - 1, 0))
    return np.where(a & 128, v, -v).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = to_bytes(text)
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wave(samples: bytes, law: int = MULAW, rate: int = RATE) -> bytes:
    """A WAVE file of one channel of 8-bit companded samples."""
    pad = b"\0" * (len(samples) & 1)
    body = b"WAVE" + struct.pack("<4sIHHIIHHH", b"fmt ", 18, law, 1, rate, rate, 1, 8, 0) + struct.pack("<4sII", b"fact", 4, len(samples))
    body += struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwave(media: bytes) -> tuple[int, int, bytes]:
    """(law, rate, samples) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, law, rate, data = 12, 0, 0, b""
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            law, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return law, rate, data


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of mono IMA ADPCM blocks (rows of bytes): a header of the
    first sample and step index, then two samples a byte, low half first."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0], value = head, head
    for i, code in enumerate(codes):
        step, size = STEPS[index], code & 7
        move = step >> 3
        move += np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + STEP_MOVES[size], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """PCM at another rate by linear interpolation in whole numbers."""
    n = len(pcm) * target // rate
    if target % rate == 0:
        up = target // rate
        x = pcm.astype(np.int32)
        nxt = np.append(x[1:], x[-1:])
        out = np.empty((len(x), up), np.int16)
        for k in range(up):
            out[:, k] = (x * (up - k) + nxt * k) // up
        return out.ravel()
    at = np.arange(n, dtype=np.int64) * rate
    i, part = at // target, at % target
    x = pcm.astype(np.int64)
    return ((x[i] * (target - part) + x[np.minimum(i + 1, len(x) - 1)] * part) // target).astype(np.int16)


#: Bytes of media that are decoded at once.
PART_BYTES = 8 << 20
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FIGURES = pa.schema([*STORED, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the padded UTF-8 bytes as a mu-law WAVE file."""

    def run(batches):
        for b in batches:
            n = [payload_of(t) for t in b.column("text").to_pylist()]
            yield from as_table(STORED, doc_id=b.column("doc_id").to_pylist(), n_bytes=[x for x, _ in n], media=[wave(p) for _, p in n]).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def expand(media: bytes, target: int = TARGET) -> bytes:
    """Resampled little-endian 16-bit PCM of a stored file."""
    law, rate, data = unwave(media)
    return resample(TABLES[law][np.frombuffer(data, np.uint8)], rate, target).astype("<i2").tobytes()


def expanded(stored: DataFrame, target: int = TARGET) -> DataFrame:
    """``stored`` with ``pcm``, the resampled PCM of ``media``."""

    def run(batches):
        for b in batches:
            yield from pa.Table.from_batches([b]).append_column("pcm", pa.array([None if m is None else expand(m, target) for m in b.column("media").to_pylist()], pa.binary())).to_batches()

    stored = stored.drop("pcm")
    return stored.mapInArrow(run, stored.selectExpr("*", "cast(null as binary) as pcm").schema)


def parts(batches, size: int = PART_BYTES):
    """The batches in parts of rows whose media have about ``size`` bytes, so what is
    decoded at once is bounded, but for a single larger file."""
    for b in batches:
        ends = np.cumsum([len(m) for m in b.column("media").to_pylist()], dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def describe(stored: DataFrame) -> DataFrame:
    """``stored`` with figures of the samples that are read back from ``media``:
    size, hashes, and ``feature``: mean square and sign changes of the mu-law
    PCM, and CRC-32 of the A-law, ADPCM and resampled PCM."""

    def run(batches):
        for b in parts(batches):
            media = b.column("media").to_pylist()
            data = [unwave(m) for m in media]
            whole = np.frombuffer(b"".join(d for _, _, d in data), np.uint8).reshape(-1, UNIT)
            decoded = adpcm(whole) if len(whole) else whole
            at, out = 0, {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "feature")}
            for law, rate, d in data:
                x = np.frombuffer(d, np.uint8)
                pcm, n = TABLES[law][x], len(d) // UNIT
                power = int(np.square(pcm.astype(np.int64)).mean())
                turns = int(np.count_nonzero(np.diff(pcm < 0)))
                own = decoded[at : at + n]
                at += n
                feature = f"rms2={power};turns={turns};alaw={zlib.crc32(TABLES[ALAW][x].tobytes()):08x};adpcm={zlib.crc32(np.ascontiguousarray(own)):08x};pcm{TARGET}={zlib.crc32(resample(pcm, rate, TARGET)):08x}"
                for k, v in zip(out, (len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-UNIT:]), feature)):
                    out[k].append(v)
            yield from as_table(FIGURES, doc_id=b.column("doc_id").to_pylist(), n_bytes=b.column("n_bytes").to_pylist(), media=media, **out).to_batches()

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string")
