"""Quality classifier: a linear SVM on naive Bayes features.

Features of a text are indicators of its byte trigrams (hashed to ``TRIGRAMS``
places) and of n-grams over its repetition marks: whether a word equals the
word before it or the one before that, and whether a line equals the line
before it. Each indicator is scaled by the log-count ratio of the two classes,
and a linear hinge-loss model (L2-regularised, squared hinge off) is fitted by
dual coordinate descent. A logistic curve, fitted on rows that the model has
not seen, turns margins into scores.

The fit uses a bounded sample: at most ``MAX_ROWS`` labelled rows, the first
by a hash of their id, and of these the first whose features have at most
``MAX_PLACES`` places together. The model is one array of fixed size. Scoring covers
whole texts and every row, and reads nothing but the text.

Null and empty texts have no features and get the model's score for none. Rows
without a label, or with a null one, take no part in the fit; of several labels
of one doc_id the least counts, of several texts too. If one class is missing, every score is the
share of the other. Repeated rows and ties score alike, very
long texts are read whole. Empty tables give empty results, or where nothing is
labelled a score of 0.5. Other columns are ignored or passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import U, as_table, frugal, to_bytes

TRIGRAMS = 1 << 17
MARKS = 2 * 4 + 16 + 64 + 4
SIZE = TRIGRAMS + MARKS
MAX_ROWS = 8000
MAX_PLACES = 1 << 26
ACCEPT = 0.3
FOLDS = 5
_MUL = U(0x9E3779B97F4A7C15)


def _marks(raw: bytes) -> list[int]:
    words = raw.split()
    out = []
    if len(words) > 2:
        code = np.fromiter(map(hash, words), np.int64, len(words))
        one = np.zeros(len(code), np.int64)
        one[1:] = code[1:] == code[:-1]
        one[2:] += 2 * (code[2:] == code[:-2])
        base = 0
        for n in (1, 2, 3):
            gram = np.zeros(max(len(one) - n + 1, 0), np.int64)
            for i in range(n):
                gram = gram * 4 + one[i : i + len(gram)]
            out += (base + np.flatnonzero(np.bincount(gram, minlength=4**n))).tolist()
            base += 4**n
    lines = raw.split(b"\n")
    same = [a == b and bool(a.strip()) for a, b in zip(lines, lines[1:])]
    if any(same):
        out.append(84)
    if any(a and b for a, b in zip(same, same[1:])):
        out.append(85)
    return [TRIGRAMS + x for x in out]


def features(text: str | None) -> np.ndarray:
    """Sorted places of the indicators of a text that are set."""
    raw = to_bytes(text)
    if len(raw) < 3:
        return np.array(_marks(raw), np.int32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    at = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(15)
    if len(at) < 6000:
        at = np.unique(at)
    else:
        on = np.zeros(TRIGRAMS, bool)
        on[at] = True
        at = np.flatnonzero(on)
    return np.concatenate([at.astype(np.int32), np.array(_marks(raw), np.int32)])


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = {c: np.ones(SIZE) for c in (1, -1)}
    for at, c in zip(rows, y):
        count[c][at] += 1
    p, q = count[1] / count[1].sum(), count[-1] / count[-1].sum()
    return np.log(p / q)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, passes: int = 12, seed: int = 0):
    """(weights, bias) of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)),
    where x_i has ``scale`` at the places of row i; the bias is a feature."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    norm = np.array([np.square(scale[at]).sum() + 1.0 for at in rows])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x = scale[rows[i]]
            gradient = y[i] * (w[rows[i]] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[rows[i]] += step * y[i] * x
                bias += step * y[i]
                alpha[i] = new
                worst = max(worst, abs(step) * norm[i])
        if worst < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(a, b) of the curve 1 / (1 + exp(-(a m + b))), by Newton steps on
    smoothed targets."""
    pos, neg = good.sum(), (~good).sum()
    t = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """Weights per place, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights.astype(np.float32), bias, curve

    def score(self, text: str | None) -> float:
        m = float(self.weights[features(text)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * m + self.curve[1], -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    y = np.where(labels == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        share = float((y == 1).mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE), 0.0, (0.0, float(np.log(share / (1 - share)))))
    scale = log_count_ratio(rows, y)
    # rows of either class weigh the same in all; norms are about one
    unit = np.mean([np.square(scale[at]).sum() for at in rows])
    scale = scale / np.sqrt(unit)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == -1).sum())) * cost
    fold = np.arange(len(y)) % FOLDS == 0
    if len(set(y[fold].tolist())) == 2 and len(set(y[~fold].tolist())) == 2:
        part = np.flatnonzero(~fold)
        w, b = dual_descent([rows[i] for i in part], y[part], scale, weight[part])
        margin = np.array([(w[rows[i]] * scale[rows[i]]).sum() + b for i in np.flatnonzero(fold)])
        curve = logistic(margin, y[fold] == 1)
    else:
        curve = (2.0, 0.0)
    w, b = dual_descent(rows, y, scale, weight)
    return Model(w * scale, b, curve)


def sample_of(docs: DataFrame, labels: DataFrame, max_rows: int, max_places: int) -> DataFrame:
    """(doc_id, text, quality): the bounded sample that a fit sees."""
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.select("*", F.xxhash64("doc_id").alias("nth")).orderBy("nth", "doc_id").limit(max_rows)
    docs = docs.select("doc_id", "text")
    # at most max_rows small rows: how many places the features of each may have
    most = F.least(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(TRIGRAMS)) + MARKS
    sizes = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "nth").agg(F.max(most).cast("bigint").alias("n")).collect()
    total, kept = 0, []
    for r in sorted(sizes, key=lambda r: (r["nth"], r["doc_id"])):
        total += r["n"]
        if total > max_places and kept:
            break
        kept.append((r["doc_id"],))
    if len(kept) < len(sizes):
        chosen = chosen.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id", "left_semi")
    return docs.join(F.broadcast(chosen.drop("nth")), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES) -> Model:
    """Fits ``labels(doc_id, quality)`` on a bounded sample of the rows."""
    sample = sample_of(docs, labels, max_rows, max_places)
    schema = pa.schema([("order", pa.int64()), ("quality", pa.int32()), ("at", pa.binary())])

    def run(batches):
        for b in batches:
            at = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield from as_table(schema, order=b.column("doc_id").to_pylist(), quality=b.column("quality").to_pylist(), at=at).to_batches()

    rows = sample.mapInArrow(run, "order bigint, quality int, at binary").toArrow()
    rows = rows.sort_by("order")
    order = np.random.default_rng(1).permutation(rows.num_rows)
    at = [np.frombuffer(x, np.int32) for x in rows.column("at").to_pylist()]
    return fit([at[i] for i in order], np.array(rows.column("quality").to_pylist(), np.int64)[order])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            value = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield from pa.Table.from_batches([b]).append_column("score", pa.array(value, pa.float64())).to_batches()

    return docs.mapInArrow(frugal(run), docs.selectExpr("*", "cast(0 as double) as score").schema)


def held_out():
    """Rows that no fit may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
