"""Quality classifier: naive Bayes support vectors over n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunerline.llm.common import bucket4, lean, thinned

#: N-grams of 1 to GRAM bytes, and of 1 to GRAM marks of a word said again at once, share so many indicators, by a hash.
FEATURES = 1 << 17
GRAM = 4
#: Training sample: so many labelled documents of each class, by a hash of their ids.
SAMPLE = 1_500
#: A training text also counts by these first bytes of its second half, as short texts are rare among the labelled.
EXCERPTS = (24, 96, 384)
#: Smoothing of the class counts; penalty of a loss; rounds of coordinate descent; share of the naive Bayes weights.
ALPHA, PENALTY, ROUNDS, SEED = 1.0, 1.0, 30, 11
#: Score from which a document counts as good.
GOOD = 0.7
_M = np.uint64(0x9E3779B97F4A7C15)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The distinct indicators of a whole text, ascending. seen: FEATURES booleans, all false before and after.

    Two sequences give n-grams: the bytes, and for each word but the first whether it is the word before it (0 or 1)."""
    words = text.split()
    again = np.fromiter(map(eq, words, words[1:]), np.uint64, max(0, len(words) - 1))
    for x, bits, kind in ((np.frombuffer(text, np.uint8).astype(np.uint64), 8, 0), (again, 1, 1 << 44)):
        key = np.zeros(len(x), np.uint64)
        for n in range(1, min(GRAM, len(x)) + 1):
            key = (key[: len(x) - n + 1] << np.uint64(bits)) | x[n - 1 :]
            seen[(((key + np.uint64(kind + (n << 40))) * _M) >> np.uint64(47)).astype(np.int64)] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


class Model:
    """weights: the log-count ratio of each indicator times its support vector weight; a row is scaled by 1 / sqrt(its indicators)."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        """labels: 1 or 0. With a single class the score is that class's; without rows it is one half."""
        self.weights, self.bias = np.zeros(FEATURES, np.float64), 0.0
        self.slope, self.offset = 1.0, 0.0
        if not len(rows) or labels.min() == labels.max():
            self.slope, self.offset = 0.0, 0.0 if not len(rows) else 20.0 * (2 * int(labels[0]) - 1)
            return
        count = np.full((2, FEATURES), ALPHA)
        for row, y in zip(rows, labels, strict=True):
            count[y][row] += 1
        count /= count.sum(1, keepdims=True)
        ratio = np.log(count[1] / count[0])
        vectors = [ratio[row] / math.sqrt(max(1, len(row))) for row in rows]
        y = 2.0 * labels - 1
        folds = np.arange(len(rows)) % 5
        margins = np.zeros(len(rows))
        for k in range(5):  # the scale of the scores comes from rows that the weights haven't seen
            if len({*labels[folds != k].tolist()}) == 2:
                w, b = self._descend(rows, vectors, y, np.flatnonzero(folds != k))
                for i in np.flatnonzero(folds == k):
                    margins[i] = w[rows[i]] @ vectors[i] + b
        w, self.bias = self._descend(rows, vectors, y, np.arange(len(rows)))
        self.weights = w * ratio
        self.slope, self.offset = self._scale(margins, labels)

    @staticmethod
    def _descend(rows, vectors, y, use) -> tuple[np.ndarray, float]:
        """Linear support vectors, hinge loss: minimise over each dual variable in turn, in shuffled rounds. Classes weigh alike."""
        w, b, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
        own = {s: max(1, int((y[use] == s).sum())) for s in (-1.0, 1.0)}
        limit = {s: PENALTY * len(use) / (2 * n) for s, n in own.items()}
        square = [float(v @ v) + 1.0 for v in vectors]
        rng = np.random.default_rng(SEED)
        for _ in range(ROUNDS):
            most = 0.0
            for i in rng.permutation(use):
                g = y[i] * (w[rows[i]] @ vectors[i] + b) - 1
                new = min(max(alpha[i] - g / square[i], 0.0), limit[y[i]])
                step = (new - alpha[i]) * y[i]
                if step:
                    w[rows[i]] += step * vectors[i]
                    b += step
                    alpha[i] = new
                    most = max(most, abs(step))
            if most < 1e-4:
                break
        return w, b

    @staticmethod
    def _scale(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
        """Logistic fit of label on margin by Newton steps, targets a little inside 0 and 1."""
        n1 = int(labels.sum())
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
        a, b = 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            r, h = p - target, p * (1 - p) + 1e-9
            g = np.array([r @ margins, r.sum()]) + 1e-3 * np.array([a, b])
            hess = np.array([[h @ margins**2, h @ margins], [h @ margins, h.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        return float(a), float(b)

    def score(self, row: np.ndarray) -> float:
        margin = float(self.weights[row].sum()) / math.sqrt(max(1, len(row))) + self.bias
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * margin + self.offset))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a sample, bounded by SAMPLE for each class, of labelled documents (labels: doc_id, quality) outside the held-out fold."""
    own = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (bucket4() != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = thinned(own.withColumn("h", F.xxhash64("doc_id")), "quality", F.broadcast(own.groupBy("quality").count()), SAMPLE, "h")
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id"))
    ids = own.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).drop("rank", "h")

    def cut(batches):
        seen = np.zeros(FEATURES, bool)
        for b in batches:
            quality, rows = [], []
            for y, text in zip(b.column("quality").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                for part in {data, *(data[len(data) // 2 :][:n] for n in EXCERPTS)}:
                    quality.append(y)
                    rows.append(features(part, seen).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"quality": pa.array(quality, pa.int32()), "row": pa.array(rows, pa.binary())})

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("quality", "text").mapInArrow(cut, "quality int, row binary")
    rows = sorted((int(r["quality"]), bytes(r["row"])) for r in rows.distinct().collect())  # 2 * SAMPLE documents with their excerpts; equal ones count once
    order = np.random.default_rng(SEED).permutation(len(rows))
    return Model([np.frombuffer(rows[i][1], np.int32) for i in order], np.array([rows[i][0] for i in order], np.int64))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    The model learns from labelled documents outside the held-out fold (crc32 of the id as text, modulo 4, is 2; a null
    id is not held out). A score is made from the whole text alone; null and empty texts have no indicators and get the
    score of none. predicted is 1 from a score of GOOD on. With labels of one class all scores are near it; without any
    they are one half. A document labelled twice counts with its lower label. Repeated rows and equal ids each give
    their row. Other columns are not read. The weights are broadcast; their number is fixed.
    """
    lean(docs.sparkSession)
    shared, kind = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), dict(docs.dtypes)["doc_id"]

    def run(batches):
        model, seen = shared.value, np.zeros(FEATURES, bool)
        for b in batches:
            score = [model.score(features((t.as_py() or "").encode("utf-8"), seen)) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(score, pa.float64()), "predicted": pa.array([int(x >= GOOD) for x in score], pa.int32())})

    rows = docs.select("doc_id", F.coalesce(bucket4() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
