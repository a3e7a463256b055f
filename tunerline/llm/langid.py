"""Language ID: a convolutional network over bytes, trained in numpy, applied to windows of fixed length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunerline.llm.common import Settled, bucket4, lean, thinned

#: Bytes of a window; the last one of a text is filled up with zeros.
LENGTH = 256
#: Filter widths, filters of each, and numbers that stand for a byte.
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
#: Training sample: so many documents of each language, by a hash of their ids, and of all languages together (at least one of each: all that are labelled are learned); so many windows of each document.
SAMPLE, SAMPLES, WINDOWS = 400, 25_600, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """(n, LENGTH + 3) bytes: the whole text in windows side by side, each with the next three bytes so that no n-gram is lost at a border."""
    n = max(1, -(-len(text) // LENGTH))
    buf = np.zeros(n * LENGTH + 3, np.uint8)
    buf[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(buf, (n, LENGTH + 3), (LENGTH, 1))


class Net:
    """Bytes -> embedding -> filters of several widths, rectified -> maximum over the window -> softmax."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.params = {"E": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.params[f"W{w}"] = rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32)
        hidden = FILTERS * len(WIDTHS)
        self.params |= {"b": np.zeros(hidden, np.float32), "V": rng.normal(0, 0.1, (hidden, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients over a batch. Only the bytes at each filter's maximum take part."""
        p, n = self.params, len(x)
        tops, at = [], []
        for w in WIDTHS:
            z = sum((p["E"] @ p[f"W{w}"][k])[x[:, k : k + LENGTH]] for k in range(w))
            where = z.argmax(1)
            at.append(where)
            tops.append(np.take_along_axis(z, where[:, None, :], 1)[:, 0, :])
        pre = np.concatenate(tops, 1) + p["b"]
        hid = np.maximum(pre, 0)
        logits = hid @ p["V"] + p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"V": hid.T @ prob, "c": prob.sum(0), "E": np.zeros_like(p["E"])}
        back = (prob @ p["V"].T) * (pre > 0)
        g["b"] = back.sum(0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"W{w}"] = np.zeros_like(p[f"W{w}"])
            for k in range(w):
                byte = x[np.arange(n)[:, None], at[i] + k]
                table = np.zeros((256, FILTERS), np.float32)  # gradient of E @ W[k]
                np.add.at(table, (byte, np.arange(FILTERS)[None, :]), d)
                g["E"] += table @ p[f"W{w}"][k].T
                g[f"W{w}"][k] = p["E"].T @ table
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over shuffled batches; fixed seed, so equal samples give equal nets."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(u) for k, u in self.params.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                for k, g in self._step(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] -= (RATE * 0.5**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> None:
        """What two neighbouring bytes add to all filters: first[two bytes] + then[two bytes, two places later]."""
        p = self.params
        one = {(w, k): p["E"] @ p[f"W{w}"][k] for w in WIDTHS for k in range(w)}
        pair = lambda w, k: (one[w, k][:, None, :] + one[w, k + 1][None, :, :]).reshape(65536, FILTERS)
        self.first = np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0)], 1) + p["b"]
        self.then = np.concatenate([np.repeat(one[3, 2], 256, 0), pair(4, 2)], 1)

    def predict(self, text: bytes) -> np.ndarray:
        """Probabilities of the languages: the mean over all windows, by bytes, of their log probabilities."""
        x = windows(text).astype(np.int32)
        two = (x[:, :-1] << 8) | x[:, 1:]
        total = np.zeros(len(self.languages))
        for lo in range(0, len(x), 64):  # bounded memory however long the text
            q = two[lo : lo + 64]
            z = self.first[q[:, :LENGTH]]
            z[:, :, FILTERS:] += self.then[q[:, 2 : LENGTH + 2]]
            hid = np.maximum(z.max(1), 0)
            logits = (hid @ self.params["V"] + self.params["c"]).astype(np.float64)
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            size = np.minimum(LENGTH, len(text) - LENGTH * np.arange(lo, lo + len(q)))
            total += size @ logits
        out = np.exp((total - total.max()) / max(1, len(text)))
        return out / out.sum()


def sample(docs: DataFrame) -> DataFrame:
    """lang, text: the training sample, at most SAMPLES documents that aren't held out, or one of each language."""
    own = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).where(F.col("lang").isNotNull() & F.coalesce(bucket4() != 2, F.lit(True)) & F.col("text").isNotNull())
    langs = Settled(own.groupBy("lang").count(), "languages", few=True)
    keep = max(1, min(SAMPLE, SAMPLES // max(1, langs.df.count())))
    own = thinned(own, "lang", langs.side(), keep, "h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = own.withColumn("rank", rank).where(F.col("rank") <= keep).select("doc_id", "lang").distinct()
    return docs.select("doc_id", "lang", "text").where("text is not null").join(Settled(ids, "sample-ids", few=True).side(), ["doc_id", "lang"], "left_semi").select("lang", "text")


def fit(docs: DataFrame) -> Net:
    """Train on windows from evenly spaced places of the sampled texts. Without any labelled text the net knows no language."""

    def cut(batches):
        for b in batches:
            lang, data = [], []
            for code, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                x = windows(text.encode("utf-8"))
                for i in sorted(set(np.linspace(0, len(x) - 1, WINDOWS).astype(int).tolist())):
                    lang.append(code)
                    data.append(x[i].tobytes())
                lang.append(code)  # the same in capitals, which few texts have
                data.append(windows(text.upper().encode("utf-8"))[0].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "bytes": pa.array(data, pa.binary())})

    rows = sorted((r["lang"], bytes(r["bytes"])) for r in sample(docs).mapInArrow(cut, "lang string, bytes binary").collect())  # SAMPLES * (WINDOWS + 1) windows at most
    net = Net(sorted({r[0] for r in rows}))
    if rows:
        x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), LENGTH + 3)
        net.train(x, np.array([net.languages.index(r[0]) for r in rows]))
    return net


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    The net learns from labelled rows outside the held-out fold (crc32 of the id as text, modulo 4, is 2; a null id is
    not held out). A prediction is made from the whole text alone. Null texts, texts without a letter, and all texts if
    there is nothing to learn from get und with score 0; else score is the probability of lang_pred, ties going to the
    first by name. Repeated rows and equal ids each give their row. The net is broadcast; its size is fixed.
    """
    lean(docs.sparkSession)
    shared, kind = docs.sparkSession.sparkContext.broadcast(fit(docs)), dict(docs.dtypes)["doc_id"]

    def run(batches):
        net = shared.value
        net.tables()
        for b in batches:
            lang, score = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                if not net.languages or not _LETTER.search(text):
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                p = net.predict(text.encode("utf-8"))
                lang.append(net.languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    rows = docs.select("doc_id", F.coalesce(bucket4() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
