"""Quality classifier: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text as T

PASSAGE, HIDDEN, GATE, EPOCHS, THRESHOLD = 512, 32, 16, 40, 0.3
#: labelled texts that the fit reads at most, and their bytes in all
SAMPLE, SAMPLE_BYTES = 6_000, 48 << 20

#: each ASCII symbol has a class of its own; letters by case, digits, blanks and other bytes share one each
_SYMBOLS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
CLASS = np.full(256, 5, np.uint8)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = 0, 1, 2, 4
CLASS[[0x20, 0x09, 0x0D]] = 3
for _k, _b in enumerate(_SYMBOLS):
    CLASS[_b] = 7 + _k
CLASS[0x0A] = 6
CLASSES, COARSE = 7 + len(_SYMBOLS), 8
ROUGH = np.minimum(CLASS, 7).astype(np.uint8)
WIDTH = CLASSES + COARSE * COARSE + 8


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of PASSAGE bytes of every text, and the number of passages by text (an empty text has one, of zeros)."""
    size = np.diff(at)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    n = int(count.sum())
    x = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return x, count
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(data)) - at[:-1][row]
    own = first[row] + place // PASSAGE
    length = np.maximum(1, np.bincount(own, minlength=n)).astype(np.float32)
    x[:, :CLASSES] = np.bincount(own * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, -1) / length[:, None]
    rough = ROUGH[data].astype(np.int64)
    pair = own[1:] * COARSE * COARSE + rough[:-1] * COARSE + rough[1:]
    x[:, CLASSES : CLASSES + COARSE * COARSE] = np.bincount(pair[own[1:] == own[:-1]], minlength=n * COARSE * COARSE).reshape(n, -1) / length[:, None]
    start, end, word_row = T.words(data, at, T.NOT_SPACE)
    if len(start):
        h, of = T.hashes(T.LOWER[data], start, end), own[start]
        many = np.bincount(of, minlength=n).astype(np.float32)
        words = np.maximum(1, many)
        k = CLASSES + COARSE * COARSE
        for lag in (1, 2, 3, 4, 8):
            same = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
            x[:, k] = np.bincount(of[lag:][same], minlength=n) / words
            k += 1
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        x[:, k] = np.bincount(of[order][new], minlength=n) / words
        x[:, k + 1] = np.minimum(20, np.bincount(of, end - start, minlength=n) / words) / 20
        x[:, k + 2] = np.minimum(1, many / 100)  # 0 without words, whatever else is in the chunk
    return np.sqrt(x), count


class Model:
    """encode: h = tanh(W x); gate: a = softmax(w . (tanh(V h) * sigmoid(U h))); score: sigmoid(c . sum(a h) + b)."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": g(WIDTH, HIDDEN), "k": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE), "c": g(HIDDEN), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        p, first = self.p, np.cumsum(count) - count
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["W"] + p["k"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        bag = np.add.reduceat(a[:, None] * h, first)
        return z, h, t, s, a, bag, 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["b"], -30, 30)))

    def step(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean cross-entropy."""
        p = self.p
        z, h, t, s, a, bag, out = self.forward(x, count)
        first = np.cumsum(count) - count
        d = (out - y) / len(y)
        dbag = np.repeat(d[:, None] * p["c"], count, 0)
        da = (dbag * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dbag + dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - h * h)
        return {"W": z.T @ dz, "k": dz.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": bag.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
        """Adam over shuffled batches of 64 texts."""
        r, first = np.random.default_rng(seed), np.cumsum(count) - count
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        one, two, n = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), 64):
                some = np.sort(order[k : k + 64])
                own = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in some])
                n += 1
                for name, g in self.step(x[own], count[some], y[some]).items():
                    g = g + 1e-4 * self.p[name]
                    one[name] = 0.9 * one[name] + 0.1 * g
                    two[name] = 0.999 * two[name] + 0.001 * g * g
                    rate = 0.003 * (1 - epoch / epochs) + 1e-4
                    self.p[name] = (self.p[name] - rate * (one[name] / (1 - 0.9**n)) / (np.sqrt(two[name] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)[-1].astype(np.float64)


def held_out(key):
    """Rows never learnt from: crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model | None:
    """A model of every passage of labelled texts: those with the least hash of their id, at most `sample` of them.

    They are taken in that order as long as they have at most `size` bytes together, but the first in any case. Conflicting
    labels of one id: the lower counts; an id with several texts: the least. Null and empty texts count as one passage of
    zeros. None without labelled texts.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(label).cast("double").alias("_y"))
    spark = docs.sparkSession
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample)
    asked = chosen.collect()
    sizes = docs.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_n")).join(F.broadcast(spark.createDataFrame(asked, chosen.schema)), key)
    n = {r[0]: r[1] for r in sizes.groupBy(key).agg(F.max("_n")).collect()}
    rows = [r for r in asked if r[0] in n]
    total = np.cumsum([n[r[0]] for r in rows])
    ids = spark.createDataFrame(rows[: max(1, int(np.searchsorted(total, size, "right")))], chosen.schema)
    texts = docs.select(key, text).join(F.broadcast(ids), key).groupBy(key, "_y").agg(F.min(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in T.chunks(b.column(2)):
                x, count = passages(data, at)
                end = np.cumsum(count)
                out = [x[e - n : e].tobytes() for e, n in zip(end, count, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[low:high].cast(pa.string()), b.column(1)[low:high], pa.array(out, pa.binary())], names=["id", "y", "x"])

    common.ship(spark)
    rows = sorted(texts.mapInArrow(run, "id string, y double, x binary").collect())
    if not rows:
        return None
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    return Model().fit(np.concatenate(xs), np.array([len(x) for x in xs]), np.array([r[1] for r in rows], np.float32))


def classify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """Each row with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Every passage of the whole text is scored, null as empty; without a model all scores are 0.5. Repeated rows and null
    keys are rows like others; an empty table gives no rows; columns named like the new ones are replaced. The text goes unless keep_text is set.
    """
    spark = docs.sparkSession
    common.ship(spark)
    own = ["held_out", "score", "predicted"]
    base = docs.select(*[c for c in docs.columns if c not in own], held_out(key).alias("held_out"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            scores = np.full(b.num_rows, 0.5)
            if m is not None:
                for low, high, data, at in T.chunks(b.column(text)):
                    scores[low:high] = m.score(*passages(data, at))
            names = [c for c in b.schema.names if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in base.schema if keep_text or x.name != text)
    return base.mapInArrow(run, schema + ", score double, predicted int")
