"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of a few bytes slide over the whole text, every byte of it. The
text is covered by chunks that overlap by half; each filter is max-pooled over each
chunk, a small hidden layer looks at a chunk's pooled values, and the mean and the
maximum of the hidden values over all chunks give one probability. Filters see
marks and shouting; low pooled values show chunks in which little differs.

Fitting uses a bounded sample: the ``SAMPLE_ROWS`` labelled rows of smallest id
hash, as long as their texts fit into ``SAMPLE_BYTES`` (a text that does not fit
is passed over), on the driver, with a fixed seed. Scoring reads whole texts
in blocks, so a worker's memory does not grow with a text's length beyond the text.

Defined results: null counts as empty, and the empty text has a score like any
other. Without labelled rows every score is 0.5. Labels that are null or neither
0 nor 1 are passed over; of an id's several labels or texts one counts. Rows that
repeat an id are scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, load, small_table
from .packing import few

FILTERS, WIDTH, HALF, HIDDEN = 24, 5, 128, 16
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12_000_000
EPOCHS, RATE = 10, 0.01
THRESHOLD = 0.5
#: Bytes that are convolved at a time.
BLOCK = 1 << 16


@dataclass
class Model:
    """filters (WIDTH, 256, FILTERS); v, c: hidden layer; w, b: output of mean and maximum."""

    filters: np.ndarray
    v: np.ndarray
    c: np.ndarray
    w: np.ndarray
    b: float

    def halves(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Maxima of each filter over half chunks of all texts, and each text's number of them."""
        counts, out, some, size = [], [], [], 0
        for t in texts:
            counts.append(max(1, -(-len(t) // HALF)))
            for at in range(0, max(1, len(t)), BLOCK):  # a block ends with the first bytes of the next
                part = t[at : at + BLOCK + WIDTH - 1]
                some.append((part, max(1, min(BLOCK, len(t) - at))))
                size += len(part)
                if size >= BLOCK:
                    out.append(self._halves(some))
                    some, size = [], 0
        if some:
            out.append(self._halves(some))
        return (np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)), counts

    def _halves(self, parts: list[tuple[bytes, int]]) -> np.ndarray:
        pad, starts, stops, at, data = bytes(WIDTH + 1), [], [], 0, []
        for part, n in parts:
            starts.append(np.arange(at, at + n, HALF))
            stops.append(at + n)
            data += [part, pad]
            at += len(part) + len(pad)
        x = np.frombuffer(b"".join(data), np.uint8)
        n = len(x) - WIDTH + 1
        s = self.filters[0][x[:n]]
        for k in range(1, WIDTH):
            s += self.filters[k][x[k : n + k]]
        cuts = np.concatenate([np.append(a, z) for a, z in zip(starts, stops)])
        real = np.concatenate([np.append(np.ones(len(a), bool), False) for a in starts])
        return np.maximum.reduceat(s, cuts, axis=0)[real]

    def score(self, texts: list[bytes]) -> np.ndarray:
        halves, counts = self.halves(texts)
        out, at = np.empty(len(texts)), 0
        for i, n in enumerate(counts):
            h = self.hidden(chunks(halves[at : at + n]))
            out[i] = self.output(h)
            at += n
        return out

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.v + self.c)

    def output(self, h: np.ndarray) -> float:
        z = float(np.concatenate([h.mean(0), h.max(0)]) @ self.w + self.b)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chunks(halves: np.ndarray) -> np.ndarray:
    """Maxima over whole chunks: two neighbouring halves each; a text of one half has one chunk."""
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


def initial(seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    f32 = np.float32
    return Model(
        rng.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(f32), rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f32),
        np.zeros(HIDDEN, f32), rng.normal(0, 0.2, 2 * HIDDEN).astype(f32), 0.0,
    )


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 0, batch: int = 16) -> Model:
    """Adam on the cross entropy; both classes weigh alike up to a factor of two."""
    model = initial(seed)
    if not texts:
        model.w[:] = 0
        return model
    y = np.asarray(labels, np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, 1.0, min(2.0, share / (1 - share)) if share > 0.5 else 1.0)
    names = ["filters", "v", "c", "w"]
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    rng, step, bias = np.random.default_rng(seed), 0, np.zeros(2)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(texts)), RATE * 0.5 ** (4 * epoch / epochs)
        for at in range(0, len(order), batch):
            grads = {k: np.zeros_like(getattr(model, k)) for k in names}
            gb = 0.0
            for i in order[at : at + batch]:
                gb += backward(model, texts[i], y[i], weight[i] / batch, grads)
            step += 1
            for k in names:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.01 * (grads[k] ** 2 - second[k])
                move = rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                setattr(model, k, (getattr(model, k) - move).astype(np.float32))
            bias += (0.1 * (gb - bias[0]), 0.01 * (gb * gb - bias[1]))
            model.b -= rate * bias[0] / (1 - 0.9**step) / (np.sqrt(bias[1] / (1 - 0.99**step)) + 1e-6)
    return model


def backward(model: Model, text: bytes, label: float, weight: float, grads: dict) -> float:
    """Add one text's gradients; returns that of the output's constant."""
    n = max(1, len(text))
    m = -(-n // HALF)
    x = np.frombuffer(text + bytes(n - len(text) + WIDTH), np.uint8)
    s = model.filters[0][x[:n]]
    for k in range(1, WIDTH):
        s += model.filters[k][x[k : n + k]]
    full = np.full((m * HALF, FILTERS), -np.inf, np.float32)
    full[:n] = s
    full = full.reshape(m, HALF, FILTERS)
    where = full.argmax(1)
    halves = np.take_along_axis(full, where[:, None], 1)[:, 0]
    where = where + HALF * np.arange(m)[:, None]
    pooled = chunks(halves)
    if m > 1:
        where = np.where(halves[:-1] >= halves[1:], where[:-1], where[1:])
    h = model.hidden(pooled)
    gz = weight * (model.output(h) - label)
    top = h.argmax(0)
    grads["w"] += gz * np.concatenate([h.mean(0), h.max(0)])
    gh = np.tile(gz * model.w[:HIDDEN] / len(h), (len(h), 1))
    gh[top, np.arange(HIDDEN)] += gz * model.w[HIDDEN:]
    ga = gh * (1 - h * h)
    grads["v"] += pooled.T @ ga
    grads["c"] += ga.sum(0)
    gp = (ga @ model.v.T).ravel()
    column = np.tile(np.arange(FILTERS), len(h))
    at = where.ravel()
    for k in range(WIDTH):
        grads["filters"][k] += np.bincount(x[at + k].astype(np.int64) * FILTERS + column, gp, 256 * FILTERS).reshape(256, FILTERS)
    return gz


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], list[int]]:
    """The bounded sample, from rows that are not held out."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("id")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    sizes = docs.select(F.col(id_col).alias("id"), F.octet_length(text).alias("n")).join(known, "id")  # no text is exchanged
    order = [F.xxhash64("id"), F.col("id"), F.col("y"), F.col("n")]
    chosen, left = {}, SAMPLE_BYTES
    for r in sizes.orderBy(*order).limit(SAMPLE_ROWS).collect():
        if r.n <= left and r.id not in chosen:
            chosen[r.id] = (r.y, r.n)
            left -= r.n
    if not chosen:
        return [], []
    # one text of each id, of the size that was counted
    picked = small_table(docs.sparkSession, [(i, n) for i, (_, n) in chosen.items()], "id long, n long")
    sized = texts.withColumn("n", F.octet_length("text").cast("long")).join(F.broadcast(picked), ["id", "n"])
    got = sorted(sized.groupBy("id").agg(F.min("text").alias("text")).collect())
    return [r.text.encode() for r in got], [chosen[r.id][0] for r in got]


def held_out(doc_id):
    """Rows whose label must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    return fit(*training_rows(docs, labels, **columns))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of docs with one more column, the score of each whole text."""
    if score_col in docs.columns:
        docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def kernel(batches):
        for b in few(batches, 256):
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(texts), pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(frugal(kernel), schema)


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit_quality(docs, load(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality_model": op1_quality_model}
ORACLES: dict[str, str] = {}
