"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators: words, pairs of words, and runs of one to three word shapes (case, digits, signs,
whether the word repeats the one before), also at levels of their share of the
text.  A text's features are the set of their hashes.  Each feature is scaled
by the log ratio of its counts in the two classes, each text to unit length,
and a hinge-loss linear model is fitted by dual coordinate descent.  A sigmoid
fitted on a part of the sample that the model hasn't seen turns margins into
scores.

The model is fitted on a bounded sample: the SAMPLE labelled rows that come
first by a seeded hash.  Scoring reads every text once, without a shuffle.

Defined cases: null and empty texts have one feature of their own and get its
score; rows of labels with null or contradicting quality teach nothing; with no
usable label, or labels of one class, every score is the share of that class
(0.5 for none); null doc_id is not held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.hashing import _SPACE, U64, mix, rows_of_words, separated, stream, text_blocks, word_hashes

BITS = 20
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 5000
FOLDS = 5
THRESHOLD = 0.3
COST = 1.0
ROUNDS = 12
SMOOTH = 1.0
SEED = 5

_SIGN = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~=+_/\\{}[]", "|", "!?", ".,;:'\"()-")):
    _SIGN[[ord(c) for c in _chars]] = 4 << _k if _k else 2
_SIGN[97:123] = 1
_SIGN[0xC0:] = 1


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct features of each row of a block."""
    n = len(offsets) - 1
    raw, offsets = separated(raw, offsets)
    words, starts = word_hashes(raw, lower=False)
    bounds = rows_of_words(starts, offsets)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(n), sizes)
    seeds = stream(71, 9)
    rows, codes = [np.arange(n)], [np.where(sizes > 0, mix(seeds[:1] + np.minimum(np.log2(sizes + 1), 12).astype(U64)), mix(seeds[1:2]))]
    if len(words):
        with np.errstate(over="ignore"):
            kind = _SIGN[raw]
            kind[starts] = np.where(kind[starts] == 2, 1, kind[starts])  # a capital at the start is common
            shape = np.bitwise_or.reduceat(np.where(_SPACE[raw], 0, kind), starts).astype(U64)
            same = np.zeros(len(words), dtype=bool)
            same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
            shape = shape | (same.astype(U64) << U64(9))
            rows.append(row)
            codes.append(mix(words ^ seeds[2]))
            pair = row[1:] == row[:-1]
            rows.append(row[1:][pair])
            codes.append(mix(mix(words[:-1][pair] + seeds[8]) ^ words[1:][pair]))
            run = np.zeros(len(words), dtype=U64)
            for k in range(3):
                m = len(words) - k
                if m <= 0:
                    break
                run = mix(run[:m] * U64(3) + shape[k:] + seeds[3])
                inside = row[:m] == row[k:]
                rows.append(row[:m][inside])
                codes.append(mix(run[inside] ^ seeds[4 + k]))
            # shares of shapes, in levels
            key, count = np.unique(row.astype(U64) << U64(16) | shape, return_counts=True)
            owner = (key >> U64(16)).astype(np.int64)
            level = np.floor(-2 * np.log2(count / sizes[owner])).astype(U64)
            rows.append(owner)
            codes.append(mix((key & U64(0xFFFF)) * U64(64) + level + seeds[7]))
    rows, codes = np.concatenate(rows), np.concatenate(codes) >> U64(64 - bits)
    both = np.unique(rows.astype(np.int64) << bits | codes.astype(np.int64))
    return np.split(both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(1, n)))


def row_features(column, bits: int = BITS):
    for _, _, raw, offsets in text_blocks(column):
        yield from features(raw, offsets, bits)


def featurizer(bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = list(row_features(batch.column(0), bits))
            if lists:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))], names=["quality", "f"])

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int, seed: int) -> DataFrame:
    """Features and quality of the labelled rows to learn from; the bounded list of their ids is broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2")).where("quality = q2").drop("q2")
    chosen = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.select("text", "quality", "id")


def descend(xs: list[np.ndarray], scaled: list[np.ndarray], y: np.ndarray, dims: int, cost: float, rounds: int, seed: int) -> np.ndarray:
    """Weights (the last is the bias) that minimise the L2-regularised hinge loss, by dual coordinate descent."""
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(y))
    # errors of the rare class weigh as much as those of the other
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    upper = np.where(y > 0, cost * len(y) / (2 * share[1]), cost * len(y) / (2 * share[0]))
    order = np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for v in scaled])
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            x, v = xs[i], scaled[i]
            gradient = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the smoothed log loss."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin, d.sum()])
        m = np.array([[h @ (margin * margin) + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """ratio and weight of each feature, bias, and the sigmoid of margins."""

    def __init__(self, bits: int):
        self.bits = bits
        self.ratio = np.zeros(1 << bits, dtype=np.float32)
        self.weight = np.zeros(1 << bits, dtype=np.float32)
        self.bias, self.a, self.b = 0.0, 0.0, 0.0

    def margins(self, lists: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(lists))
        for i, x in enumerate(lists):
            r = self.ratio[x].astype(float)
            length = np.sqrt(r @ r)
            out[i] = (r @ self.weight[x]) / length + self.bias if length else self.bias
        return out

    def scores(self, lists: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(lists) + self.b, -500, 500)))


def fit(xs: list[np.ndarray], quality: np.ndarray, bits: int = BITS, cost: float = COST, rounds: int = ROUNDS, smooth: float = SMOOTH, seed: int = SEED) -> Model:
    model, y = Model(bits), np.where(quality > 0, 1.0, -1.0)
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        model.b = 0.0 if len(y) == 0 else 50.0 * y[0]
        return model
    tune = np.random.default_rng(seed + 1).random(len(y)) < 0.2
    if len(set(y[tune])) < 2 or len(set(y[~tune])) < 2:
        tune[:] = False
    use = np.flatnonzero(~tune)
    counts = np.full((2, 1 << bits), smooth)
    for i in use:
        counts[int(y[i] > 0), xs[i]] += 1
    model.ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    scaled = []
    for i in use:
        r = model.ratio[xs[i]].astype(float)
        scaled.append(r / max(np.sqrt(r @ r), 1e-12))
    w = descend([xs[i] for i in use], scaled, y[use], 1 << bits, cost, rounds, seed)
    model.weight, model.bias = w[:-1].astype(np.float32), float(w[-1])
    check = np.flatnonzero(tune) if tune.any() else use
    model.a, model.b = sigmoid_fit(model.margins([xs[i] for i in check]), y[check])
    return model


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, bits: int = BITS, seed: int = SEED) -> Model:
    rows = sample(docs, labels, size, seed).orderBy("id", "quality").select("text", "quality").mapInArrow(featurizer(bits), "quality int, f array<int>")
    got = rows.toArrow()
    lists = [np.asarray(x, dtype=np.int64) for x in got["f"].to_pylist()]
    return fit(lists, np.array(got["quality"].to_pylist(), dtype=float), bits=bits, seed=seed)


def scorer(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            parts = [model.scores(features(raw, offsets, model.bits)) for _, _, raw, offsets in text_blocks(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, size, seed=seed))
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"))
    rows = rows.mapInArrow(scorer(shared), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
