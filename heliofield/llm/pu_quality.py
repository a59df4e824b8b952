"""Quality scores by positive-unlabelled learning.

1. Each text becomes ``FEATURES`` numbers of its form (shares of characters, words, lines, repeats); texts are read once, only the numbers are saved.
   They are standardised by means and deviations over all unlabelled rows.
2. Trusted positives are the training rows that a label calls good: at most ``POSITIVES`` of them, the least by a hash of ``doc_id`` (the one sample that is
   taken, and the only thing that labels decide). All training rows are the unlabelled texts.
3. A discriminator of positives against unlabelled texts orders the rows. The class prior is the least ratio of the unlabelled to the positive share
   above any of ``BINS`` scores that half of the positives reach; the positives counted took no part in the discriminator's training.
4. A network with one hidden layer minimises the non-negative unbiased risk pi R+(P) + max(0, R-(U) - pi R-(P)) with sigmoid loss: tasks take steps
   over their own unlabelled rows and the broadcast positives from the same parameters, which are averaged by rows after each of ``ROUNDS`` passes. Where
   a batch's bracket is negative the step climbs it back, as the method asks.

Defined results: a null or empty text has all numbers zero and gets a score like any other; a very long text is read whole; a null ``doc_id`` counts as the
empty text for the split and has no label; a ``doc_id`` with several labels is good if one of them says so; repeated rows are separate documents with the same
score; without any positive every score is 0.5; an empty table gives an empty result; of the tables only ``doc_id``, ``text`` and
``labels.quality`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.llm import textops
from heliofield.llm.runtime import save, table

POSITIVES = 20_000
HIDDEN = 16
ROUNDS = 4
BATCH = 512
#: A task takes so many steps a pass at least, however few rows it has.
STEPS = 300
RATE = 0.01
BINS = 1000
FAN_IN = 64
CUT = 0.3
SEED = 11

_PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_UPPER, _LOWER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _SIGN[_PUNCTUATION] = True
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_HIGH = np.arange(256) >= 128
#: Numbers a text: 32 signs, and 20 of words, lines and repeats.
FEATURES = len(_PUNCTUATION) + 20


def _of_words(words: textops.Words, n: int) -> np.ndarray:
    """(n, 9): sizes, repeats and endings of each text's words."""
    out = np.zeros((n, 9), np.float64)
    count = np.diff(words.first)
    if not len(words.start):
        return out
    doc = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    size = (words.end - words.start).astype(np.float64)
    last, head = words.data[words.end - 1], words.data[words.start]
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words.hash, doc))
    h, d = words.hash[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
    edge = np.flatnonzero(new)
    times = np.diff(np.append(edge, len(h)))
    distinct = np.bincount(d[edge], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, d[edge], times)
    mean = np.bincount(doc, size, n) / per
    out[:, 0] = np.log1p(count)
    out[:, 1] = mean
    out[:, 2] = np.sqrt(np.maximum(np.bincount(doc, size * size, n) / per - mean * mean, 0))
    out[:, 3] = np.bincount(doc, again, n) / per
    out[:, 4] = 1 - distinct / per
    out[:, 5] = most / per
    out[:, 6] = np.bincount(doc, size <= 3, n) / per
    out[:, 7] = np.bincount(doc, _SIGN[last], n) / per
    out[:, 8] = np.bincount(doc, _SIGN[head] & (size == 1), n) / per
    out[count == 0] = 0
    return out


def _of_lines(raw: bytes) -> tuple[float, float, float, float]:
    """Log of the number of lines, log of their mean length, share of repeated lines, share that ends a sentence."""
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    if not lines:
        return 0.0, 0.0, 0.0, 0.0
    n = len(lines)
    return np.log1p(n), np.log1p(len(raw) / n), 1 - len(set(lines)) / n, sum(x.endswith((b".", b"!", b"?")) for x in lines) / n


def features(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES) numbers."""
    data, offsets = textops.utf8(column)
    parts = []
    for i, j in textops.slabs(offsets):
        own = data[offsets[i] : offsets[j]]
        edge = offsets[i : j + 1] - offsets[i]
        n = j - i
        out = np.zeros((n, FEATURES))
        k = len(_PUNCTUATION)
        for t in range(n):
            text = own[edge[t] : edge[t + 1]]
            if not len(text):
                continue
            seen = np.bincount(text, minlength=256)
            share = seen / len(text)
            letters = seen[_UPPER].sum() + seen[_LOWER].sum()
            some = share[share > 0]
            out[t, :k] = np.log1p(1000 * share[_PUNCTUATION])
            out[t, k : k + 7] = (
                letters / len(text),
                seen[_UPPER].sum() / max(letters, 1),
                share[_DIGIT].sum(),
                share[_BLANK].sum(),
                share[_SIGN].sum(),
                share[_HIGH].sum(),
                -(some * np.log(some)).sum(),
            )
            out[t, k + 7 : k + 11] = _of_lines(text.tobytes())
        out[:, k + 11 :] = _of_words(textops.Words(own, edge), n)
        parts.append(out.astype(np.float32))
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float32).reshape(-1, FEATURES)


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): x holds a text's numbers."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = features(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "held_out", "x"])

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(name) % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return save(split.mapInArrow(measure, "doc_id long, held_out boolean, x binary"), "features", "zstd")


class Scaler:
    """Means and deviations; standardised numbers are held within 8 deviations."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.scale = mean.astype(np.float32), (1 / np.maximum(deviation, 1e-6)).astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)


def _summed(rows: DataFrame, kind: str, add) -> list:
    """Partial rows (n, values) added up ``FAN_IN`` at a time; what comes to the driver is at most as many rows of fixed size."""
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        rows = rows.repartition(parts).mapInArrow(add, kind)
    return rows.collect()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, values = 0, None
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block = np.frombuffer(raw.as_buffer(), np.float64)
            n, values = n + k, block.copy() if values is None else values + block
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "values": [values.tobytes()]})


def _total(rows: DataFrame) -> tuple[int, np.ndarray | None]:
    got = _summed(rows, "n long, values binary", _add)
    n = sum(r["n"] for r in got)
    return n, sum(np.frombuffer(r["values"], np.float64) for r in got) if n else None


def scaler(unlabelled: DataFrame) -> Scaler | None:
    """Moments over all rows of ``unlabelled`` (x)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(2 * FEATURES)
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            n += len(x)
            total += np.concatenate((x.sum(0), (x * x).sum(0)))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "values": [total.tobytes()]})

    n, total = _total(unlabelled.mapInArrow(moments, "n long, values binary"))
    if not n:
        return None
    mean = total[:FEATURES] / n
    return Scaler(mean, np.sqrt(np.maximum(total[FEATURES:] / n - mean * mean, 0)))


class Network:
    """score = sigmoid(v tanh(W x + a) + u x + b); all parameters lie in one flat vector."""

    SHAPES = ((FEATURES, HIDDEN), (HIDDEN,), (HIDDEN,), (FEATURES,), (1,))

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.Generator(np.random.PCG64(SEED))
            flat = np.zeros(sum(int(np.prod(s)) for s in self.SHAPES), np.float32)
            flat[: FEATURES * HIDDEN] = rng.normal(0, 0.3 / np.sqrt(FEATURES), FEATURES * HIDDEN)
            flat[FEATURES * HIDDEN + HIDDEN : FEATURES * HIDDEN + 2 * HIDDEN] = rng.normal(0, 0.3, HIDDEN)
        self.flat = np.array(flat, np.float32)
        self.parts, at = [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts.append(self.flat[at : at + n].reshape(shape))
            at += n

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, a, v, u, b = self.parts
        h = np.tanh(x @ w + a)
        return h @ v + x @ u + b, h

    def backward(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Gradient of a loss whose derivative by each row's output is ``g``."""
        _, _, v, _, _ = self.parts
        dh = g[:, None] * v * (1 - h * h)
        return np.concatenate(((x.T @ dh).ravel(), dh.sum(0), h.T @ g, x.T @ g, [g.sum()]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk of a batch, and its bracket R-(U) - prior R-(P); the loss is sigmoid(-z) for good, sigmoid(z) for bad."""
    zp, hp = net.forward(xp)
    zu, hu = net.forward(xu)
    sp, su = _sigmoid(zp), _sigmoid(zu)
    by_p, by_u = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
    bracket = float(su.mean() - prior * sp.mean())
    if bracket >= 0:
        return net.backward(xp, hp, -2 * prior * by_p) + net.backward(xu, hu, by_u), bracket
    return net.backward(xp, hp, prior * by_p) - net.backward(xu, hu, by_u), bracket


def discriminator_gradient(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the plain loss of positives against unlabelled rows."""
    zp, hp = net.forward(xp)
    zu, hu = net.forward(xu)
    return 0.5 * (net.backward(xp, hp, -_sigmoid(-zp) / len(xp)) + net.backward(xu, hu, _sigmoid(zu) / len(xu))), 0.0


def learn(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float, gradient, seed: int, rate: float = RATE) -> None:
    """One pass over ``xu``, with as many batches of positives; adaptive steps whose rate falls to a tenth."""
    rng = np.random.Generator(np.random.PCG64(seed))
    steps = max(STEPS, -(-len(xu) // BATCH))
    first, second = np.zeros_like(net.flat), np.zeros_like(net.flat)
    order = rng.permutation(len(xu))
    for k in range(steps):
        at = (np.arange(k * BATCH, k * BATCH + min(BATCH, len(xu)))) % len(xu)
        g, _ = gradient(net, xp[rng.integers(0, len(xp), BATCH)], xu[order[at]], prior)
        g = g.astype(np.float32) + np.float32(1e-4) * net.flat
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        size = rate * (1 - 0.9 * k / steps)
        net.flat -= np.float32(size) * (first / (1 - 0.9 ** (k + 1))) / (np.sqrt(second / (1 - 0.99 ** (k + 1))) + np.float32(1e-8))


def train(unlabelled: DataFrame, positives: np.ndarray, scale: Scaler, net: Network, prior: float, gradient, rounds: int = ROUNDS) -> Network:
    """Passes over all rows of ``unlabelled`` (x), parameters averaged by rows after each."""
    context = unlabelled.sparkSession.sparkContext
    for number in range(rounds):
        sent = context.broadcast((scale, positives, net.flat))

        def steps(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            own_scale, xp, flat = sent.value
            own, seen, waiting, kept = Network(flat), 0, [], 0
            seed = number * 1_000_003 + TaskContext.get().partitionId()

            def flush() -> None:
                learn(own, xp, np.concatenate(waiting), prior, gradient, seed + seen, RATE / (1 + number))

            for batch in batches:
                waiting.append(own_scale(_matrix(batch.column(0))))
                kept += len(waiting[-1])
                if kept >= 1 << 17:  # so many rows are held at a time
                    flush()
                    seen, waiting, kept = seen + kept, [], 0
            if kept:
                flush()
                seen += kept
            if seen:
                yield pa.RecordBatch.from_pydict({"n": [seen], "values": [(own.flat.astype(np.float64) * seen).tobytes()]})

        n, total = _total(unlabelled.mapInArrow(steps, "n long, values binary"))
        if n:
            net = Network(total / n)
        sent.unpersist()
    return net


def class_prior(unlabelled: DataFrame, aside: np.ndarray, scale: Scaler, net: Network) -> float:
    """The least ratio of shares above a score, of all unlabelled rows and of ``aside`` (scaled positives that training has not seen)."""
    sent = unlabelled.sparkSession.sparkContext.broadcast((scale, net.flat))
    upto = np.linspace(0, 1, BINS + 1)

    def bins(z: np.ndarray) -> np.ndarray:
        return np.histogram(_sigmoid(z), upto)[0].astype(np.float64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_scale, flat = sent.value
        own, n, total = Network(flat), 0, np.zeros(BINS)
        for batch in batches:
            x = own_scale(_matrix(batch.column(0)))
            n += len(x)
            total += bins(own.forward(x)[0])
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "values": [total.tobytes()]})

    n, total = _total(unlabelled.mapInArrow(counted, "n long, values binary"))
    return prior_of(total, bins(net.forward(aside)[0]))


def prior_of(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Class prior from counts by bins of score, ascending: every ratio bounds it from above; those over less than half of the positives are too noisy."""
    above_u, above_p = np.cumsum(unlabelled[::-1]) / unlabelled.sum(), np.cumsum(positive[::-1]) / positive.sum()
    fit = above_p >= 0.5
    return float(np.clip((above_u[fit] / above_p[fit]).min(), 0.01, 0.99))


def quality_scores(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""
    spark = docs.sparkSession
    measured = _measured(docs)
    train_rows = measured.where("not held_out")
    unlabelled = train_rows.select("x")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    taken = train_rows.join(good, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "x").limit(positives).select("x").toArrow()  # bounded by a parameter
    xp = _matrix(taken.column(0))
    scale = scaler(unlabelled) if len(xp) > 1 else None
    if scale is None:
        return measured.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    xp = scale(xp)
    half = len(xp) // 2
    ranker = train(unlabelled, xp[:half], scale, Network(), 0.5, discriminator_gradient, 3)
    prior = class_prior(unlabelled, xp[half:], scale, ranker)
    net = train(unlabelled, xp, scale, Network(), prior, risk_gradient)
    sent = spark.sparkContext.broadcast((scale, net.flat))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_scale, flat = sent.value
        own = Network(flat)
        for batch in batches:
            value = _sigmoid(own.forward(own_scale(_matrix(batch.column(2))))[0].astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array((value >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return measured.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op11_pu_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
