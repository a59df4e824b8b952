"""Log-bilinear language model, trained by noise-contrastive estimation, and normalised scores.

1. Words (lower case, one end a text) of the training documents are counted over the whole corpus.
2. The ``VOCABULARY`` most frequent words are the model's outputs; all others share one output, whose probability is divided among
   them by their counts, so scores are of the whole open vocabulary.
3. A context's vector is x[u] + y[v], with a vector for each word at either place before; a word's score is its product with q[w], plus b[w]. Tasks
   take noise-contrastive steps from the same parameters; parameters, and the sums of squares that set each vector's rate, are averaged by tokens after a round.
   Each of the ``ROUNDS`` rounds uses all training rows, at any size of the table; the rate falls from round to round.
4. exp(score) factorises over the two context words, so the normalisers of all contexts are one product of two matrices, and a token's
   normalised log-probability is a look-up.

Word counts are never collected: the ``FREQUENT`` most frequent words (a fixed number) are sent to the tasks, all other words meet
their counts in a join.

Defined results: a null text is empty and has one token, its end; a very long text is scored whole; a null ``doc_id`` counts as the empty text
for the split; words that tie in count are ranked by their hash; repeated rows are separate documents; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read.
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

VOCABULARY = 2047
FREQUENT = 1 << 17
SIZE = 32
ROUNDS = 2
BATCH = 512
NOISE = 128
RATE = 0.15
FAN_IN = 32
ALPHA = 0.1
END = np.uint64(0x0E0D0E0D0E0D0E0D)
_FLUSH = 1 << 20


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slabs as (first row, last row, token hashes with ends, edges)."""
    data, offsets = textops.utf8(column)
    for i, j in textops.slabs(offsets):
        words = textops.Words(textops.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
        edge = words.first + np.arange(j - i + 1)
        out = np.full(edge[-1], END, np.uint64)
        keep = np.ones(edge[-1], bool)
        keep[edge[1:] - 1] = False
        out[keep] = words.hash
        yield i, j, out, edge


def word_counts(split: DataFrame) -> DataFrame:
    """(word, n) over the training rows; ``split`` has held_out and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate(words), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, np.concatenate(counts)).astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, _, token, _ in _tokens(batch.column(0)):
                word, n = np.unique(token, return_counts=True)
                words.append(word)
                counts.append(n)
                waiting += len(word)
                if waiting > _FLUSH:
                    yield flush()
                    words, counts, waiting = [], [], 0
        if words:
            yield flush()

    seen = split.where("not held_out").select("text").mapInArrow(count, "word long, n long")
    return save(seen.groupBy("word").agg(F.sum("n").alias("n")), "words")


class Known:
    """The frequent words: sorted hashes, counts, and output numbers (the unknown output where there is none)."""

    def __init__(self, word: np.ndarray, count: np.ndarray, vocabulary: int):
        output = np.minimum(np.arange(len(word)), vocabulary)
        order = np.argsort(word.view(np.uint64))
        self.word, self.count, self.output = word.view(np.uint64)[order], count[order], output[order]

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.word, token), max(len(self.word) - 1, 0))
        return at, (self.word[at] == token) if len(self.word) else np.zeros(len(token), bool)


def _encoded(split: DataFrame, known, unknown: int) -> DataFrame:
    """Outputs, sums over frequent words, and the other words with their numbers, a row a document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = known.value
        logs = np.log10(table_.count + ALPHA)
        for batch in batches:
            for i, j, token, edge in _tokens(batch.column(3)):
                word, back = np.unique(token, return_inverse=True)
                at, hit = table_.find(word)
                output = np.where(hit, table_.output[at] if len(table_.word) else 0, unknown).astype(np.uint16)
                log = np.where(hit, logs[at] if len(logs) else 0.0, 0.0)
                ids, seen = output[back], hit[back]
                total = lambda x: np.add.reduceat(x, edge[:-1])  # noqa: B023, E731
                value = log[back]
                doc = np.repeat(np.arange(j - i), np.diff(edge))
                rare = np.flatnonzero(~seen)
                pair, first, tf = np.unique(doc[rare].astype(np.uint64) * np.uint64(len(word) + 1) + back[rare].astype(np.uint64), return_index=True, return_counts=True)
                per = np.bincount(doc[rare][first], minlength=j - i)
                cuts = pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(np.diff(edge)),
                        pa.array(total(seen.astype(np.int64))),
                        pa.array(total(value)),
                        pa.array(total(np.where(ids == unknown, value, 0.0))),
                        pa.array([ids[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(cuts, pa.array(word[(pair % np.uint64(len(word) + 1)).astype(np.int64)].view(np.int64))),
                        pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "unknown_logs", "ids", "words", "times"],
                )

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, unknown_logs double, ids binary, words array<long>, times array<int>"
    return save(split.select("row", "doc_id", "held_out", "text").mapInArrow(encode, kind), "encoded")


class Model:
    """Parameters: x and y (vectors of the word before and of the one before that; one more for a text's start), q and b (outputs)."""

    NAMES = ("x", "y", "q", "b")

    def __init__(self, noise: np.ndarray, size: int = SIZE):
        rng = np.random.Generator(np.random.PCG64(97))
        n = len(noise)
        self.noise = noise  # probability of each output
        self.x, self.y, self.q = (rng.normal(0, 0.1, (n + more, size)).astype(np.float32) for more in (1, 1, 0))
        self.b = np.log(noise).astype(np.float32)
        self.past = {k: np.full(len(getattr(self, k)), 1e-6, np.float32) for k in self.NAMES}  # sums of mean squared gradients

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES] + [self.past[k].ravel() for k in self.NAMES])

    def log10_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, normaliser): log10 p(w | v, u) = first[u, w] + second[v, w] - normaliser[u, v]."""
        first, second = self.x @ self.q.T + self.b, self.y @ self.q.T
        top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            z = np.log(np.exp(first - top1) @ np.exp(second - top2).T) + top1 + top2.T
        ln10 = np.float32(np.log(10))
        return first / ln10, second / ln10, z / ln10


def model_of(noise: np.ndarray, values: np.ndarray, size: int = SIZE) -> Model:
    """The model whose ``flat`` gives ``values``."""
    out, n, at = object.__new__(Model), len(noise), 0
    shapes = {"x": (n + 1, size), "y": (n + 1, size), "q": (n, size), "b": (n,)}
    out.noise, out.past = noise, {}
    for put, wide in ((lambda k, v: setattr(out, k, v), True), (out.past.__setitem__, False)):
        for k, shape in shapes.items():
            shape = shape if wide else shape[:1]
            count = int(np.prod(shape))
            put(k, np.array(values[at : at + count], np.float32).reshape(shape))
            at += count
    return out


def _sigmoid_of_minus(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(z)), in place; what overflows gives 0."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


class Trainer:
    """Noise-contrastive steps with per-parameter rates."""

    def __init__(self, model: Model, seed: int, rate: float = RATE):
        self.m, self.rng, self.rate = model, np.random.Generator(np.random.PCG64(seed)), np.float32(rate)
        self.log_noise = (np.log(model.noise) + np.log(NOISE)).astype(np.float32)
        self.upto = np.cumsum(model.noise)

    def _step(self, rows: np.ndarray, **gradients: np.ndarray) -> None:
        """Gradients of some rows, by name; those of the same row are added up first."""
        order = rows.argsort(kind="stable")
        at = rows.take(order)
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        at = at.take(edge)
        for name, gradient in gradients.items():
            value, past = getattr(self.m, name), self.m.past[name]
            gradient = np.add.reduceat(gradient.take(order, 0), edge)
            total = gradient * gradient if value.ndim == 1 else np.einsum("ij,ij->i", gradient, gradient) / np.float32(value.shape[1])
            total += past.take(at)
            past[at] = total
            pace = -self.rate / np.sqrt(total)
            gradient *= pace if value.ndim == 1 else pace[:, None]
            gradient += value.take(at, 0)
            value[at] = gradient

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """A batch: u is the word before each w, v the one before that; all its words share one draw of noise."""
        m = self.m
        noise = np.minimum(self.upto.searchsorted(self.rng.random(NOISE) * self.upto[-1]), len(m.noise) - 1)
        r, qw, qn = m.x.take(u, 0), m.q.take(w, 0), m.q.take(noise, 0)
        r += m.y.take(v, 0)
        bias = m.b - self.log_noise
        good = _sigmoid_of_minus(np.einsum("ij,ij->i", r, qw) + bias.take(w))
        bad = r @ qn.T
        bad = _sigmoid_of_minus(np.subtract(-bias.take(noise), bad, out=bad))
        dr = bad @ qn
        qw *= good[:, None]
        dr -= qw
        more = bad.T @ r
        r *= -good[:, None]
        self._step(np.concatenate((w, noise)), q=np.concatenate((r, more)), b=np.concatenate((-good, bad.sum(0))))
        self._step(u, x=dr)
        self._step(v, y=dr)


def _contexts(ids: np.ndarray, edge: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the one before that."""
    padded = np.concatenate(([start, start], ids))
    u, v = padded[1:-1].copy(), padded[:-2].copy()
    head = edge[:-1]
    u[head] = v[head] = start
    second = head[np.diff(edge) > 1] + 1
    v[second] = start
    return u, v


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x.as_buffer()) // 2 for x in column], np.int64)
    ids = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in column]) if len(size) else np.zeros(0, np.uint16)
    return ids.astype(np.int64), np.append(0, np.cumsum(size))


def _mean(models) -> tuple[int, np.ndarray | None]:
    """Tokens and the mean by tokens of models given as (tokens, bytes)."""
    tokens, total = 0, None
    for n, raw in models:
        part = np.frombuffer(raw, np.float32).astype(np.float64) * n
        tokens, total = tokens + n, part if total is None else total + part
    return tokens, (total / tokens).astype(np.float32) if tokens else None


def train(encoded: DataFrame, model: Model) -> Model:
    """Rounds over the training rows."""
    spark = encoded.sparkSession
    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.noise, model.flat()))

        def steps(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            own = model_of(*sent.value)
            trainer, seen = Trainer(own, number * 1_000_003 + TaskContext.get().partitionId(), RATE * (1 - number / ROUNDS)), 0
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    ids, edge = _joined(batch.column(0).slice(at, 128))
                    u, v = _contexts(ids, edge, len(own.noise))
                    for k in range(0, len(ids), BATCH):
                        trainer.learn(u[k : k + BATCH], v[k : k + BATCH], ids[k : k + BATCH])
                    seen += len(ids)
            if seen:
                yield pa.RecordBatch.from_pydict({"tokens": [seen], "values": [own.flat().tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, values = _mean((n, raw.as_buffer()) for batch in batches for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            if n:
                yield pa.RecordBatch.from_pydict({"tokens": [n], "values": [values.tobytes()]})

        kind = "tokens long, values binary"
        rows = encoded.where(~F.col("held_out")).select("ids")
        models, tasks = rows.mapInArrow(steps, kind), rows.rdd.getNumPartitions()
        while tasks > FAN_IN:  # a sum takes about FAN_IN models at a time, in as many levels as that needs
            tasks = -(-tasks // FAN_IN)
            models = models.repartition(tasks).mapInArrow(add, kind)
        summed = models.collect()  # FAN_IN rows of the model's size
        seen, values = _mean((r["tokens"], r["values"]) for r in summed)
        if seen:
            model = model_of(model.noise, values)
        sent.unpersist()
    return model


_tables: dict[int, tuple] = {}


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a document."""
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(name) % 10 == 0).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = word_counts(split)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()  # a fixed number of rows
    word, count = (np.asarray(top.column(k).to_numpy(), np.int64) for k in ("word", "n"))
    vocabulary = min(VOCABULARY, len(word))
    rest = max(float(n - count[:vocabulary].sum()), 0.0)
    kinds = v - vocabulary
    unknown_log = float(np.log10(rest + ALPHA * (kinds + 1)))
    mass = np.append(count[:vocabulary] + ALPHA, rest + ALPHA * (kinds + 1))
    model = Model(mass / mass.sum())
    known = spark.sparkContext.broadcast(Known(word, count, vocabulary))
    encoded = _encoded(split, known, vocabulary)
    model = train(encoded, model)
    sent = spark.sparkContext.broadcast((model.noise, model.flat()))
    others = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    met = others.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + ALPHA)).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise, values = sent.value
        key = hash(values.tobytes())
        if key not in _tables:
            _tables.clear()
            _tables[key] = model_of(noise, values).log10_tables()
        first, second, normal = _tables[key]
        for batch in batches:
            out, unknown = [], []
            for at in range(0, batch.num_rows, 256):
                ids, edge = _joined(batch.column(1).slice(at, 256))
                u, w = _contexts(ids, edge, len(noise))
                value = first[u, ids].astype(np.float64) + second[w, ids] - normal[u, w]
                out.append(np.add.reduceat(value, edge[:-1]))
                unknown.append(np.add.reduceat((ids == len(noise) - 1).astype(np.int64), edge[:-1]))
            rows = (np.concatenate(x) if x else np.zeros(0) for x in (out, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, (pa.float64(), pa.int64()), strict=True))], names=["row", "model_log", "unknown"])

    scored = encoded.select("row", "ids").mapInArrow(score, "row long, model_log double, unknown long")
    plain = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "unknown_logs")
    out = plain.join(scored, "row").join(rare, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(n + ALPHA * (v + 1)))).alias("base_score"),
        (F.col("model_log") + F.col("unknown_logs") + rare_logs - F.col("unknown") * unknown_log).alias("score"),
    )


def op7_lm_scores(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
