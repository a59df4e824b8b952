"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are runs of five words. Their document frequencies are counted over all documents in hashed counters. A group of near copies
   counts about once: a document's weight in the count is one over the number of documents that share one of its ``SKETCHES`` least
   shingles (hashed counters too), so a large group of copies doesn't look less alike than a small one.
2. A shingle weighs tf * idf with idf = 1 + log(N / df), where a df below N / ``RARE`` reads as N / ``RARE``. The number of counters is
   ``LOAD`` * ``RARE`` times the mean number of shingles a document, so their mean load is at most 1 / ``LOAD`` of the least df that is told
   apart, at any number of documents: what is broadcast grows with the length of a document, not with the corpus, up to ``MOST_BITS``.
3. ``BANDS`` * ``ROWS`` consistent weighted samples a document are banded into buckets. Texts that are equal are one
   text from here on.
4. A bucket of at most ``GROUP`` texts and ``GROUP_BYTES`` is compared in one task, where a matrix product gives its exact similarities and
   only a spanning set of links leaves; buckets of the same texts are compared once. In a larger bucket, all texts are compared with its least,
   those alike leave, and the rest is dealt into the buckets of a further, independent set of bands, ``LEVELS`` times at most; what is still
   larger is compared by blocks. A text that left and one that stayed are compared too where the triangle inequality of the weighted
   Jaccard distance allows a link. No list of all pairs is made.
5. Links need an exact weighted Jaccard similarity of ``SIMILARITY``; classes are their connected components, over texts.

Defined results: null texts are empty, and empty texts are copies of each other; a text of fewer than five words is one shingle; a very long
text is read whole; a class is named by the least ``doc_id`` of its rows; rows without a ``doc_id`` belong to classes, but have no row in
``near_duplicates``; repeated rows of one ``doc_id`` give one row there (the class of the text with the least digest); of texts that tie the
one with the least digest counts; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliofield.llm import textops
from heliofield.operators.graph import components
from heliofield.llm.runtime import save, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Frequencies below one document in ``RARE`` read as that; counters carry at most 1 / ``LOAD`` of it on average.
RARE, LOAD = 1024, 4
LEAST_BITS, MOST_BITS = 12, 24
SKETCHES, SKETCH_BITS = 3, 20
#: Candidate groups of at most this many texts, and bytes of shingles, are compared in one task, by one matrix product.
GROUP, GROUP_BYTES = 1024, 64 << 20
LEVELS = 3
#: A leader's pairs are dealt over this many tasks.
SALTS = 16
_COLUMNS = 4096
_PART = 1 << 14
_DRAWS = 1 << 16


def shingles(words: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a slab with counts: text number, 32-bit shingle, tf; sorted."""
    at, doc = textops.inside(words.first, SHINGLE)
    value = (textops.grams(words.hash, SHINGLE)[at] >> np.uint64(32)) if len(at) else np.zeros(0, np.uint64)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        total = np.array([textops.mix(np.bitwise_xor.reduce(textops.mix(words.hash[words.first[d] : words.first[d + 1]] + np.arange(n[d], dtype=np.uint64)), keepdims=True))[0] for d in short])
        doc, value = np.append(doc, short), np.append(value, total >> np.uint64(32))
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(32)) | value, return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), count


def _slab_shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = textops.utf8(column)
    for i, j in textops.slabs(offsets):
        yield i, j, *shingles(textops.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def sketches(value: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """The least hash of each text's shingles under ``SKETCHES`` hash functions."""
    wide = value.astype(np.uint64)
    return [np.minimum.reduceat(textops.mix(wide + np.uint64((k + 1) << 40)), edge) for k in range(SKETCHES)] if len(edge) else [np.zeros(0, np.uint64)] * SKETCHES


def _slots(sketch: list[np.ndarray]) -> list[np.ndarray]:
    return [(textops.mix(x) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + (k << SKETCH_BITS) for k, x in enumerate(sketch)]


def _edges(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Counters summed over the tasks; ``parts`` has (part, counts): ``_PART`` counters a part, int64."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = np.frombuffer(raw.as_buffer(), np.int64)
                sums[key] = sums[key] + block if key in sums else block.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"part": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    out = np.zeros(size, np.int64)
    for r in parts.repartition("part").mapInArrow(add, "part long, counts binary").collect():  # ``size`` counters
        block = np.frombuffer(r["counts"], np.int64)
        out[r["part"] * _PART : r["part"] * _PART + len(block)] = block
    return out


def _emitted(seen: np.ndarray) -> pa.RecordBatch:
    """The parts of a task's counters that aren't all zero."""
    blocks = [(k // _PART, seen[k : k + _PART]) for k in range(0, len(seen), _PART)]
    blocks = [(k, b.tobytes()) for k, b in blocks if b.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int64()), pa.array([b for _, b in blocks], pa.binary())], names=["part", "counts"])


def sketch_counts(texts: DataFrame) -> np.ndarray:
    """Hashed counts of all documents' sketches; at the end the numbers of documents with a word, and of their distinct shingles."""
    size = SKETCHES << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, docs, total = [], 0, 0
        for batch in batches:
            for _, _, doc, value, _ in _slab_shingles(batch.column(0)):
                edge = _edges(doc)
                docs, total = docs + len(edge), total + len(value)
                slots += _slots(sketches(value, edge))
        if docs:
            yield _emitted(np.append(np.bincount(np.concatenate(slots), minlength=size), [docs, total]).astype(np.int64))

    return _summed(texts.mapInArrow(count, "part long, counts binary"), size + 2)


def document_weights(sketch: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """What each document counts for in the frequencies, in 4096ths: one over the documents that share a sketch with it, beyond the counters' load."""
    load = counts[-2] / 2**SKETCH_BITS
    same = np.max([counts[s] for s in _slots(sketch)], axis=0) - load - 4 * np.sqrt(load) if len(sketch[0]) else np.zeros(0)
    return (4096 / np.maximum(same, 1)).astype(np.int64)


def frequency_bits(counts: np.ndarray) -> int:
    mean = counts[-1] / max(int(counts[-2]), 1)
    return int(np.clip(np.ceil(np.log2(max(LOAD * RARE * mean, 1))), LEAST_BITS, MOST_BITS))


def document_frequencies(texts: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Hashed document frequencies of all shingles in 4096ths, and the documents' summed weight at the end."""
    size = 1 << frequency_bits(counts)
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, doc, value, _ in _slab_shingles(batch.column(0)):
                edge = _edges(doc)
                weight = document_weights(sketches(value, edge), sent.value)
                per = np.repeat(weight, np.diff(np.append(edge, len(value))))
                seen[:-1] += np.bincount(value & np.uint32(size - 1), per, minlength=size).astype(np.int64)
                seen[-1] += weight.sum()
        if seen.any():
            yield _emitted(seen)

    out = _summed(texts.mapInArrow(count, "part long, counts binary"), size + 1)
    sent.unpersist()
    return out


def idf_table(frequencies: np.ndarray) -> np.ndarray:
    n = max(float(frequencies[-1]), 4096.0)
    df = np.clip(frequencies[:-1].astype(np.float64), max(4096.0, n / RARE), n)
    return (1 + np.log(n / df)).astype(np.float16).astype(np.float32)


def weights_of(texts: DataFrame) -> np.ndarray:
    """The table of idf by shingle."""
    return idf_table(document_frequencies(texts, sketch_counts(texts)))


class Sampler:
    """Consistent weighted samples; draws come from tables of ``_DRAWS`` entries a sample."""

    _made: dict[tuple[int, int, int], Sampler] = {}

    def __init__(self, bands: int, rows: int, level: int = 0):
        rng = np.random.Generator(np.random.PCG64(731 + level))
        n = bands * rows
        log = lambda: np.log(rng.random((n, _DRAWS)) + 1e-12) + np.log(rng.random((n, _DRAWS)) + 1e-12)
        self.r = (-log()).astype(np.float32)
        self.log_c = np.log(-log()).astype(np.float32)
        self.beta = rng.random((n, _DRAWS)).astype(np.float32)
        self.multiply = rng.integers(0, 2**31, (n, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.bands, self.rows = bands, rows

    @classmethod
    def get(cls, bands: int, rows: int, level: int = 0) -> Sampler:
        if (bands, rows, level) not in cls._made:
            cls._made[bands, rows, level] = cls(bands, rows, level)
        return cls._made[bands, rows, level]

    def buckets(self, value: np.ndarray, log_weight: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Band hashes (texts x bands); ``edge``: where each text's shingles begin."""
        n = len(edge)
        size = np.diff(np.append(edge, len(value)))
        out = np.zeros((n, self.bands), np.uint64)
        owner = np.repeat(np.arange(n), size)
        for k in range(self.bands * self.rows):
            x = (value ^ (value >> np.uint32(15))) * self.multiply[k, 0]
            draw = ((x ^ (x >> np.uint32(13))) * self.multiply[k, 1]) >> np.uint32(16)
            r, beta = self.r[k][draw], self.beta[k][draw]
            t = np.floor(log_weight / r + beta)
            a = self.log_c[k][draw] - r * (t - beta) - r
            low = np.minimum.reduceat(a, edge)
            hit = np.flatnonzero(a == low[owner])
            first = hit[np.searchsorted(owner[hit], np.arange(n))]
            sample = value[first].astype(np.uint64) | (t[first].astype(np.int64).astype(np.uint64) << np.uint64(32))
            b = k // self.rows
            out[:, b] = textops.mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + sample + np.uint64(k + 1))
        return out.view(np.int64)


def _bucketed(value: np.ndarray, tf: np.ndarray, edge: np.ndarray, log_idf: np.ndarray, sampler: Sampler) -> np.ndarray:
    return sampler.buckets(value, log_idf[value & np.uint32(len(log_idf) - 1)] + np.log(tf).astype(np.float32), edge)


def _lists(per: np.ndarray, found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def _signed(texts: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, size, buckets) of every row; ``size`` is the number of shingles, ``buckets`` is empty without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_idf, sampler = np.log(idf.value.astype(np.float32)), Sampler.get(bands, rows)
        for batch in batches:
            per, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            found = []
            for i, _, doc, value, tf in _slab_shingles(batch.column(2)):
                if len(doc):
                    edge = _edges(doc)
                    per[i + doc[edge]] = bands
                    size[i + doc[edge]] = np.add.reduceat(tf, edge)
                    found.append(_bucketed(value, tf, edge, log_idf, sampler).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), _lists(per, found)], names=["doc_id", "digest", "size", "buckets"])

    return texts.mapInArrow(sign, "doc_id long, digest string, size long, buckets array<long>")


def _dealt(features: DataFrame, idf, bands: int, rows: int, level: int) -> DataFrame:
    """(node, buckets) by the bands of a further level, from saved shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_idf, sampler = np.log(idf.value.astype(np.float32)), Sampler.get(bands, rows, level)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [np.unique(np.frombuffer(x.as_buffer(), np.uint32), return_counts=True) for x in part.column(1)]
                size = np.array([len(v) for v, _ in own], np.int64)
                value, tf = (np.concatenate([x[k] for x in own]) for k in (0, 1))
                keys = _bucketed(value, tf, np.cumsum(size) - size, log_idf, sampler).ravel()
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(np.full(part.num_rows, bands), [keys])], names=["node", "buckets"])

    return features.select("node", "shingles").mapInArrow(sign, "node long, buckets array<long>")


def _features(texts: DataFrame) -> DataFrame:
    """(node, shingles): sorted shingles, each as often as it occurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for i, j, doc, value, tf in _slab_shingles(batch.column(1)):
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    own = slice(edge[d], edge[d + 1])
                    out[i + d] = np.repeat(value[own], tf[own]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(read, "node long, shingles binary")


def weighted_jaccard(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """The weighted Jaccard similarity of two texts' shingles, by tf * idf."""
    x, nx = np.unique(np.frombuffer(a, np.uint32), return_counts=True)
    y, ny = np.unique(np.frombuffer(b, np.uint32), return_counts=True)
    mask = np.uint32(len(idf) - 1)
    wx, wy = nx * idf[x & mask], ny * idf[y & mask]
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(wx[i], wy[j]).sum(dtype=np.float64))
    total = float(wx.sum(dtype=np.float64) + wy.sum(dtype=np.float64)) - both
    return both / total if total else 1.0


def _verified(pairs: DataFrame, features: DataFrame, idf) -> DataFrame:
    """(a, b, similarity) of distinct pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value.astype(np.float32)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([weighted_jaccard(x.as_buffer(), y.as_buffer(), weight) for x, y in zip(*batch.columns[2:], strict=True)], pa.float64())], names=["a", "b", "similarity"])

    # leaders are few, and a third of all texts may have one leader
    leaders = features.join(pairs.select(F.col("a").alias("node")).distinct(), "node")
    one = leaders.select(F.col("node").alias("a"), F.col("shingles").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    two = features.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(two, "b").join(one, ["a", "salt"]).select("a", "b", "left", "right").mapInArrow(compare, "a long, b long, similarity double")


def local_links(ids: list[int], blobs: list[bytes], idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(text, least text of its component) in one small group, by exact similarities from matrix products."""
    m = len(ids)
    values = [np.frombuffer(b, np.uint32) for b in blobs]
    size = np.array([len(v) for v in values])
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(values)
    begin = np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))
    at = np.arange(len(flat))
    again = at - np.maximum.accumulate(np.where(begin, at, 0))  # a shingle's n-th occurrence is an element of its own
    key, inverse, count = np.unique((flat.astype(np.uint64) << np.uint64(32)) | again.astype(np.uint64), return_inverse=True, return_counts=True)
    weight = idf[(key >> np.uint64(32)).astype(np.uint32) & np.uint32(len(idf) - 1)].astype(np.float64)
    total = np.bincount(owner, weight[inverse], minlength=m)
    common = count > 1
    column = np.cumsum(common) - 1
    held = common[inverse]
    row, col = owner[held], column[inverse[held]]
    order = np.argsort(col, kind="stable")
    row, col, n = row[order], col[order], int(common.sum())
    both = np.zeros((m, m))
    for c in range(0, n, _COLUMNS):
        a, b = np.searchsorted(col, (c, c + _COLUMNS))
        x = np.zeros((m, min(_COLUMNS, n - c)))
        x[row[a:b], col[a:b] - c] = 1
        both += (x * weight[common][c : c + _COLUMNS]) @ x.T
    alike = both >= similarity * (total[:, None] + total[None, :] - both) - 1e-9
    np.fill_diagonal(alike, True)
    order = np.argsort(ids, kind="stable")
    label = np.empty(m, np.int64)
    label[order] = np.arange(m)
    while True:
        new = np.where(alike, label[None, :], m).min(axis=1)
        if (new == label).all():
            break
        label = new
    least = np.asarray(ids)[order]
    return [(int(a), int(least[k])) for a, k in zip(ids, label, strict=True) if a != least[k]]


def _linked(groups: DataFrame, features: DataFrame, idf, similarity: float) -> DataFrame:
    """(a, b) links that join every group's alike texts; ``groups``: bucket, node, at most ``GROUP`` texts each."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, blobs = None, [], []

        def flush() -> pa.RecordBatch:
            found = local_links(ids, blobs, idf.value.astype(np.float32), similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for group, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if group != name:
                    if ids:
                        yield flush()
                    name, ids, blobs = group, [], []
                ids.append(doc)
                blobs.append(blob.as_py())
        if ids:
            yield flush()

    keyed = groups.join(features, "node").select("bucket", "node", "shingles")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(link, "a long, b long")


def _parts(group: int) -> Column:
    """Blocks of at most about half a group's texts and bytes."""
    return F.greatest(F.lit(1), F.ceil(F.count("*") / (group // 2)), F.ceil(F.sum(4 * F.col("size")) / (GROUP_BYTES // 2))).cast("int")


def _blocks(groups: DataFrame, group: int) -> DataFrame:
    """(bucket, node) groups, a pair of blocks each, that bring all texts of every bucket together; ``groups``: bucket, node, size."""
    cells = groups.groupBy("bucket").agg(_parts(group).alias("parts"))
    dealt = groups.join(cells, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select(F.xxhash64("bucket", F.least("part", "with"), F.greatest("part", "with")).alias("bucket"), "node")


def _border(judged: DataFrame, classes: DataFrame, similarity: float, group: int) -> DataFrame:
    """(bucket, node) groups of those that left with a leader and those that stayed though a link to one that left is possible.

    The texts that left are all of the leader's class, so only texts of other classes count as stayed. By the triangle inequality, two are
    alike only if their distances to the leader differ by at most 1 - similarity. Texts are dealt into blocks by that distance and at
    random, and a group is a pair of blocks that the bound allows."""
    far = 1 - similarity
    step = far / 4
    named = classes.select("node", F.col("component").alias("class"))
    leader = classes.select(F.col("node").alias("a"), F.col("component").alias("a_class"))
    near = judged.where(F.col("similarity") >= 1 - 2 * far - 1e-9).select("bucket", "a", F.col("b").alias("node"), "size", (1 - F.col("similarity")).alias("d"), (F.col("similarity") >= similarity).alias("left"))
    near = near.join(named, "node", "left").join(leader, "a", "left").withColumn("class", F.coalesce("class", "node")).withColumn("a_class", F.coalesce("a_class", "a"))
    near = near.where("left or class <> a_class").withColumn("cell", F.floor(F.col("d") / step).cast("int"))
    key = ["bucket", "a", "left", "cell"]
    cells = near.groupBy(*key).agg(_parts(group).alias("parts"))
    dealt = near.join(cells, key).select(*key, "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    blocks = cells.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = blocks.where("left").select("bucket", "a", F.col("cell").alias("c1"), F.col("part").alias("p1"))
    two = blocks.where("not left").select("bucket", "a", F.col("cell").alias("c2"), F.col("part").alias("p2"))
    met = one.join(two, ["bucket", "a"]).where((F.col("c1") + 1) * step + far + 1e-9 >= F.col("c2") * step).withColumn("pair", F.xxhash64("bucket", "a", "c1", "p1", "c2", "p2"))
    wanted = met.select("bucket", "a", F.lit(True).alias("left"), F.col("c1").alias("cell"), F.col("p1").alias("part"), "pair").unionByName(met.select("bucket", "a", F.lit(False).alias("left"), F.col("c2").alias("cell"), F.col("p2").alias("part"), "pair"))
    return dealt.join(wanted, [*key, "part"]).select(F.col("pair").alias("bucket"), "node")


def _counted(entries: DataFrame) -> DataFrame:
    """``entries`` (bucket, node, size) with their bucket's texts and bytes, where there are two or more."""
    full = save(entries.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(4 * F.col("size")).alias("bytes")).where("n > 1"), "full")
    return save(entries.join(full, "bucket"), "buckets")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))


def text_classes(texts: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, group: int = GROUP, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, node, least, class): a row a distinct text with its least ``doc_id``; both saved."""
    spark = texts.sparkSession
    idf = spark.sparkContext.broadcast(weights_of(texts.select("text")).astype(np.float16))
    signed = save(_signed(texts.select("doc_id", "digest", "text"), idf, bands, rows), "signed")
    # equal texts are one text from here on; aggregates are saved before they are joined: both sides are then plain scans, and a
    # hot key's rows can be split over tasks
    distinct = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    distinct = save(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    entries = distinct.select("node", "size", F.posexplode("buckets").alias("band", "hash")).select("node", "size", F.xxhash64("band", "hash").alias("bucket"))
    open_ = _counted(entries)
    key = F.concat(F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    wanted = save(distinct.join(open_.select("node").distinct(), "node").select("node", "digest", F.col("least").alias("doc_id")).withColumn("key", key).select("node", "key"), "wanted").hint("merge")  # it grows with the corpus
    held = texts.withColumn("key", key).select("key", "text")
    if not signed.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        held = held.groupBy("key").agg(F.first("text").alias("text"))  # repeated rows
    features = save(_features(held.join(wanted, "key").select("node", "text")), "features")
    tight = (F.col("n") <= group) & (F.col("bytes") <= GROUP_BYTES)
    small, open_ = open_.where(tight).select("bucket", "node"), open_.where(~tight)
    known: list[DataFrame] = []
    judged: list[DataFrame] = []
    for level in range(1, levels + 1):
        if open_.isEmpty():
            break
        # everyone against the least text, those alike leave, the rest is dealt anew
        met = open_.join(save(open_.groupBy("bucket").agg(F.min("node").alias("a")), "leaders"), "bucket").where("node > a").withColumnRenamed("node", "b")
        known.append(save(_verified(met.select("a", "b").distinct(), features, idf), "known"))
        judged.append(save(met.join(known[-1], ["a", "b"]).select("bucket", "a", "b", "size", "similarity"), "judged"))
        rest = judged[-1].where(F.col("similarity") < similarity).select("bucket", F.col("b").alias("node"), "size")
        rest = _counted(rest)
        small = small.unionByName(rest.where(tight).select("bucket", "node"))
        rest = rest.where(~tight).select("bucket", "node", "size")
        again = _dealt(features.join(rest.select("node").distinct(), "node"), idf, bands, rows, level)
        open_ = _counted(rest.join(save(again, "dealt"), "node").select("node", "size", "bucket", F.posexplode("buckets").alias("band", "hash")).select("node", "size", F.xxhash64("bucket", "band", "hash").alias("bucket")))
        small, open_ = small.unionByName(open_.where(tight).select("bucket", "node")), open_.where(~tight)
    if known and not open_.isEmpty():
        small = small.unionByName(_blocks(open_.select("bucket", "node", "size"), group))
    # buckets of the same texts are compared once
    same = small.groupBy("bucket").agg(F.count("*").alias("k"), F.sum(F.pmod(F.xxhash64("node"), F.lit(2**40))).alias("h"), F.bit_xor(F.xxhash64("node")).alias("x")).groupBy("k", "h", "x").agg(F.min("bucket").alias("bucket")).where("k > 1").select("bucket")
    links = save(_linked(small.join(same, "bucket", "left_semi"), features, idf, similarity).distinct(), "links")
    for checked in known:
        links = links.unionByName(checked.where(F.col("similarity") >= similarity).select("a", "b"))
    classes = components(links)
    more = [save(_linked(_border(x, classes, similarity, group), features, idf, similarity).distinct(), "links") for x in judged]
    if any(not x.isEmpty() for x in more):
        for x in more:
            links = links.unionByName(x)
        classes = components(links)
    named = distinct.select("digest", "node", "least").join(classes, "node", "left").select("digest", "node", "least", F.coalesce("component", "node").alias("class"))
    return signed.select("doc_id", "digest"), save(named, "classes")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id: one row a document; a class is named by its least document."""
    members, texts = text_classes(_texts(docs), **how)
    # every aggregate is saved before it is joined, as in text_classes
    names = save(texts.groupBy("class").agg(F.min("least").alias("class_id")), "names")
    single = save(members.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest")), "single")
    return single.join(save(texts.join(names, "class").select("digest", "class_id"), "named"), "digest").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """One row of each class, with all its columns: a row of its least ``doc_id`` (one without an id only where the class has no other)."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # the rows' own columns may have any name
    plain = docs.toDF(*names)
    texts = _texts(plain.select(F.col(names[docs.columns.index("doc_id")]).alias("doc_id"), F.col(names[docs.columns.index("text")]).alias("text")))
    members, classes = text_classes(texts, **how)
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "digest")).alias("f"))
    key = lambda digest, doc_id: F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("")))
    kept = save(first.select(key(F.col("f.digest"), F.col("f.least")).alias("key")), "kept")
    text = F.coalesce(F.col(names[docs.columns.index("text")]).cast("string"), F.lit(""))
    left = plain.withColumn("key", key(F.md5(text), F.col(names[docs.columns.index("doc_id")]).cast("long"))).join(kept, "key", "left_semi")
    if not members.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["key"])
    return left.select(*names).toDF(*docs.columns)


def op6_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
