"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most e edits shares at least ``m - q + 1 - q * e`` of its
q-grams with it, all on diagonals at most 2e apart. Every text is normalised (ASCII lower case, white space runs as one
space) and its q-grams are looked up among the benchmark's. Shared q-grams are counted per item in diagonal bins of
2e + 1; two neighbouring bins are a band, bands overlap, and a region is retained if its band reaches the bound. Bins are
first counted in a hashed table, which can only count too many, then exactly. Retained regions are verified by an
alignment within the band.

The benchmark is a query set, not the corpus: its size is measured, and it is sent to the tasks in blocks of about
``BLOCK_BYTES``, one pass over the documents a block, one block at a time. Documents are never shuffled. Items of fewer than ``Q``
normalised bytes have no q-gram; they are searched for exactly, as whole words.

Defined results: null and empty texts match nothing, null and empty items are found nowhere; a very long text is searched whole;
of occurrences that tie in edits one is reported; a repeated document gives its rows again, equal items are reported each under its
id (null too); empty tables give an empty result; only ``doc_id``, ``text`` and ``item_id``, ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.llm import textops
from heliofield.llm.runtime import save, table

Q = 7
EDIT_SHARE = 0.1
BLOCK_BYTES = 4 << 20
#: A document is only removed for an item of so many bytes of normal text.
REMOVES = 24
_MASK = np.uint64((1 << (8 * Q)) - 1)
_TABLE_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 22
RESULT = "doc_id long, item_id long, start long, end long, edits long"


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, offsets, and each byte's place in ``data``."""
    space = textops._SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    cut = offsets[:-1][offsets[:-1] < len(data)]
    keep[cut] = ~space[cut]
    place = np.flatnonzero(keep)
    out = textops.LOWER[data[place]]
    out[space[place]] = 0x20
    return out, np.searchsorted(place, offsets), place


def qgrams(data: np.ndarray) -> np.ndarray:
    """The q bytes from each place on as one number; zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data),), (1,)) & _MASK


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = EDIT_SHARE):
        cleaned, short = [], []
        for item, text in items:
            data = np.frombuffer(text, np.uint8)
            out, _, _ = normal(data, np.array([0, len(data)]))
            out = out[:-1] if len(out) and out[-1] == 0x20 else out
            (cleaned if len(out) >= Q else short).append((item, out))
        self.ids = [i for i, _ in cleaned] + [i for i, _ in short]
        self.removes = [len(t) >= REMOVES for _, t in cleaned] + [False] * len(short)
        self.short = [(len(cleaned) + k, t.tobytes().strip()) for k, (_, t) in enumerate(short) if t.tobytes().strip()]
        self.text = [t for _, t in cleaned]
        size = np.array([len(t) for t in self.text], np.int64)
        self.size = size
        self.edits = np.minimum((size * share).astype(np.int64), (size - Q) // Q)
        self.bound = size - Q + 1 - Q * self.edits
        self.width = 2 * self.edits + 1
        if not cleaned:
            return
        value = np.concatenate([qgrams(t)[: len(t) - Q + 1] for t in self.text])
        item = np.repeat(np.arange(len(size)), size - Q + 1)
        where = np.concatenate([np.arange(n - Q + 1) for n in size])
        order = np.argsort(value, kind="stable")
        self.item, self.where = item[order], where[order]
        self.value, self.at, self.count = np.unique(value[order], return_index=True, return_counts=True)
        slot = self._slot(self.value)
        self.table = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.shared = np.zeros(1 << _TABLE_BITS, bool)
        self.shared[slot[self.table[slot] != np.arange(len(slot))]] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return ((value * _MULT) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def lookup(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram is in the index, and which it is."""
        slot = self._slot(value)
        gram = self.table[slot]
        place = np.flatnonzero(gram >= 0)
        gram = gram[place].astype(np.int64)
        mixed = np.flatnonzero(self.shared[slot[place]])
        if len(mixed):
            gram[mixed] = np.minimum(np.searchsorted(self.value, value[place[mixed]]), len(self.value) - 1)
        same = self.value[gram] == value[place]
        return place[same], gram[same]

    def hits(self, place: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, diagonal) of every shared q-gram, in chunks of bounded size."""
        count = self.count[gram]
        upto = np.cumsum(count)
        i = 0
        while i < len(place):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _CHUNK, "right")))
            c = count[i:j]
            flat = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c - self.at[gram[i:j]], c)
            p = np.repeat(place[i:j], c)
            yield p, self.item[flat], p - self.where[flat]
            i = j


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``text`` on diagonals low..high, or None."""
    n = high - low + 1
    step = 1 << 20
    far = np.int64(1) << 40
    lane = np.arange(n)
    padded = np.full(len(item) + n + 1, 256, np.int16)
    a, b = max(0, low), min(len(text), low + len(padded))
    if a < b:
        padded[a - low : b - low] = text[a:b]
    ends = low + lane  # the text position a lane stands at, before any item byte
    cost = np.where((ends >= 0) & (ends <= len(text)), lane.astype(np.int64), far)
    for i, x in enumerate(item):
        new = cost + np.where(padded[i : i + n] == x, 0, step)
        new[:-1] = np.minimum(new[:-1], cost[1:] + step)
        new = np.minimum.accumulate(new - lane * step) + lane * step
        cost = np.where(ends + i + 1 <= len(text), new, far)
        if cost.min() >= (most + 1) * step:
            return None
    k = int(np.argmin(cost))
    edits, origin = divmod(int(cost[k]), step)
    return (edits, low + origin, low + k + len(item)) if edits <= most else None


def _short(index: Index, out: np.ndarray, cuts: np.ndarray, origin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Items too short for the lemma: their first exact occurrence as whole words in each text."""
    raw = out.tobytes() if index.short else b""
    for k, item in index.short:
        at, last = raw.find(item), -1
        while at >= 0:
            d, end = int(np.searchsorted(cuts, at, "right")) - 1, at + len(item)
            whole = end <= cuts[d + 1] and (at == cuts[d] or raw[at - 1] == 0x20) and (end == cuts[d + 1] or raw[end] == 0x20)
            if whole and d != last:
                last = d
                yield d, k, int(origin[at]), int(origin[end - 1]) + 1, 0
            at = raw.find(item, at + 1)


def search(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) with places in ``data``; the best occurrence of each item in each text."""
    out, cuts, origin = normal(data, offsets)
    yield from _short(index, out, cuts, origin)
    if len(out) < Q or not index.text:
        return
    place, gram = index.lookup(qgrams(out))
    doc = np.searchsorted(cuts, place, "right") - 1
    inside = place + Q <= cuts[doc + 1]
    place, gram = place[inside], gram[inside]
    shift = int(index.size.max()) + 1
    keyed = lambda item, bin_: (((bin_.astype(np.uint64) << np.uint64(24)) ^ item.astype(np.uint64)) * _MULT) >> np.uint64(64 - _TABLE_BITS)
    counts = np.zeros(1 << _TABLE_BITS, np.int64)
    # diagonals are places in the slab, so texts are apart by their places
    for _, item, diagonal in index.hits(place, gram):
        counts += np.bincount(keyed(item, (diagonal + shift) // index.width[item]).astype(np.int64), minlength=len(counts))
    found: list[tuple[np.ndarray, ...]] = []
    for p, item, diagonal in index.hits(place, gram):
        bin_ = (diagonal + shift) // index.width[item]
        own = counts[keyed(item, bin_).astype(np.int64)]
        ok = np.flatnonzero(2 * own >= index.bound[item])  # the fuller half of a band
        item, bin_, own, p, where = item[ok], bin_[ok], own[ok], p[ok], (p - diagonal)[ok]
        side = np.maximum(counts[keyed(item, bin_ - 1).astype(np.int64)], counts[keyed(item, bin_ + 1).astype(np.int64)])
        full = own + side >= index.bound[item]
        found.append((np.searchsorted(cuts, p[full], "right") - 1, item[full], bin_[full], side[full], where[full]))
    if not found or not sum(len(x[0]) for x in found):
        return
    doc, item, bin_, side, where = (np.concatenate(c) for c in zip(*found, strict=True))
    region = (doc * len(index.ids) + item) * (int(bin_.max()) + 1) + bin_
    # each of the item's q-grams counts once in a bin, however often a periodic text repeats it
    _, once = np.unique(region * (shift + 1) + where, return_index=True)
    _, at, number = np.unique(region[once], return_index=True, return_counts=True)
    at = once[at]
    doc, item, bin_ = doc[at], item[at], bin_[at]
    # exact in the bin itself; the neighbour's count is at most what the hashed table has
    full = np.flatnonzero((2 * number >= index.bound[item]) & (number + side[at] >= index.bound[item]))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in full[np.argsort(-number[full], kind="stable")]:
        d, i, b = int(doc[k]), int(item[k]), int(bin_[k])
        if best.get((d, i), (1,))[0] == 0:
            continue
        most, width = int(index.edits[i]), int(index.width[i])
        text = out[cuts[d] : cuts[d + 1]]
        low = b * width - shift - int(cuts[d]) - width
        area = max(0, low)
        exact = text[area : max(0, low + 3 * width) + len(index.text[i])].tobytes().find(index.text[i].tobytes())
        got = (0, area + exact, area + exact + len(index.text[i])) if exact >= 0 else align(index.text[i], text, low, low + 3 * width, most)
        if got and ((d, i) not in best or got < best[d, i]):
            best[d, i] = got
    for (d, i), (edits, start, end) in sorted(best.items()):
        first, last = int(origin[cuts[d] + start]), int(origin[cuts[d] + max(start, end - 1)]) + 1
        yield d, i, first, last, edits


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in blocks of ``block_bytes`` or so; at least one, which may be empty."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits: the best occurrence of each item in each document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, waiting = [], None
    for block in _blocks(benchmark, block_bytes):
        if waiting is not None:  # more than one block: one after another, so that only one is in memory
            parts.append(save(waiting[0], "leaks"))
            waiting[1].unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(block)
        waiting = _pass(source, sent, share), sent
    return reduce(DataFrame.unionByName, [*parts, waiting[0]])


def _found(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first and last code point, edits) over a column of texts."""
    data, offsets = textops.utf8(column)
    for i, j in textops.slabs(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for d, item, start, end, edits in search(index, part, own):
            chars = lambda a, b: int(np.count_nonzero((part[a:b] & 0xC0) != 0x80))  # noqa: B023, E731
            first = chars(own[d], start)
            yield i + d, item, first, first + chars(start, end), edits


def _pass(source: DataFrame, block, share: float) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block.value, share)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[d], index.ids[item], *place) for d, item, *place in _found(index, batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

    return source.mapInArrow(find, RESULT)


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item of ``REMOVES`` bytes or more: each is judged by its own text, whatever its ``doc_id``. Shorter items, a word
    or two that any text may hold, are reported by ``contaminated`` only.

    Rows are filtered where they are read; a benchmark of several blocks takes a saved pass a block."""
    at = docs.columns.index("text")
    left, sent = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), None
    for block in _blocks(benchmark, block_bytes):
        if sent is not None:
            left = save(left, "clean")
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, share)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, item, *_ in _found(index, batch.column(at)) if index.removes[item]]] = False
                yield batch.filter(pa.array(clean))

        left = left.mapInArrow(keep, left.schema)
    return left.toDF(*docs.columns)


def op8_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
