"""Repeated passages by sparse suffix arrays.

A suffix of a text is retained where its first ``K`` words are the minimiser of a window of ``W`` such runs, so any
passage of ``PASSAGE = K + W - 1`` words retains the same suffix in every text that holds it. Retained suffixes are
sorted by their first ``K`` words and equal neighbours of different documents are kept. Each kept suffix is then
extended left and right: the passages that hold it (at most ``W`` starts) are a run; equal runs are matched whole,
and runs of one suffix that differ are matched start by start. Overlapping matches are joined to spans.

Tasks sort their suffixes and merge equal neighbours to one row (lowest and highest document) before the pieces are dealt into ranges and sorted
whole, so a prefix that a third of all texts share is a few rows a task. Suffixes are sorted by a hash of their prefix, which puts equal ones
beside each other as the words' own order would; different runs of one prefix, not its occurrences, are expanded.
Nothing is sampled, and a passage is found if and only if ``PASSAGE`` or more words of it
occur in two documents. Words, prefixes and runs are compared by 64-bit hashes; a match needs the prefix and the run, or the prefix and the
passage, to agree, and runs are confirmed by a second, independent hash, so two that differ pass with a probability of about 2^-128.

Defined results: null and short texts hold no passage; a very long text is read whole; rows without a ``doc_id`` are documents of
their own, named null (rows of equal text are one); repeated rows of one ``doc_id`` are one document, so they don't repeat each other, and a
passage that occurs twice in one document only is no match; documents that tie are all reported; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.llm import textops
from heliofield.llm.runtime import save

K, W = 26, 25
PASSAGE = K + W - 1
_OTHER = np.uint64(0xA0761D6478BD642F)
_PIECE = 1 << 20


class Runs:
    """Of a slab: for each minimiser its position, and its run of passage starts ``first``..``last``."""

    def __init__(self, words: textops.Words):
        gram = textops.grams(words.hash, K)
        if len(gram) < W:
            self.at = self.doc = self.suffix = self.first = self.last = np.zeros(0, np.int64)
            return
        start, doc = textops.inside(words.first, PASSAGE)
        low = start + np.lib.stride_tricks.sliding_window_view(gram, W).argmin(axis=1)[start]
        new = np.ones(len(start), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1 if len(head) else head
        self.at, self.doc, self.first, self.last = low[head], doc[head], start[head], start[tail]
        self.suffix = gram[self.at].view(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.utf8(batch.column(2))
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
        for i, j in textops.slabs(offsets):
            words = textops.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            runs = Runs(words)
            if len(runs.at):
                place = runs.at - words.first[:-1][runs.doc]
                yield pa.RecordBatch.from_pydict({"rid": ids[0][i:j][runs.doc], "who": ids[1][i:j][runs.doc], "at": place.astype(np.int32), "suffix": runs.suffix})


def _runs_of(suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes, each once with its lowest and highest document."""
    edge = np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1]))
    return suffix[edge], np.minimum.reduceat(lo, edge), np.maximum.reduceat(hi, edge)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's suffixes in sorted pieces of ``_PIECE`` rows or so, equal neighbours as one row."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        suffix, who = (np.concatenate([x[k] for x in waiting]) for k in (0, 1))
        order = np.argsort(suffix)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _runs_of(suffix[order], who[order], who[order])], names=["suffix", "lo", "hi"])

    for batch in batches:
        waiting.append(tuple(batch.column(c).to_numpy() for c in (0, 1)))
        if sum(len(x[0]) for x in waiting) >= _PIECE:
            yield flush()
            waiting = []
    if sum(len(x[0]) for x in waiting):
        yield flush()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose sorted neighbours are equal and of other documents; a run may go over batches."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(batch.column(c).to_numpy() for c in range(3))
        suffix, lo, hi = _runs_of(*(rows if held is None else (np.concatenate(x) for x in zip(held, rows, strict=True))))
        held = (suffix[-1:], lo[-1:], hi[-1:])
        yield pa.RecordBatch.from_arrays([pa.array(suffix[:-1][lo[:-1] < hi[:-1]])], names=["suffix"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0][held[1] < held[2]])], names=["suffix"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        kept = batch.column(2)
        where = kept.offsets.to_numpy()
        values = kept.values.to_numpy(zero_copy_only=False)
        for i, j in textops.slabs(offsets):
            words = textops.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            runs = Runs(words)
            own = values[where[i] : where[j]] + np.repeat(words.first[:-1], np.diff(where[i : j + 1]))
            pick = np.isin(runs.at, own)
            if not pick.any():
                continue
            first, last, doc = runs.first[pick], runs.last[pick], runs.doc[pick]
            total = np.zeros(len(words.hash) + 1, np.uint64)
            np.cumsum(words.hash * textops._powers(textops._GRAM, len(words.hash)), out=total[1:])
            run = textops.mix((total[last + PASSAGE] - total[first]) * textops._powers(textops._GRAM_INV, len(words.hash))[first] + (last - first).astype(np.uint64))
            np.cumsum(textops.mix(words.hash ^ _OTHER) * textops._powers(textops._GRAM, len(words.hash)), out=total[1:])
            check = textops.mix((total[last + PASSAGE] - total[first]) * textops._powers(textops._GRAM_INV, len(words.hash))[first])
            count = last - first + 1
            edge = np.concatenate(([0], np.cumsum(count)))
            flat = np.arange(edge[-1]) - np.repeat(edge[:-1] - first, count)
            passage = textops.grams(words.hash, PASSAGE)[flat].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i:j][doc]), pa.array(runs.suffix[pick]), pa.array(run.view(np.int64)), pa.array(check.view(np.int64)), pa.array((first - words.first[:-1][doc]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(passage))],
                names=["who", "suffix", "run", "check", "start", "passages"],
            )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, runs = batch.column(0).to_pylist(), batch.column(1)
        out: list[tuple[int, int, int]] = []
        for doc, found in zip(ids, runs.to_pylist(), strict=True):
            starts = np.unique(np.concatenate([np.asarray(r["start"]) + (np.arange(r["n"]) if r["offsets"] is None else np.asarray(r["offsets"], np.int64)) for r in found]))
            cut = np.flatnonzero(np.diff(starts) > PASSAGE)
            out += [(doc, int(a), int(b) + PASSAGE) for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        start, end = (pa.array(c, pa.int64()) for c in columns[1:])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), start, end, pa.array([b - a for _, a, b in out], pa.int64())], names=["who", "start_word", "end_word", "n_words"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words: spans whose passages occur in another document too."""
    doc_id = F.col("doc_id").cast("long")
    named = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce(doc_id, F.xxhash64("text")).alias("who"), doc_id.isNotNull().alias("named"), F.col("text").cast("string").alias("text"))
    suffixes = save(named.select("rid", "who", "text").mapInArrow(_suffixes, "rid long, who long, at int, suffix long"), "suffixes")
    # aggregates are saved before they are joined: both sides are then plain scans, and a hot key's rows can be split over
    # tasks; they grow with the corpus, so they are merged, never broadcast
    pieces = suffixes.select("suffix", "who").mapInArrow(_sorted, "suffix long, lo long, hi long")
    ordered = pieces.repartitionByRange("suffix").sortWithinPartitions("suffix")
    shared = save(ordered.mapInArrow(_neighbours, "suffix long"), "shared").hint("merge")
    kept = suffixes.join(shared, "suffix").groupBy("rid").agg(F.collect_set("at").alias("kept"))  # as long as its text at most
    runs = save(named.join(kept, "rid").select("who", "text", "kept").mapInArrow(_extended, "who long, suffix long, run long, check long, start int, passages array<long>"), "runs")
    key = ["suffix", "run", "check"]
    kinds = save(runs.groupBy(*key).agg(F.min("who").alias("lo"), F.max("who").alias("hi"), F.first("passages").alias("passages")), "kinds")
    varied = save(kinds.groupBy("suffix").agg(F.count("*").alias("kinds")).where("kinds > 1").select("suffix"), "varied").hint("merge")
    starts = kinds.join(varied, "suffix").select(*key, "lo", "hi", F.posexplode("passages").alias("offset", "passage"))
    starts = starts.withColumn("mark", F.xxhash64("suffix", "passage"))  # not the suffix itself: its rows would stay where the join put them
    met = starts.groupBy("mark", "passage").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("mark", "passage")
    partly = save(starts.join(met, ["mark", "passage"]).groupBy(*key).agg(F.collect_set("offset").alias("offsets")), "partly").hint("merge")  # W at most
    whole = runs.join(varied, "suffix", "left_anti").select("who", "start", F.size("passages").alias("n"), F.lit(None).cast("array<int>").alias("offsets"))
    some = runs.join(partly, key).select("who", "start", F.size("passages").alias("n"), "offsets")
    by_doc = whole.unionByName(some).groupBy("who").agg(F.collect_list(F.struct("start", "n", "offsets")).alias("runs"))
    spans = by_doc.mapInArrow(_spans, "who long, start_word long, end_word long, n_words long")
    nameless = save(named.where("not named").select("who").distinct().withColumn("nameless", F.lit(True)), "nameless")
    return spans.join(nameless, "who", "left").select(F.when(F.col("nameless").isNull(), F.col("who")).alias("doc_id"), "start_word", "end_word", "n_words")


def op1_suffix_dedup(spark, sf_dir):
    from heliofield.llm.runtime import table

    return repeated_passages(table(spark, sf_dir, "documents"))
