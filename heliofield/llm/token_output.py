"""Token-ID output in training order.

Rows are sorted by (``doc_id``, hash of the text) in range partitions, and texts are tokenised once in that order (a public vocabulary file,
its path is a parameter); each ends with the end id. Ids are cut into sequences of ``LENGTH``; every task numbers its own, a prefix sum over
the tasks' totals makes the numbers global. A number is the count of sequences of all lesser rows, so it doesn't depend on how the input is
split. A keyed Feistel network over the next even number of bits, walked until it lands below the number of sequences, turns numbers into
slots: a bijection that needs no table and can be inverted. ``SHARD`` consecutive slots are a shard; a range of shards is one partition, and
slot s lies at byte ``(s mod SHARD) * stride`` of shard ``s div SHARD``.

``write_shards`` keeps the tokens and a manifest (input's digest, vocabulary, key, length, shard) beside the shards, deals the sequences once over waves of
consecutive shards, and writes these one by one, each committed whole. Called again it writes the missing waves only; with another input or key it refuses.

Defined results: a null or empty text gives no sequence; a very long text, also one long run of white space or of one letter, is tokenised whole and gives as many sequences as it needs; a null
``doc_id`` is kept, first in order; rows that tie (equal id and text) are interchangeable and each has its sequences in slots of their own;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read. The last sequence of a text is padded with the end id to
the stride; ``n_tokens`` says how many ids are its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliofield.llm import bpe, textops
from heliofield.llm.runtime import save, table

LENGTH = 512
SHARD = 1024
KEY = 0x5EED
ROUNDS = 6
#: A write is committed in this many steps.
WAVES = 16
VOCABULARY = os.environ.get("HELIOFIELD_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def encoder(path: str = VOCABULARY):
    """(encoding, end id) of a vocabulary; the end id is the first free one. Executors read the copy that was sent to them."""
    encoding, end, _ = bpe.encoder(path)
    return encoding, end


def _round(half: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    return textops.mix(half + np.uint64((key * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % 2**64)) & mask


def permute(number: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Slots of ``number`` (0 to n - 1), or with ``back`` the numbers of slots."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.asarray(number).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ _round(left, key, r, mask), left) if back else (right, left ^ _round(right, key, r, mask))
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _tokenised(docs: DataFrame, path: str, length: int) -> DataFrame:
    """(doc_id, task, first, sequences, ids): ``first`` is the task's own number of the text's first sequence."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = encoder(path)
        kind = np.uint16 if end < 2**16 else np.uint32
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.array([*bpe.encode(encoding, t.as_py()), end], kind) if t.is_valid and len(t.as_buffer()) else None for t in part.column(1)]
                count = np.array([-(-len(x) // length) if x is not None else 0 for x in ids], np.int64)
                first = seen + np.cumsum(count) - count
                seen += int(count.sum())
                kept = pa.array(count > 0)
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(ids), task)), pa.array(first), pa.array(count), pa.array([b"" if x is None else x.tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "task", "first", "sequences", "ids"],
                )
                yield out.filter(kept)

    docs.sparkSession.sparkContext.addFile(path)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal rows are interchangeable, so a third number may deal them over partitions
    keyed = source.where("octet_length(text) > 0").select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_first("doc_id"), "hash", "tie"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(tokens, "doc_id long, task long, first long, sequences long, ids binary")


def _numbered(made: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, number of the first sequence, sequences, ids), and the number of all sequences; ``made``: saved tokens."""
    totals = made.groupBy("task").agg(F.sum("sequences").alias("sequences"))  # 16 bytes a task
    base = totals.select("task", (F.sum("sequences").over(Window.orderBy("task")) - F.col("sequences")).alias("base"))
    n = totals.agg(F.sum("sequences").alias("n")).first()["n"] or 0
    return made.join(F.broadcast(base), "task").select("doc_id", (F.col("base") + F.col("first")).alias("number"), "sequences", "ids"), n


def _placed(numbered: DataFrame, n: int, path: str, length: int, shard: int, key: int, first: int = 0, last: int | None = None) -> DataFrame:
    """The sequences of slots first..last - 1 in ranges of shards, sorted by slot."""
    last = n if last is None else last

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, end = encoder(path)
        wide = 2 if end < 2**16 else 4
        pad = np.array([end], np.uint16 if wide == 2 else np.uint32).tobytes()
        stride = length * wide
        for batch in batches:
            number, count = (batch.column(c).to_numpy() for c in (1, 2))
            owner = np.repeat(np.arange(batch.num_rows), count)
            seq = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            slot = permute(number[owner] + seq, n, key)
            own = np.flatnonzero((slot >= first) & (slot < last))
            owner, seq, slot = owner[own], seq[own], slot[own]
            raw = [x.as_buffer() for x in batch.column(3)]
            pieces = [raw[o][s * stride : (s + 1) * stride].to_pybytes() for o, s in zip(owner.tolist(), seq.tolist(), strict=True)]
            size = np.array([len(p) // wide for p in pieces], np.int64)
            pieces = [p + pad * ((stride - len(p)) // wide) for p in pieces]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // shard), pa.array(slot % shard * stride), batch.column(0).take(pa.array(owner)), pa.array(seq), pa.array(size), pa.array(pieces, pa.binary())],
                names=["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "ids"],
            )

    placed = numbered.mapInArrow(cut, "slot long, shard long, offset long, doc_id long, seq long, n_tokens long, ids binary")
    low, shards = first // shard, max(1, -(-last // shard) - first // shard)
    parts = min(shards, int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # slots are dense, so the ranges are known without a sample
    return placed.repartitionById(parts, F.expr(f"cast((shard - {low}) * {parts} div {shards} as int)")).sortWithinPartitions("slot")


def training_order(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """slot, shard, offset (byte), doc_id, seq, n_tokens, ids (``length`` little-endian ids), sorted by slot in ranges of shards."""
    numbered, n = _numbered(save(_tokenised(docs, path, length), "tokens", "zstd"))
    return _placed(numbered, n, path, length, shard, key)


def shard_files(ordered: DataFrame) -> DataFrame:
    """(shard, first_slot, sequences, payload): each shard's bytes; ``ordered`` as ``training_order`` returns it."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []  # shard, first slot, pieces

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([open_[0]]), pa.array([open_[1]]), pa.array([len(open_[2])]), pa.array([b"".join(open_[2])], pa.binary())], names=["shard", "first_slot", "sequences", "payload"])

        for batch in batches:
            for shard, slot, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and open_[0] != shard:
                    yield row()
                    open_ = []
                if not open_:
                    open_ = [shard, slot, []]
                open_[2].append(ids)
        if open_:
            yield row()

    return ordered.select("shard", "slot", "ids").mapInArrow(join, "shard long, first_slot long, sequences long, payload binary")


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` was committed."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def manifest(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> str:
    """What fixes the output: the rows' number and digest (in any order), the vocabulary's name and the parameters."""
    each = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = docs.agg(F.count("*").alias("n"), F.bit_xor(each).alias("x"), F.sum(F.pmod(each, F.lit(2**31))).alias("s")).first()
    return f"rows={seen['n']} digest={seen['x']},{seen['s']} vocabulary={os.path.basename(path)} length={length} shard={shard} key={key}"


def write_shards(docs: DataFrame, target: str, path: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int = KEY, waves: int = WAVES) -> list[int]:
    """Write all shards of ``docs`` below ``target``; returns the waves written by this call, those of earlier calls are left as they are."""
    spark = docs.sparkSession
    own = f"{manifest(docs, path, length, shard, key)} waves={waves}"
    if _committed(spark, f"{target}/_manifest"):
        have = spark.read.text(f"{target}/_manifest").first()["value"]
        if have != own:
            raise ValueError(f"{target} holds another output: {have}, not {own}")
    else:
        spark.createDataFrame([(own,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/_manifest")
    if not _committed(spark, f"{target}/_tokens"):
        _tokenised(docs, path, length).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/_tokens")
    numbered, n = _numbered(spark.read.parquet(f"{target}/_tokens"))
    shards, done = -(-n // shard), []
    wave_of = F.expr(f"cast((shard + 1) * {waves} - 1 as long) div {max(shards, 1)}")  # of shards * k div waves up to the next
    if n and not _committed(spark, f"{target}/_placed"):
        _placed(numbered, n, path, length, shard, key).withColumn("_wave", wave_of).write.mode("overwrite").partitionBy("_wave").parquet(f"{target}/_placed")
    for wave in range(waves):
        first, last = (shards * k // waves for k in (wave, wave + 1))
        if first < last and not _committed(spark, f"{target}/wave={wave}"):
            own = spark.read.parquet(f"{target}/_placed").where(F.col("_wave") == wave)
            parts = min(last - first, int(spark.conf.get("spark.sql.shuffle.partitions")))
            dealt = own.repartitionById(parts, F.expr(f"cast((shard - {first}) * {parts} div {last - first} as int)")).sortWithinPartitions("slot")
            shard_files(dealt).write.mode("overwrite").parquet(f"{target}/wave={wave}")
            done.append(wave)
    return done


def read_slots(spark: SparkSession, path: str, first: int, last: int, shard: int = SHARD) -> DataFrame:
    """(slot, ids) of slots first..last - 1 by byte ranges of the shards that hold them."""
    rows = spark.read.parquet(path).where(F.col("shard").between(first // shard, (last - 1) // shard))
    stride = F.expr("cast(octet_length(payload) div sequences as int)")
    at = rows.select("first_slot", "payload", stride.alias("stride"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sequences") - 1)).alias("k"))
    return at.select((F.col("first_slot") + F.col("k")).alias("slot"), F.expr("substring(payload, cast(k * stride + 1 as int), stride)").alias("ids")).where(F.col("slot").between(first, last - 1))


def op3_token_shards(spark, sf_dir):
    return training_order(table(spark, sf_dir, "documents"))
