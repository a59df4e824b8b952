"""LAS and LAZ point clouds as a Spark data source: ``spark.read.format("las")`` and ``df.write.format("las")``.

The public record layout is read with ``numpy.frombuffer``. A partition is a range of points, or of a compressed file (point formats 0 to 3) a run of whole chunks
by its chunk table, so a large tile is spread over tasks, each byte is read once, and a task holds a slice or a chunk at a time. Filters on class and
coordinates are applied before rows are made. With ``record`` rows have their stored bytes too.

Tasks write parts in two steps, first the points as they come, then the file behind a header with their count, bounds and returns; the driver's commit moves
finished files into place, so a lost task or job leaves nothing that a reader sees. One file is one partition (``coalesce(1)``), in constant memory.
Paths are folders or files that executors can open, or URIs that ``pyarrow.fs`` knows; land clouds as Parquet for repeated use.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from heliofield.sources import laz

SCHEMA = "pid long, x double, y double, z double, cls int"
#: Byte place of the class in each point format (fixed values of the public format).
CLASS_AT = {0: 15, 1: 15, 2: 15, 3: 15, 4: 15, 5: 15, 6: 16, 7: 16, 8: 16, 9: 16, 10: 16}
LEAST_SIZE = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}


#: Points that a task holds at a time.
SLICE = 200_000
PENDING = "_temporary"


@dataclass
class Header:
    point_format: int
    version: str
    size: int
    count: int
    start: int
    scales: tuple[float, float, float]
    offsets: tuple[float, float, float]
    compressed: bool = False
    length: int = 227
    records: int = 0


def parse_header(raw: bytes) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = raw[24], raw[25]
    length, start, records = struct.unpack_from("<HII", raw, 94)
    kind, size, count = struct.unpack_from("<BHI", raw, 104)
    if minor >= 4 and len(raw) >= 255:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return Header(kind & 0x3F, f"{major}.{minor}", size, count, start, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), bool(kind & 0x80), length, records)


def variable_records(raw: bytes, h: Header) -> list[tuple[bytes, int, bytes]]:
    """(user, id, all bytes) of the records between header and points; ``raw`` is the file up to its points."""
    out, at = [], h.length
    for _ in range(h.records):
        user, number, length = struct.unpack_from("<2x16sHH", raw, at)
        out.append((user.rstrip(b"\0"), number, raw[at : at + 54 + length]))
        at += 54 + length
    return out


def _layout(raw: bytes, h: Header) -> laz.Layout:
    for user, number, body in variable_records(raw, h):
        if (user, number) == (laz.USER, laz.RECORD):
            layout = laz.parse_layout(body[54:])
            if layout.size != h.size:
                raise ValueError("the compression record does not fit the point records")
            return layout
    raise ValueError("compressed points without a compression record")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [inner]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and f.path.lower().endswith((".las", ".laz")) and f"/{PENDING}" not in f.path)
    if not found:
        raise FileNotFoundError(f"no LAS files in {path}")
    return system, found


class Range(InputPartition):
    """Points first..last - 1 of a file; ``chunks`` of a compressed one: (first point, points, first byte, end byte)."""

    def __init__(self, path: str, number: int, first: int, last: int, chunks: list[tuple[int, int, int, int]] | None = None):
        super().__init__((number, first))
        self.path, self.number, self.first, self.last, self.chunks = path, number, first, last, chunks


def _chunks(source, raw: bytes, h: Header) -> list[tuple[int, int, int, int]]:
    source.seek(h.start)
    table, end = struct.unpack("<q", source.read(8))[0], source.size()
    if table == -1:  # a writer that could not go back has put it last
        source.seek(end - 8)
        table = struct.unpack("<q", source.read(8))[0]
    source.seek(table)
    return laz.chunk_places(source.read(end - table), h.start + 8, h.count, _layout(raw, h))


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path") or ""
        self.rows = int(options.get("points_per_partition", 1_000_000))
        self.record = options.get("record", "false").lower() == "true"
        self.backend = options.get("backend", "auto")
        if self.backend not in ("auto", "las", "laz"):
            raise ValueError("backend: auto, las or laz")
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in ("cls", "x", "y", "z"):
                self.filters.append(f)
            yield f  # Spark checks them again

    def partitions(self):
        system, files = _files(self.path)
        out = []
        for number, path in enumerate(files):
            with system.open_input_file(path) as source:
                h = parse_header(source.read(375))
                if self.backend != "auto" and h.compressed != (self.backend == "laz"):
                    raise ValueError(f"{path} is {'' if h.compressed else 'not '}compressed; the backend asked for is {self.backend}")
                if not h.compressed:
                    out += [Range(path, number, k, min(k + self.rows, h.count)) for k in range(0, h.count, self.rows)]
                    continue
                source.seek(0)
                run: list[tuple[int, int, int, int]] = []
                for chunk in _chunks(source, source.read(h.start), h) if h.count else []:
                    run.append(chunk)
                    if chunk[0] + chunk[1] - run[0][0] >= self.rows:
                        out.append(Range(path, number, run[0][0], chunk[0] + chunk[1], run))
                        run = []
                if run:
                    out.append(Range(path, number, run[0][0], run[-1][0] + run[-1][1], run))
        return out

    def _slices(self, source, h: Header, part: Range) -> Iterator[tuple[int, np.ndarray]]:
        """(first point, records) of at most a slice or chunk."""
        if part.chunks is None:
            for first in range(part.first, part.last, SLICE):
                source.seek(h.start + first * h.size)
                yield first, np.frombuffer(source.read((min(first + SLICE, part.last) - first) * h.size), np.uint8).reshape(-1, h.size)
            return
        source.seek(0)
        layout = _layout(source.read(h.start), h)
        for first, points, begin, end in part.chunks:
            source.seek(begin)
            yield first, laz.decode_chunk(source.read(end - begin), points, layout)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)  # the driver listed the files
        with system.open_input_file(partition.path) as source:
            h = parse_header(source.read(375))
            for first, raw in self._slices(source, h, partition):
                xyz = np.ascontiguousarray(raw[:, :12]).view("<i4") * np.array(h.scales) + np.array(h.offsets)
                mask = 0x1F if h.point_format < 6 else 0xFF
                cols = {"cls": (raw[:, CLASS_AT[h.point_format]] & mask).astype(np.int32), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}
                keep = np.ones(len(raw), bool)
                for f in self.filters:
                    v = cols[f.attribute[0]]
                    keep &= np.isin(v, list(f.value)) if isinstance(f, In) else {EqualTo: v == f.value, GreaterThan: v > f.value, GreaterThanOrEqual: v >= f.value, LessThan: v < f.value, LessThanOrEqual: v <= f.value}[type(f)]
                pid = partition.number * (1 << 40) + first + np.flatnonzero(keep)
                out = {"pid": pid, "x": cols["x"][keep], "y": cols["y"][keep], "z": cols["z"][keep], "cls": cols["cls"][keep]}
                if self.record:
                    out["record"] = pa.array([r.tobytes() for r in raw[keep]], pa.binary())
                yield pa.RecordBatch.from_pydict(out)


@dataclass
class Written(WriterCommitMessage):
    path: str
    count: int


@dataclass
class Seen:
    """What a header says of its points."""

    count: int = 0
    low: np.ndarray = field(default_factory=lambda: np.full(3, np.inf))
    high: np.ndarray = field(default_factory=lambda: np.full(3, -np.inf))
    returns: np.ndarray = field(default_factory=lambda: np.zeros(15, np.int64))

    def add(self, records: np.ndarray, stored: np.ndarray, point_format: int) -> None:
        self.count += len(records)
        self.low, self.high = np.minimum(self.low, stored.min(0)), np.maximum(self.high, stored.max(0))
        self.returns += np.bincount(np.maximum(records[:, 14] & (7 if point_format < 6 else 15), 1) - 1, minlength=15)[:15]


class LasWriter(DataSourceArrowWriter):
    """One file a partition: version 1.2, point format 0, a scale of ``scale`` (0.001) and whole-metre offsets of the partition's first points.

    With ``like``, a LAS or LAZ file, its version, point format, variable records, scales and offsets are kept, so coordinates that were read from it are written as
    they were stored; rows with a ``record`` keep all its bytes but coordinates and class. ``compressed`` writes LAZ, ``chunk`` points a chunk."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool = False):
        self.path, self.overwrite = options.get("path") or "", overwrite
        self.names, self.run = schema.fieldNames(), uuid.uuid4().hex[:12]
        self.compressed, self.chunk = options.get("compressed", "false").lower() == "true", int(options.get("chunk", laz.CHUNK))
        self.head, self.extra, self.behind = bytearray(227), [], b""
        if options.get("like"):
            system, found = _files(options["like"])
            with system.open_input_file(found[0]) as source:
                h = parse_header(source.read(375))
                source.seek(0)
                raw = source.read(h.start)
            self.head = bytearray(raw[: h.length])
            self.extra = [body for user, number, body in variable_records(raw, h) if (user, number) != (laz.USER, laz.RECORD)]
            self.behind = b"" if h.compressed else raw[h.length + sum(map(len, self.extra)) :]  # what some writers put before the points
            self.form, self.size, self.scales, self.offsets = h.point_format, h.size, h.scales, h.offsets
        else:
            self.head[0:4], self.head[24], self.head[25] = b"LASF", 1, 2
            self.form, self.size, self.scales, self.offsets = 0, 20, (float(options.get("scale", 0.001)),) * 3, None
        self.layout = laz.layout_of(self.form, self.size, self.chunk) if self.compressed else None

    def _records(self, batch: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = lambda c: batch.column(self.names.index(c))
        xyz = np.stack([np.asarray(column(c), dtype=float) for c in "xyz"], 1)
        stored = np.rint((xyz - offsets) / np.array(self.scales))
        if stored.max() >= 2**31 or stored.min() < -(2**31):
            raise ValueError("coordinates don't fit the scale and offset")
        out = np.zeros((len(xyz), self.size), np.uint8)
        if "record" in self.names:
            held = [r.as_buffer() for r in column("record")]
            if any(len(r) != self.size for r in held):
                raise ValueError(f"a record has not the {self.size} bytes of the file to write")
            out = np.frombuffer(b"".join(held), np.uint8).reshape(-1, self.size).copy()
        out[:, :12] = stored.astype("<i4").view(np.uint8).reshape(-1, 12)
        at, cls = CLASS_AT[self.form], np.asarray(column("cls")).astype(np.uint8)
        out[:, at] = cls if self.form >= 6 else (out[:, at] & 0xE0) | (cls & 0x1F)
        return out, stored

    def _header(self, seen: Seen, offsets: np.ndarray) -> bytes:
        head, extra = bytearray(self.head), list(self.extra)
        if self.compressed:
            body = laz.layout_body(self.layout)
            extra.append(struct.pack("<H16sHH32s", 0, laz.USER, laz.RECORD, len(body), b"compression") + body)
        behind = b"" if self.compressed else self.behind
        struct.pack_into("<HII", head, 94, len(head), len(head) + sum(map(len, extra)) + len(behind), len(extra))
        small = seen.count if seen.count < 2**32 else 0
        struct.pack_into("<BHI", head, 104, self.form | 0x80 * self.compressed, self.size, small)
        struct.pack_into("<5I", head, 111, *(int(n) if small and self.form < 6 else 0 for n in seen.returns[:5]))
        low, high = (e * np.array(self.scales) + offsets for e in (seen.low, seen.high))
        struct.pack_into("<6d", head, 131, *self.scales, *offsets)
        struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
        if len(head) >= 375:
            struct.pack_into("<QI", head, 235, 0, 0)  # no extended records are kept
            struct.pack_into("<16Q", head, 247, seen.count, *seen.returns.tolist())
        return bytes(head) + b"".join(extra) + behind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, inner = _system(self.path)
        pending = f"{inner}/{PENDING}-{self.run}"
        system.create_dir(pending, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        seen, offsets, waiting, sizes = Seen(), None if self.offsets is None else np.array(self.offsets), np.zeros((0, self.size), np.uint8), []

        def put(out, last: bool = False) -> None:
            nonlocal waiting
            while len(waiting) >= self.chunk or last and len(waiting):
                sizes.append((len(waiting[: self.chunk]), out.write(laz.encode_chunk(waiting[: self.chunk], self.layout))))
                waiting = waiting[self.chunk :]

        with system.open_output_stream(f"{pending}/{name}.points") as out:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if offsets is None:
                    offsets = np.floor([np.min(np.asarray(batch.column(self.names.index(c)), dtype=float)) for c in "xyz"])
                records, stored = self._records(batch, offsets)
                seen.add(records, stored, self.form)
                if self.compressed:
                    waiting = np.concatenate((waiting, records))
                    put(out)
                else:
                    out.write(records.tobytes())
            put(out, True)
        if not seen.count:
            system.delete_file(f"{pending}/{name}.points")
            return Written("", 0)
        target = f"{pending}/{name}.{'laz' if self.compressed else 'las'}"
        with system.open_output_stream(target) as out, system.open_input_stream(f"{pending}/{name}.points") as points:
            head = self._header(seen, offsets)
            out.write(head)
            if self.compressed:
                out.write(struct.pack("<q", len(head) + 8 + sum(n for _, n in sizes)))
            while block := points.read(4 << 20):
                out.write(block)
            if self.compressed:
                out.write(laz.chunk_table(sizes))
        system.delete_file(f"{pending}/{name}.points")
        return Written(target, seen.count)

    def commit(self, messages):
        system, inner = _system(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(inner, recursive=True)):
                if f.is_file and f.path.lower().endswith((".las", ".laz")) and f"/{PENDING}" not in f.path:
                    system.delete_file(f.path)
        for m in messages:
            if m and m.path:
                name, _, kind = m.path.rpartition("/")[2].rpartition(".")
                system.move(m.path, f"{inner}/{name}-{self.run}.{kind}")
        self._clean(system, inner)

    def abort(self, messages):
        self._clean(*_system(self.path))

    def _clean(self, system, inner: str) -> None:
        if system.get_file_info(pending := f"{inner}/{PENDING}-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(pending)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA + (", record binary" if self.options.get("record", "false").lower() == "true" else "")

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)

    def writer(self, schema, overwrite) -> LasWriter:
        return LasWriter(self.options, schema, overwrite)


def register(spark) -> None:
    """Make ``las`` (LAS and LAZ) known to a session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
