"""Compressed point records (LAZ): the public chunked format of adaptive arithmetic coding, for point formats 0 to 3 with extra bytes.

A file's points lie in chunks that stand alone; a table behind them has their sizes. So a chunk is what a task decodes or encodes: ``chunk_places`` gives their
byte ranges, ``decode_chunk`` and ``encode_chunk`` turn one chunk into records and back. Models are written once: the same steps run over a ``Decoder``, which
finds each symbol in the bytes, or an ``Encoder``, which puts it there.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

CHUNK = 50_000
VARIABLE = 0xFFFFFFFF
#: Item types and their versions (fixed values of the public format), the bytes of the standard ones, and the items of each point format.
BYTES, POINT, TIME, COLOUR = 0, 6, 7, 8
SIZES = {POINT: 20, TIME: 8, COLOUR: 6}
ITEMS = {0: (POINT,), 1: (POINT, TIME), 2: (POINT, COLOUR), 3: (POINT, TIME, COLOUR)}
RECORD, USER = 22204, b"laszip encoded"
#: Which of 16 states a return is in, by number of returns and return number (fixed values of the public format); its level is their difference.
STATE = (
    (15, 14, 13, 12, 11, 10, 9, 8),
    (14, 0, 1, 3, 6, 10, 10, 9),
    (13, 1, 2, 4, 7, 11, 11, 10),
    (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12),
    (10, 10, 11, 12, 13, 14, 14, 13),
    (9, 10, 11, 12, 13, 14, 15, 14),
    (8, 9, 10, 11, 12, 13, 14, 15),
)

_LEAST, _FULL = 1 << 24, 0xFFFFFFFF


class Bit:
    """Adaptive probability of a bit."""

    __slots__ = ("count", "cycle", "left", "p", "zeros")

    def __init__(self):
        self.zeros, self.count, self.p, self.cycle, self.left = 1, 2, 1 << 12, 4, 4

    def seen(self, bit: int) -> None:
        if not bit:
            self.zeros += 1
        self.left -= 1
        if self.left:
            return
        self.count += self.cycle
        if self.count > 1 << 13:
            self.count, self.zeros = (self.count + 1) >> 1, (self.zeros + 1) >> 1
            if self.zeros == self.count:
                self.count += 1
        self.p = (self.zeros * (0x80000000 // self.count)) >> 18
        self.cycle = self.left = min((5 * self.cycle) >> 2, 64)


class Symbols:
    """Adaptive cumulative distribution of ``n`` symbols."""

    __slots__ = ("counts", "cycle", "left", "total", "upto")

    def __init__(self, n: int):
        self.counts, self.total, self.cycle = [1] * n, 0, n
        self._update()
        self.cycle = self.left = (n + 6) >> 1

    def seen(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self._update()

    def _update(self) -> None:
        counts = self.counts
        self.total += self.cycle
        if self.total > 1 << 15:
            counts = self.counts = [(c + 1) >> 1 for c in counts]
            self.total = sum(counts)
        scale, before, upto = 0x80000000 // self.total, 0, []
        for c in counts:
            upto.append((scale * before) >> 16)
            before += c
        self.upto = upto
        self.cycle = self.left = min((5 * self.cycle) >> 2, (len(counts) + 6) << 3)


class Decoder:
    writes = False

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw + b"\0\0\0\0", at + 4
        self.value, self.length = int.from_bytes(self.raw[at : at + 4], "big"), _FULL

    def _narrow(self, low: int, length: int) -> None:
        value = self.value - low
        while length < _LEAST:
            value, length = ((value << 8) | self.raw[self.at]) & _FULL, length << 8
            self.at += 1
        self.value, self.length = value, length

    def bit(self, model: Bit, _: int | None = None) -> int:
        x = model.p * (self.length >> 13)
        out = int(self.value >= x)
        self._narrow(x if out else 0, self.length - x if out else x)
        model.seen(out)
        return out

    def symbol(self, model: Symbols, _: int | None = None) -> int:
        unit, upto = self.length >> 15, model.upto
        out = bisect_right(upto, self.value // unit) - 1
        x = upto[out] * unit
        self._narrow(x, (upto[out + 1] * unit if out + 1 < len(upto) else self.length) - x)
        model.seen(out)
        return out

    def bits(self, n: int, _: int | None = None) -> int:
        low = self.bits(16) if n > 19 else 0
        shift = 16 if n > 19 else 0
        unit = self.length >> (n - shift)
        out = self.value // unit
        self._narrow(out * unit, unit)
        return out << shift | low


class Encoder:
    writes = True

    def __init__(self):
        self.out, self.base, self.length = bytearray(), 0, _FULL

    def _narrow(self, low: int, length: int) -> None:
        base = self.base + low
        if base > _FULL:
            base &= _FULL
            k = len(self.out) - 1
            while self.out[k] == 0xFF:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        while length < _LEAST:
            self.out.append(base >> 24)
            base, length = (base << 8) & _FULL, length << 8
        self.base, self.length = base, length

    def bit(self, model: Bit, bit: int) -> int:
        x = model.p * (self.length >> 13)
        self._narrow(x if bit else 0, self.length - x if bit else x)
        model.seen(bit)
        return bit

    def symbol(self, model: Symbols, symbol: int) -> int:
        unit, upto = self.length >> 15, model.upto
        x = upto[symbol] * unit
        self._narrow(x, (upto[symbol + 1] * unit if symbol + 1 < len(upto) else self.length) - x)
        model.seen(symbol)
        return symbol

    def bits(self, n: int, value: int) -> int:
        if n > 19:
            self.bits(16, value & 0xFFFF)
            self.bits(n - 16, value >> 16)
        else:
            unit = self.length >> n
            self._narrow(value * unit, unit)
        return value

    def done(self) -> bytes:
        more = self.length > 2 * _LEAST
        self._narrow(_LEAST if more else _LEAST >> 1, _LEAST >> 1 if more else _LEAST >> 9)
        return bytes(self.out) + b"\0" * (3 if more else 2)


class Number:
    """Integers as corrections of what is predicted: the correction's size by context, then its place among those of that size."""

    def __init__(self, bits: int, contexts: int = 1, high: int = 8):
        self.range, self.high = 1 << bits, high
        self.half = self.range >> 1
        self.sizes = [None] * contexts
        self.bits = bits
        self.places: list = [Bit(), *([None] * bits)]
        self.k = 0

    def code(self, coder, context: int, predicted: int, real: int | None) -> int:
        """``real``, which a decoder finds."""
        if self.sizes[context] is None:
            self.sizes[context] = Symbols(self.bits + 1)
        c = 0
        if coder.writes:
            c = (real - predicted + self.half) % self.range - self.half
            k = (-c if c <= 0 else c - 1).bit_length()
            coder.symbol(self.sizes[context], k)
        else:
            k = coder.symbol(self.sizes[context])
        self.k = k
        if not k:
            c = coder.bit(self.places[0], c)
        elif k == 32:
            c = -self.half
        else:
            place = c + (1 << k) - 1 if c < 0 else c - 1
            fine = max(k - self.high, 0)
            if self.places[k] is None:
                self.places[k] = Symbols(1 << (k - fine))
            top = coder.symbol(self.places[k], place >> fine)
            place = top << fine | (coder.bits(fine, place & ((1 << fine) - 1)) if fine else 0)
            c = place + 1 if place >= 1 << (k - 1) else place - (1 << k) + 1
        out = (predicted + c) % self.range
        return out - self.range if self.bits == 32 and out >= self.half else out


class Middle:
    """The middle of five values that follow the newest ones."""

    __slots__ = ("high", "v")

    def __init__(self):
        self.v, self.high = [0] * 5, True

    def add(self, x: int) -> None:
        """Put x in order and drop the greatest, or, when that side was dropped last, the least."""
        v = self.v
        if self.high:
            if x >= v[2]:
                self.high = False
            v.pop()
        else:
            if x <= v[2]:
                self.high = True
            v.pop(0)
        v.insert(bisect_right(v, x), x)


class Point:
    """Twenty bytes: place, intensity, return, class, angle, user data, source."""

    form = struct.Struct("<iiiHBBbBH")

    def __init__(self, first: bytes):
        x, y, z, _, *rest = self.form.unpack(first)
        self.last = [x, y, z, 0, *rest]
        self.changed, self.intensity, self.source = Symbols(64), Number(16, 4), Number(16)
        self.angle = (Symbols(256), Symbols(256))
        self.by_last: tuple[dict, dict, dict] = ({}, {}, {})
        self.dx, self.dy, self.z = Number(32, 2), Number(32, 22), Number(32, 20)
        self.mx, self.my = [Middle() for _ in range(16)], [Middle() for _ in range(16)]
        self.heights, self.strengths = [0] * 8, [0] * 16

    def _follow(self, coder, which: int, old: int, new: int | None) -> int:
        models = self.by_last[which]
        if old not in models:
            models[old] = Symbols(256)
        return coder.symbol(models[old], new)

    def step(self, coder, raw: bytes | None) -> bytes:
        last = self.last
        new = self.form.unpack(raw) if coder.writes else (None,) * 9
        flags = 0
        if coder.writes:
            state = STATE[new[4] >> 3 & 7][new[4] & 7]
            for k, differs in enumerate((new[8] != last[8], new[7] != last[7], new[6] != last[6], new[5] != last[5], new[3] != self.strengths[state], new[4] != last[4])):
                flags |= differs << k
        flags = coder.symbol(self.changed, flags)
        if flags & 32:
            last[4] = self._follow(coder, 0, last[4], new[4])
        count, number = last[4] >> 3 & 7, last[4] & 7
        state, level = STATE[count][number], abs(count - number)
        if flags:
            if flags & 16:
                self.strengths[state] = self.intensity.code(coder, min(state, 3), self.strengths[state], new[3])
            last[3] = self.strengths[state]
            if flags & 8:
                last[5] = self._follow(coder, 1, last[5], new[5])
            if flags & 4:
                turn = coder.symbol(self.angle[last[4] >> 6 & 1], (new[6] - last[6]) & 255 if coder.writes else None)
                last[6] = ((last[6] + turn + 128) & 255) - 128
            if flags & 2:
                last[7] = self._follow(coder, 2, last[7], new[7])
            if flags & 1:
                last[8] = self.source.code(coder, 0, last[8], new[8])
        one = int(count == 1)
        wrap = lambda n: (n + 0x80000000) % 0x100000000 - 0x80000000
        d = self.dx.code(coder, one, self.mx[state].v[2], wrap(new[0] - last[0]) if coder.writes else None)
        last[0] = wrap(last[0] + d)
        self.mx[state].add(d)
        k = self.dx.k
        d = self.dy.code(coder, one + (k & ~1 if k < 20 else 20), self.my[state].v[2], wrap(new[1] - last[1]) if coder.writes else None)
        last[1] = wrap(last[1] + d)
        self.my[state].add(d)
        k = (k + self.dy.k) >> 1
        last[2] = self.heights[level] = self.z.code(coder, one + (k & ~1 if k < 18 else 18), self.heights[level], new[2])
        return self.form.pack(*last)


class Time:
    """Eight bytes: up to four interleaved series of times, each told by multiples of its last difference."""

    MANY, FEW = 500, -10
    SAME, WHOLE = MANY - FEW + 1, MANY - FEW + 2

    def __init__(self, first: bytes):
        self.own, self.newest = 0, 0
        self.times, self.diffs, self.odd = [int.from_bytes(first, "little", signed=True), 0, 0, 0], [0] * 4, [0] * 4
        self.still, self.multiple, self.number = Symbols(6), Symbols(self.MANY - self.FEW + 6), Number(32, 9)

    def step(self, coder, raw: bytes | None) -> bytes:
        now = self._write(coder, int.from_bytes(raw, "little", signed=True)) if coder.writes else self._read(coder)
        return now.to_bytes(8, "little", signed=True)

    def _unusual(self, diff: int) -> None:
        self.odd[self.own] += 1
        if self.odd[self.own] > 3:
            self.diffs[self.own], self.odd[self.own] = diff, 0

    def _moved(self, diff: int) -> int:
        now = self.times[self.own] + diff
        self.times[self.own] = now = (now + (1 << 63)) % (1 << 64) - (1 << 63)
        return now

    def _fresh(self, coder, now: int | None) -> int:
        """A time told whole starts the next series."""
        high = self.number.code(coder, 8, self.times[self.own] >> 32, None if now is None else now >> 32)
        low = coder.bits(16, None if now is None else now & 0xFFFF)
        low |= coder.bits(16, None if now is None else now >> 16 & 0xFFFF) << 16
        self.newest = self.own = (self.newest + 1) & 3
        self.times[self.own], self.diffs[self.own], self.odd[self.own] = high << 32 | low, 0, 0
        return self.times[self.own]

    def _by(self, coder, multiple: int, diff: int | None) -> int:
        """A difference near ``multiple`` times the last one; 1 and those close to it are usual."""
        known, many = self.diffs[self.own], self.MANY
        context = 1 if multiple == 1 else 7 if multiple == 0 else 4 if multiple == many else 6 if multiple == self.FEW else 5 if multiple < 0 else 2 if multiple < 10 else 3
        diff = self.number.code(coder, context, multiple * known, diff)
        if multiple == 1:
            self.odd[self.own] = 0
        elif context in (4, 6, 7):
            self._unusual(diff)
        return diff

    def _read(self, coder) -> int:
        if not self.diffs[self.own]:
            kind = coder.symbol(self.still)
            if kind == 0:
                return self.times[self.own]
            if kind == 1:
                self.diffs[self.own], self.odd[self.own] = self.number.code(coder, 0, 0, None), 0
                return self._moved(self.diffs[self.own])
            if kind == 2:
                return self._fresh(coder, None)
            self.own = (self.own + kind - 2) & 3
            return self._read(coder)
        kind = coder.symbol(self.multiple)
        if kind == self.SAME:
            return self.times[self.own]
        if kind == self.WHOLE:
            return self._fresh(coder, None)
        if kind > self.WHOLE:
            self.own = (self.own + kind - self.WHOLE) & 3
            return self._read(coder)
        return self._moved(self._by(coder, kind if kind <= self.MANY else self.MANY - kind, None))

    def _write(self, coder, now: int) -> int:
        last, known = self.times[self.own], self.diffs[self.own]
        diff = now - last
        if now == last:
            coder.symbol(self.multiple if known else self.still, self.SAME if known else 0)
        elif -(1 << 31) <= diff < 1 << 31:
            if not known:
                coder.symbol(self.still, 1)
                self.diffs[self.own], self.odd[self.own] = self.number.code(coder, 0, 0, diff), 0
            else:
                multiple = max(self.FEW, min(self.MANY, int(diff / known + (0.5 if diff * known >= 0 else -0.5))))
                coder.symbol(self.multiple, multiple if multiple >= 0 else self.MANY - multiple)
                self._by(coder, multiple, diff)
            self.times[self.own] = now
        else:
            for k in (1, 2, 3):
                if -(1 << 31) <= now - self.times[(self.own + k) & 3] < 1 << 31:
                    coder.symbol(self.multiple if known else self.still, self.WHOLE + k if known else k + 2)
                    self.own = (self.own + k) & 3
                    return self._write(coder, now)
            coder.symbol(self.multiple if known else self.still, self.WHOLE if known else 2)
            self._fresh(coder, now)
        return now


class Colour:
    """Six bytes: three colours, whose low and high bytes follow those of red."""

    form = struct.Struct("<3H")

    def __init__(self, first: bytes):
        self.last, self.used, self.turns = self.form.unpack(first), Symbols(128), [Symbols(256) for _ in range(6)]

    def step(self, coder, raw: bytes | None) -> bytes:
        old = [b for c in self.last for b in (c & 255, c >> 8)]
        new = [b for c in self.form.unpack(raw) for b in (c & 255, c >> 8)] if coder.writes else [None] * 6
        flags = 0
        if coder.writes:
            flags = sum((new[k] != old[k]) << k for k in range(6)) | (new[0:2] != new[2:4] or new[0:2] != new[4:6]) << 6
        flags = coder.symbol(self.used, flags)
        clamp = lambda n: max(0, min(255, n))
        half = lambda n: int(n / 2)  # noqa: E731  towards zero
        for part in (0, 1):
            if flags >> part & 1:
                turn = coder.symbol(self.turns[part], (new[part] - old[part]) & 255 if coder.writes else None)
                new[part] = (old[part] + turn) & 255
            else:
                new[part] = old[part]
        if flags >> 6 & 1:
            guess = [new[p] - old[p] for p in (0, 1)]
            # low bytes of the other two first, then the high ones
            for part, k in ((0, 2), (0, 4), (1, 3), (1, 5)):
                if k > 3:
                    guess[part] = half(guess[part] + new[k - 2] - old[k - 2])
                if flags >> k & 1:
                    near = clamp(guess[part] + old[k])
                    new[k] = (near + coder.symbol(self.turns[k], (new[k] - near) & 255 if coder.writes else None)) & 255
                else:
                    new[k] = old[k]
        else:
            new[2:4] = new[4:6] = new[0:2]
        self.last = tuple(new[k] | new[k + 1] << 8 for k in (0, 2, 4))
        return self.form.pack(*self.last)


class Bytes:
    """Extra bytes, each following the one at its place."""

    def __init__(self, first: bytes):
        self.last, self.models = bytearray(first), [Symbols(256) for _ in first]

    def step(self, coder, raw: bytes | None) -> bytes:
        for k, model in enumerate(self.models):
            turn = coder.symbol(model, (raw[k] - self.last[k]) & 255 if coder.writes else None)
            self.last[k] = (self.last[k] + turn) & 255
        return bytes(self.last)


KINDS = {POINT: Point, TIME: Time, COLOUR: Colour, BYTES: Bytes}


@dataclass
class Layout:
    """What a file's compression record says: points a chunk (0: they vary), and each record's items as (type, size)."""

    chunk: int
    items: tuple[tuple[int, int], ...]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.items)


def layout_of(point_format: int, size: int, chunk: int = CHUNK) -> Layout:
    if point_format not in ITEMS:
        raise ValueError(f"compressed points of format {point_format} are not supported (0 to 3 are)")
    items = tuple((t, SIZES[t]) for t in ITEMS[point_format])
    extra = size - sum(n for _, n in items)
    if extra < 0:
        raise ValueError("records are shorter than their format")
    return Layout(chunk, items + (((BYTES, extra),) if extra else ()))


def parse_layout(body: bytes) -> Layout:
    """From the body of the compression record."""
    kind, coder = struct.unpack_from("<HH", body, 0)
    chunk, count = struct.unpack_from("<I", body, 12)[0], struct.unpack_from("<H", body, 32)[0]
    items = [struct.unpack_from("<HHH", body, 34 + 6 * k) for k in range(count)]
    if kind != 2 or coder or any(t not in KINDS or v != 2 or SIZES.get(t, n) != n for t, n, v in items):
        raise ValueError("only chunked compression, version 2, of point formats 0 to 3 can be read")
    return Layout(0 if chunk == VARIABLE else chunk, tuple((t, n) for t, n, _ in items))


def layout_body(layout: Layout) -> bytes:
    return struct.pack("<HHBBHIIqqH", 2, 0, 2, 2, 0, 0, layout.chunk or VARIABLE, -1, -1, len(layout.items)) + b"".join(struct.pack("<HHH", t, n, 2) for t, n in layout.items)


def chunk_table(sizes: list[tuple[int, int]], variable: bool = False) -> bytes:
    """The table of chunks given as (points, bytes)."""
    coder, number = Encoder(), Number(32, 2)
    points = size = 0
    for n, m in sizes:
        if variable:
            points = number.code(coder, 0, points, n)
        size = number.code(coder, 1, size, m)
    return struct.pack("<II", 0, len(sizes)) + coder.done()


def chunk_places(raw: bytes, start: int, count: int, layout: Layout) -> list[tuple[int, int, int, int]]:
    """(first point, points, first byte, end byte) of each chunk; ``raw`` is the table and all behind it, ``start`` the first chunk's byte."""
    version, chunks = struct.unpack_from("<II", raw, 0)
    if version:
        raise ValueError("unknown chunk table")
    out, coder, number = [], Decoder(raw, 8), Number(32, 2)
    points = size = first = 0
    for _ in range(chunks):
        points = number.code(coder, 0, points, None) if not layout.chunk else min(layout.chunk, count - first)
        size = number.code(coder, 1, size, None)
        out.append((first, points, start, start + size))
        first, start = first + points, start + size
    if first != count:
        raise ValueError("the chunk table does not hold all points")
    return out


def decode_chunk(raw: bytes, points: int, layout: Layout) -> np.ndarray:
    """(points, record size) bytes."""
    out = bytearray(raw[: layout.size])
    models, at = [], 0
    for kind, size in layout.items:
        models.append(KINDS[kind](bytes(raw[at : at + size])))
        at += size
    coder = Decoder(raw, at)
    for _ in range(points - 1):
        for model in models:
            out += model.step(coder, None)
    return np.frombuffer(bytes(out), np.uint8).reshape(points, layout.size)


def encode_chunk(records: np.ndarray, layout: Layout) -> bytes:
    """The inverse of ``decode_chunk``, for one point at least."""
    rows, edges = records.tobytes(), np.cumsum([0] + [n for _, n in layout.items]).tolist()
    size = layout.size
    models = [KINDS[kind](rows[a:b]) for (kind, _), a, b in zip(layout.items, edges, edges[1:], strict=False)]
    coder = Encoder()
    for at in range(size, len(rows), size):
        for model, a, b in zip(models, edges, edges[1:], strict=False):
            model.step(coder, rows[at + a : at + b])
    return rows[:size] + coder.done()
