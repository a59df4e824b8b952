"""Secret scans with structural confirmation.

Three base patterns always count. Beyond them, candidates (signed tokens, armoured keys, all base64, base64url or hex
runs of ``LEAST`` characters or more) are reported only when their structure holds: the base64 or hex decodes, a key's
nested lengths add up at every level, or a token's header is JSON that names an algorithm. Of key encodings only private ones count: nine integers of
a version, or six; version, algorithm and octets; version 1 and octets; an encryption scheme and octets. Public keys, certificates and
signatures have other members. A run may be wrapped over lines, also escaped ones; header lines of an armour are skipped, and an encrypted body, which has no
structure of its own, counts under its headers. A run that decodes to text is scanned as a text, ``DEPTH`` levels down, and is
a key as a whole if that text holds an armour, a key or a token. Spans are ``kind:start:end`` in code points.

Defined results: a null text is empty and has no spans; a very long text is scanned whole, in time that follows its length (a key is decoded by the length it declares;
a token's header has ``HEAD`` characters at most); spans that tie in their start go by kind;
repeated rows give repeated results; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_])((?:ey[JA]|ew[o0k])[A-Za-z0-9_-]{8,2048}+)\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*+)")
LEAST, HEAD, DEPTH = 40, 2048, 3
_BREAK = r"(?:\\r\\n|\\n|\\r|\r\n|\n|\r)"
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+?)-----END \1-----", re.DOTALL)
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:[^\r\n]*")
LINES = re.compile(_BREAK)
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[\x20\t>#*]*+[A-Za-z0-9+/_-]{{4,}}+)*+={{0,2}}")
HEXRUN = re.compile(rf"[0-9A-Fa-f]{{16,}}+(?:{_BREAK}[\x20\t>#*]*+[0-9A-Fa-f]{{2,}}+)*+")
HEXSTARTS = re.compile(r"(?=30(?:[0-7][0-9A-Fa-f]|8[1-4])|6f70656e737368)", re.IGNORECASE)
INNER = re.compile(r"[_/+-](?=M[A-P]|b3BlbnNza)")
URLSAFE = str.maketrans("-_", "+/")
OPENSSH = b"openssh-key-v1\0"
#: No private key has more bytes.
KEY_BYTES = 1 << 15
KINDS = ("assign", "access", "hex", "armour", "key", "signed")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _decoded(text: str, alphabet: str = "+/") -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=alphabet.encode(), validate=True)
    except (binascii.Error, ValueError):
        return None


def _part(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first, end) of the DER value at ``at``, if it ends by ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = raw[at], raw[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(raw[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


#: Levels of nested lengths that are read; keys have six at most.
LEVELS = 16
_NESTED = (0x30, 0x31, 0xA0, 0xA1)
#: Object identifiers of encryption schemes (fixed values: password-based, versions 5 and 12) and an identifier's tag.
_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def members(raw: bytes, at: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, first, end) of what the DER sequence at ``at`` holds, if its members fill it exactly at every level; else None."""
    top = _part(raw, at, len(raw))
    if not top or top[0] != 0x30 or top[2] - at > KEY_BYTES:
        return None
    out: list[tuple[int, int, int]] = []
    todo = [(top[1], top[2], 0)]
    while todo:
        at, end, level = todo.pop()
        while at < end:
            part = _part(raw, at, end)
            if not part or level > LEVELS:
                return None
            if not level:
                out.append(part)
            if part[0] in _NESTED:
                todo.append((part[1], part[2], level + 1))
            at = part[2]
    return out


def nested_lengths(raw: bytes) -> bool:
    """Whether ``raw`` is one DER sequence whose members fill it exactly at every level."""
    top = _part(raw, 0, len(raw))
    return bool(top) and top[2] == len(raw) and members(raw) is not None


def is_private(raw: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Whether a sequence's members are those of a private key."""
    tags = [t for t, _, _ in parts]
    inner = [t and t[0] for t in (_part(raw, first, end) if tag == 0x30 else None for tag, first, end in parts[:2])]
    number = int.from_bytes(raw[parts[0][1] : parts[0][2]], "big") if tags[:1] == [0x02] and parts[0][2] - parts[0][1] == 1 else None
    if number in (0, 1) and (tags in ([0x02] * 9, [0x02] * 9 + [0x30]) or tags[:3] == [0x02, 0x30, 0x04] and inner[1] == 0x06 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}):
        return True
    if number == 1 and tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:
        return True
    if number == 0 and tags == [0x02] * 6:
        return True
    if tags == [0x30, 0x04] and inner[0] == 0x06:
        scheme = _part(raw, parts[0][1], parts[0][2])
        return raw[scheme[1] : scheme[2]].startswith(_SCHEMES)
    return False


def key_length(raw: bytes, at: int = 0) -> int:
    """Bytes of the private key at ``at``, 0 if there is none."""
    if raw.startswith(OPENSSH, at):
        start, at = at, at + len(OPENSSH)
        for _ in range(3):  # cipher, derivation and its options
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
            if at + 4 > len(raw):
                return 0
        keys = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        for _ in range(keys + 1 if 1 <= keys <= 64 else 0):  # the public keys and the private part
            if at + 4 > len(raw):
                return 0
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
        return at - start if 1 <= keys <= 64 and at <= len(raw) else 0
    parts = members(raw, at)
    return parts[-1][2] - at if parts and is_private(raw, parts) else 0


def _key(body: str) -> bool:
    """Whether an armour's body is a key: its header lines are skipped, an encrypted one is whole cipher blocks."""
    lines = [x.strip() for x in LINES.split(body)]
    headers = [x for x in lines if HEADER.fullmatch(x)]
    raw = _decoded("".join(x for x in lines if not HEADER.fullmatch(x)))
    if not raw:
        return False
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers):
        return any(x.startswith("DEK-Info:") for x in headers) and len(raw) >= 32 and len(raw) % 8 == 0
    return nested_lengths(raw) or raw.startswith(OPENSSH)  # the armour says that it is private


def _run(text: str, start: int, end: int) -> tuple[str, list[int], list[int]]:
    """A run without its line breaks, the place of each character, and the numbers of those that start a line."""
    chars, places, heads, at = [], [], [], start
    for m in [*re.finditer(rf"{_BREAK}[\x20\t>#*]*", text[start:end]), None]:
        upto = start + m.start() if m else end
        heads.append(len(places))
        chars.append(text[at:upto])
        places.extend(range(at, upto))
        at = start + m.end() if m else end
    return "".join(chars), places, heads


def _base64_keys(text: str) -> list[tuple[int, int, int]]:
    found = []
    for m in RUN.finditer(text):
        if len(m[0]) < LEAST:
            continue
        clean, places, heads = _run(text, m.start(), m.start() + len(m[0].rstrip("=")))
        clean_, clean = clean, clean.translate(URLSAFE)
        if text[max(m.start() - 1, 0) : m.start()] == "\\" and clean[:1] in ("n", "r"):
            heads.append(1)  # after an escaped line break
        heads += [x.end() for x in INNER.finditer(clean_)]  # a key may follow a dash, a slash or an underscore
        done = 0
        for head in sorted(set(heads)):
            if head < done or len(clean) - head < LEAST - 2 or clean[head] not in "Mb":
                continue
            if clean.startswith("b3BlbnNza", head):
                if not (_decoded(clean[head : head + 20]) or b"").startswith(OPENSSH):
                    continue
                have = clean[head : head + KEY_BYTES * 4 // 3]
            else:
                top = _part(_decoded(clean[head : head + 12]) or b"", 0, 1 << 62)
                if not top or top[0] != 0x30 or top[2] > KEY_BYTES or top[2] * 4 > (len(clean) - head) * 3:
                    continue
                have = clean[head : head + -(-top[2] * 4 // 3)]
            if len(have) % 4 == 1:
                have = have[:-1]
            size = key_length(_decoded(have) or b"")
            last = head + -(-size * 4 // 3) - 1
            if size and (last + 1 == len(places) or places[last + 1] != places[last] + 1):
                end = places[last] + 1
                end += next(i for i in range(3) if i == 2 or text[end + i : end + i + 1] != "=")
                found.append((places[head], 4, end))
                done = last + 1
    return found


def _hex_keys(text: str) -> list[tuple[int, int, int]]:
    found = []
    for m in HEXRUN.finditer(text):
        if len(m[0]) < LEAST:
            continue
        clean, places, _ = _run(text, m.start(), m.end())
        read: list[bytes | None] = [None, None]  # from an even and from an odd place
        done = 0
        for s in HEXSTARTS.finditer(clean):
            side, at = s.start() & 1, s.start() >> 1
            if s.start() < done:
                continue
            if read[side] is None:
                read[side] = bytes.fromhex(clean[side : len(clean) - (len(clean) - side) % 2])
            size = key_length(read[side], at)
            if 2 * size >= LEAST - 8:
                done = s.start() + 2 * size
                found.append((places[s.start()], 4, places[done - 1] + 1))
    return found


def _as_text(raw: bytes | None) -> str | None:
    """Decoded bytes that are a text of printable characters."""
    if not raw or any(b < 32 and b not in (9, 10, 13) or b == 127 for b in raw[:24]):
        return None
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text) else None


def _wrapped(text: str, depth: int) -> list[tuple[int, int, int]]:
    """Runs that decode to a text with a key or token in it."""
    found = []
    for runs, read in ((RUN, lambda x: _decoded(x.translate(URLSAFE))), (HEXRUN, lambda x: bytes.fromhex(x[: len(x) & ~1]))):
        for m in runs.finditer(text):
            if len(m[0]) < LEAST:
                continue
            start, end = m.start(), m.start() + len(m[0].rstrip("="))
            if text[max(start - 1, 0) : start] == "\\" and text[start] in "nr":
                start += 1  # after an escaped line break
            clean, places, heads = _run(text, start, end)
            for head in heads:
                if len(clean) - head < LEAST or _as_text(read(clean[head : head + 32])) is None:
                    continue
                for stop in [len(clean), *(h for h in heads[:-3:-1] if h > head)]:  # a word on the next line may look like more of it
                    inner = _as_text(read(clean[head : stop - ((stop - head) % 4 == 1)]))
                    if inner is not None and confirmed_spans(inner, depth - 1):
                        last = places[stop - 1] + 1
                        last += next(i for i in range(3) if i == 2 or text[last + i : last + i + 1] != "=")
                        found.append((places[head], 4, last))
                        break
                break  # later lines are of the same run
    return found


def _signed(header: str) -> bool:
    raw = _decoded(header, "-_")
    try:
        parsed = json.loads(raw) if raw else None
    except ValueError:
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base patterns, leftmost and non-overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """Further spans whose structure is confirmed."""
    found = []
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in ARMOUR.finditer(text) if _key(m[2])]
    outside = lambda spans, held: [x for x in spans if not any(s < x[2] and x[0] < e for s, _, e in held)]
    found += outside(_base64_keys(text) + _hex_keys(text), list(found))
    if "eyJ" in text or "eyA" in text or "ewo" in text or "ew0" in text or "ewk" in text:
        found += [(m.start(), 5, m.end()) for m in SIGNED.finditer(text) if _signed(m[1])]
    return found + outside(_wrapped(text, depth), list(found)) if depth > 1 else found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: base counts and digest, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                base = base_spans(text)
                more = confirmed_spans(text)
                for k in range(3):
                    rows[k].append(sum(x[1] == k for x in base))
                rows[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows[4].append(_joined(base + more))
                rows[5].append(len(more))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, RESULT)
