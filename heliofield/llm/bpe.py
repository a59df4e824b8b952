"""Byte-pair encoding of texts of any length and form, from rank files (one token a line) or vocabularies in JSON form."""

from __future__ import annotations

import base64
import json
import os
import re

from pyspark import SparkFiles, TaskContext

#: Pre-splitting pattern of the vocabularies (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of that pattern; runs of this many are encoded without it, since its search recurses once a character.
LONG = 20_000
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUN = re.compile(f"[{_SPACE}]{{{LONG},}}")

_loaded: dict[str, tuple] = {}


def local_path(path: str) -> str:
    """Executors read the copy that was sent to them."""
    sent = SparkFiles.get(os.path.basename(path)) if TaskContext.get() else path
    return sent if os.path.exists(sent) else path


def unescaped() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes of every ordinary token and its id, which is its rank."""
    with open(local_path(path), "rb") as lines:
        if not path.endswith(".json"):
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made = json.load(lines)
    special, byte = {t["id"] for t in made["added_tokens"]}, unescaped()
    return {bytes(byte[c] for c in token): n for token, n in made["model"]["vocab"].items() if n not in special}


def encoder(path: str):
    """(encoding, end id, bytes by id): the end id is the first free one."""
    if path not in _loaded:
        import tiktoken

        ranks = ranks_of(path)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, n in ranks.items():
            by_id[n] = token
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size, by_id
    return _loaded[path]


def encode(encoding, text: str) -> list[int]:
    """Ids of a text. The pattern takes a run of white space as one piece, but for its last character if something else follows: so a long run's piece is
    encoded by itself, and what precedes and follows it as texts of their own, with the same ids."""
    if len(text) < LONG:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])
