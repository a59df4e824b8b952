"""Texts that strain operators: long runs, deep nesting, unclosed tags, keys within encodings. Results are defined and time follows length."""

from __future__ import annotations

import base64
import os
import random
import re
import subprocess
import sys
import time

import numpy as np
import pytest

from heliofield.llm import decontam, html_extract, near_dedup, quality, secrets, suffix_dedup, token_align, token_output

B64 = lambda raw: base64.b64encode(raw).decode()


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def whole(rng, n):
    return der(0x02, b"\x01" + rng.randbytes(n - 1))


def forms(seed=3):
    """(private encodings, public ones)."""
    rng = random.Random(seed)
    rsa_id = der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")), der(0x05))
    ec_id = der(0x30, der(0x06, bytes.fromhex("2a8648ce3d0201")), der(0x06, bytes.fromhex("2a8648ce3d030107")))
    zero, one = der(0x02, b"\0"), der(0x02, b"\1")
    rsa = der(0x30, zero, *(whole(rng, n) for n in (65, 3, 64, 33, 33, 32, 32, 33)))
    ec = der(0x30, one, der(0x04, rng.randbytes(32)), der(0xA0, der(0x06, bytes.fromhex("2a8648ce3d030107"))), der(0xA1, der(0x03, b"\0\4" + rng.randbytes(64))))
    private = {
        "rsa": rsa,
        "wrapped rsa": der(0x30, zero, rsa_id, der(0x04, rsa)),
        "ec": ec,
        "wrapped ec": der(0x30, zero, ec_id, der(0x04, ec)),
        "dsa": der(0x30, zero, *(whole(rng, n) for n in (65, 21, 64, 64, 20))),
        "encrypted": der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(0x04, rng.randbytes(8)))), der(0x04, rng.randbytes(96))),
    }
    public_rsa = der(0x30, whole(rng, 65), der(0x02, b"\1\0\1"))
    public = {
        "rsa": der(0x30, rsa_id, der(0x03, b"\0" + public_rsa)),
        "plain rsa": public_rsa,
        "ec": der(0x30, ec_id, der(0x03, b"\0\4" + rng.randbytes(64))),
        "certificate": der(0x30, der(0x30, der(0xA0, der(0x02, b"\2")), whole(rng, 9), rsa_id, der(0x30), der(0x30, rsa_id, der(0x03, b"\0" + public_rsa))), rsa_id, der(0x03, b"\0" + rng.randbytes(64))),
        "signature": der(0x30, whole(rng, 33), whole(rng, 32)),
        "digest": der(0x30, der(0x30, der(0x06, bytes.fromhex("608648016503040201")), der(0x05)), der(0x04, rng.randbytes(32))),
        "parameters": der(0x30, whole(rng, 65), whole(rng, 33), whole(rng, 64)),
    }
    return private, public


def armoured(name, raw):
    text = B64(raw)
    return f"-----BEGIN {name}-----\n" + "\n".join(text[k : k + 64] for k in range(0, len(text), 64)) + f"\n-----END {name}-----\n"


def kinds(text):
    return [secrets.KINDS[k] for _, k, _ in sorted(secrets.confirmed_spans(text))]


@pytest.mark.parametrize("name", forms()[0])
def test_private_encodings_are_reported(name):
    raw = forms()[0][name]
    for text in (B64(raw), raw.hex(), raw.hex().upper(), base64.urlsafe_b64encode(raw).decode(), "k=\n" + B64(raw) + "\nend"):
        assert kinds(text) == ["key"], text
    assert kinds(armoured("PRIVATE KEY", raw)) == ["armour"]


@pytest.mark.parametrize("name", forms()[1])
def test_public_encodings_are_not(name):
    raw = forms()[1][name]
    for text in (B64(raw), raw.hex(), raw.hex().upper(), armoured("PUBLIC KEY", raw), armoured("CERTIFICATE", raw), B64(armoured("CERTIFICATE", raw).encode())):
        assert kinds(text) == [], text


def test_keys_within_encodings():
    private, _ = forms()
    key = armoured("RSA PRIVATE KEY", private["rsa"])
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"someone"}', b"0123456789abcdef"))
    for inner in (key, B64(private["ec"]), private["rsa"].hex(), token):
        for outer in (B64(inner.encode()), inner.encode().hex(), B64(B64(inner.encode()).encode()), "tls.key: " + B64(inner.encode()) + "\nnext: 1"):
            assert "key" in kinds(outer), outer[:60]
    start, _, end = next(x for x in secrets.confirmed_spans(f"é data: {B64(key.encode())} end"))
    assert f"é data: {B64(key.encode())} end"[start:end] == B64(key.encode())
    deep = key
    for _ in range(secrets.DEPTH + 1):
        deep = B64(deep.encode())
    assert kinds(deep) == []  # deeper than is looked
    assert kinds(B64(b"plain words and nothing that is secret, " * 20)) == []


def test_confirmed_keys_against_every_substring():
    """A plain confirmer decodes every substring of base64 or hex characters; each key it knows is found, and none that it doesn't."""
    private, public = forms(9)

    def plain(text):
        for read, alphabet in ((lambda x: base64.b64decode(x + "=" * (-len(x) % 4)), r"[A-Za-z0-9+/]{40,}"), (bytes.fromhex, r"[0-9a-fA-F]{40,}")):
            for m in re.finditer(alphabet, text):
                for s in range(min(len(m[0]), 40)):
                    part = m[0][s:]
                    for cut in range(4):
                        try:
                            raw = read(part[: len(part) - cut])
                        except ValueError:
                            continue
                        if secrets.key_length(raw):
                            return True
        return False

    rng = random.Random(1)
    for raw in [*private.values(), *public.values(), rng.randbytes(80), der(0x30, whole(rng, 30), whole(rng, 30), whole(rng, 30))]:
        for text in (f"x {B64(raw)} y", f"x {raw.hex()} y", f'"{B64(raw)}"'):
            assert bool(kinds(text)) == plain(text), text


STRAINS = {
    "blanks": " " * 2_000_000,
    "blanks and a word": "x" + " " * 2_000_000 + "y",
    "tabs": "\t" * 2_000_000,
    "line breaks": "\n" * 2_000_000,
    "one letter": "a" * 2_000_000,
    "hex": "30" * 1_000_000,
    "hex lengths": "3082ffff" * 250_000,
    "base64": "/MA" * 660_000,
    "base64 lengths": "/MIIE" * 400_000,
    "openssh": "/b3BlbnNzaC1rZXktdjEA" * 100_000,
    "tokens": "-eyJ" * 500_000,
    "armours": "-----BEGIN PRIVATE KEY-----\n" * 70_000,
    "assignments": "password" * 250_000,
    "one word again": "spam " * 400_000,
    "signs": "{}#*[" * 400_000,
}


@pytest.mark.parametrize("name", STRAINS)
def test_secret_scan_is_linear(name):
    took = []
    for text in (STRAINS[name][:500_000], STRAINS[name]):
        began = time.process_time()
        secrets.base_spans(text)
        secrets.confirmed_spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.25), took


PAGES = {
    "unclosed inline": "<b><p>x</p>" * 180_000,
    "nested": "<div>" * 400_000 + "t",
    "nested menus": "<nav>" * 400_000 + "t",
    "spans": "<span>" * 150_000 + "t" + "</i>" * 150_000,
    "items": "<ul>" + "<li>x" * 400_000,
    "cells": "<table>" + "<td><p>" * 280_000,
    "signs": "<" * 2_000_000,
    "long class": "<div class='" + "q" * 1_000_000 + "'>" + "<p>x</p>" * 100_000,
    "references": "&amp;" * 400_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_are_read_in_linear_time_and_space(name):
    page = PAGES[name]
    took = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        blocks, opened, _ = html_extract.read_page(part)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.25), took
    assert max(map(len, opened), default=0) < (html_extract.DEEP + 2) * (html_extract.STEP_CHARS + 40)


def test_side_parts_named_by_ids():
    read = lambda page: html_extract.page_text(page, None, {}, {})
    assert read('<article><h1>T</h1><p>story</p><div id="comments"><p>nice one</p></div></article>') == "T\nstory"
    assert read("<article><p>a</p><div id=sidebar>x</div><section id='cookie-notice'>y</section><p>b</p></article>") == "a\nb"
    assert read("<article><h2 id=comments>On comments</h2><p id=search>How to search</p></article>") == "On comments\nHow to search"
    assert read("<article><div id='related-work'><p>kept</p></div></article>") == "kept"


def test_links_of_very_long_texts(spark):
    """Two texts of 1.5 M equal shingles, and one with a word more: their similarity by either way is 1, and they are near-duplicates."""
    idf = np.ones(1 << 10)
    blob = np.full(1_500_000, 77, np.uint32).tobytes()
    assert near_dedup.local_links([5, 3], [blob, blob], idf, 0.8) == [(5, 3)]
    rows = [(1, "spam " * 1_300_000), (2, "spam " * 1_300_000 + "ham"), (3, "some other text of a few words that is nothing like it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.deduplicated(docs).select("doc_id").collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} > {3}


@pytest.fixture(scope="module")
def strained(spark):
    # two megabytes each where a run is what strains, a quarter of it of the others
    rows = [(k, t if k < 6 else t[:500_000], "en", "s", len(t)) for k, t in enumerate(STRAINS.values())] + [(90, None, None, None, 0), (91, "a plain text of some words. " * 30, "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


@pytest.mark.parametrize("name", ["tokens", "quality", "secrets", "passages", "leaks"])
def test_operators_survive(spark, strained, name):
    items = spark.createDataFrame([(1, "a plain text of some words. a plain text of some words.")], "item_id long, text string")
    n = strained.count()
    if name == "tokens":
        out = token_output.training_order(strained.where("doc_id <> 4 and doc_id <> 5 or doc_id >= 90"))
        assert out.select("doc_id").distinct().count() >= n - 3
    elif name == "quality":
        assert quality.apply_cascade(strained).count() == n
    elif name == "secrets":
        assert secrets.scan_secrets(strained).count() == n
    elif name == "passages":
        assert suffix_dedup.repeated_passages(strained).count() >= 0
    else:
        assert {r.doc_id for r in decontam.contaminated(strained, items).collect()} == {91}


def test_short_items_are_reported_but_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "yes I have a word"), (2, "A plain line"), (3, "what is the answer to this rather long question of the test")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "A"), (3, "What is the answer to this rather long question of the test?")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} >= {(1, 1), (2, 2), (3, 3)}
    assert {r.doc_id for r in decontam.decontaminated(docs, items).collect()} == {1, 2}


def test_ids_of_parts_without_blocks_are_anchors():
    page = """<article><p>aa</p><div id="search">bb <b>cc</b></div><section id="comments"><div id="menu">dd</div><p>ee</p></section><div id="related"><span>ff</span></div>
    <div id="share" class="share">gg</div><ul id="social"><li>hh</li></ul></article>"""
    blocks, _, _ = html_extract.read_page(page)
    assert [b[3] for b in blocks if not b[1]] == ["aa", "bb cc", "ff"]


def test_slab_of_texts_is_aligned_in_bounded_memory():
    code = """
import random, resource
from heliofield.llm import token_align as t
rng = random.Random(5)
word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
texts, size = [], 0
while size < t.SLAB:
    texts.append(" ".join(word() for _ in range(500)))
    size += len(texts[-1])
t.Slab(["a b"], t.BYTE_VOCABULARY, t.PIECE_MODEL).row(0, [0])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
t.Slab(texts, t.BYTE_VOCABULARY, t.PIECE_MODEL).row(0, list(range(len(texts))))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    if not os.path.exists(token_align.BYTE_VOCABULARY):
        pytest.skip("no vocabularies here")
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(made.stdout) < 400  # MB, of words that are all distinct
