"""Quality scores, collocations and token alignment against brute force, known mixtures and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest

from heliofield.llm import bpe, collocations, lm, pu_quality, textops, token_align

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, rank long, n long, slab long, x string"
TEXTS = [None, "", " ", "  a  b", "a\n b \n\n c", "x▁y z", "<|endoftext|> <s> hi", "é ü 　 a \xa0b　c", " " * 30000 + "end", "a\t b\tc", "\n" * 25000, "日本語 テスト 😀 x", "a b\x00c \x1c d", "ab" * 3000, "end ", "don't it's 12 345 a'b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, 1, 2, 3, "x") for k, t in enumerate(TEXTS)]
    rows += [(None, "z z", "fr", 1, 2, 3, "x"), (3, "  a  b", "en", 1, 2, 3, "x"), (99, "many words of one text " * 4000, "en", 1, 2, 3, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


# --- encoding


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000 + "y", "\t" * 2_000_000, "\n" * 2_000_000 + "a", " \t\n" * 700_000 + "é", "a" * 2_000_000, "7" * 2_000_000, "!" * 1_000_000])
def test_long_runs_are_encoded(text):
    encoding, _, raw = bpe.encoder(token_align.BYTE_VOCABULARY)
    ids = bpe.encode(encoding, text)
    assert b"".join(raw[i] for i in ids) == text.encode()


@pytest.mark.parametrize("run", [" ", "\n", "\t", " 　", " \n"])
def test_long_runs_have_the_pattern_s_ids(run):
    encoding = bpe.encoder(token_align.BYTE_VOCABULARY)[0]
    many = run * (bpe.LONG // len(run) + 3)
    for text in (many, "ab" + many + "cd", many + " ef", "x " + many + "\n", many + "7" + many + "!" + many):
        assert bpe.encode(encoding, text) == encoding.encode_ordinary(text)


def test_both_vocabulary_files_give_the_same_ids():
    assert bpe.ranks_of(token_align.BYTE_VOCABULARY) == bpe.ranks_of("/opt/tokenizers/byte_bpe_50k.tiktoken")


# --- alignment


def intervals(tokens):
    at, out = 0, []
    for n, raw in tokens:
        out.append((n, at, at + len(raw)))
        at += len(raw)
    return out


def aligned(rows):
    """Every document's figures, by the tokenizers' own whole-text encoding and a sweep over intervals."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(token_align.BYTE_VOCABULARY)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=token_align.PIECE_MODEL)
    byte, made, met = bpe.unescaped(), [], collections.Counter()
    for doc, text in rows:
        a = b = []
        if text:
            e = first.encode(" " + text, add_special_tokens=False)
            a = [(n, bytes(byte[c] for c in t)) for n, t in zip(e.ids, e.tokens, strict=True)]
            b = [(n, bytes([int(p[3:5], 16)]) if second.is_byte(n) else p.replace("▁", " ").encode()) for n in second.encode(text) for p in [second.id_to_piece(n)]]
            if any(b"".join(raw for _, raw in x) != (" " + text).encode() for x in (a, b)):
                a = b = []
        a, b = intervals(a), intervals(b)
        links, j = [], 0
        for n, start, end in a:
            while b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                links.append((n, b[k][0]))
                k += 1
        groups, last = [], 0
        for cut in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append("|".join(",".join(str(n) for n, s, e in x if last <= s and e <= cut) for x in (a, b)) if len(a) < 500 else None)
            last = cut
        met.update(links)
        made.append((doc, a, b, links, groups))
    most = collections.Counter()
    for (_, n), times in met.items():
        most[n] = max(most[n], times)
    for doc, a, b, links, groups in made:
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc, len(a), len(b), len(groups), len(links), sum(met[p] == most[p[1]] for p in links), sum(met[p] for p in links), digest


def test_alignment(odd, spark):
    short = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 900").limit(60).select("doc_id", "text")
    docs = odd.select("doc_id", "text", "slab", "n").unionByName(short, allowMissingColumns=True).cache()
    got = sorted((tuple(r) for r in token_align.align_documents(docs).collect()), key=str)
    want = sorted(aligned([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if w[7] is not None)
    assert sum(w[7] is not None for w in want) > 60


def test_alignment_does_not_depend_on_slabs(odd, monkeypatch):
    whole = sorted((tuple(r) for r in token_align.align_documents(odd).collect()), key=str)
    texts = [r.text for r in odd.collect()]
    one = token_align.Slab(texts, token_align.BYTE_VOCABULARY, token_align.PIECE_MODEL)
    monkeypatch.setattr(token_align, "BLOCK", 64)
    other = token_align.Slab(texts, token_align.BYTE_VOCABULARY, token_align.PIECE_MODEL)
    assert {k: v for k, v in one.row(0, []).items() if k not in ("places", "edges")} == {k: v for k, v in other.row(0, []).items() if k not in ("places", "edges")}
    assert sorted((tuple(r) for r in token_align.align_documents(odd.repartition(7)).collect()), key=str) == whole
    assert token_align.align_documents(odd.limit(0)).count() == 0


# --- collocations


def phrases(rows, least, keep):
    """The definition, word by word."""
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        made, longer = [], collections.Counter()
        for p, a in count.items():
            if a >= least and len(p) > 1:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        for p, a in count.items():
            if a >= least and len(p) > 1 and not 100 * longer[p] >= 80 * a:
                score, _, left, right = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                made.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(made)[:keep])]
    return sorted(out)


@pytest.mark.parametrize(("least", "keep"), [(2, 2000), (3, 5), (30, 2000)])
def test_collocations(spark, odd, least, keep):
    rng = np.random.default_rng(5)
    words = ["The", "of", "São", "x-y", "(b)", "a", "IT", "été", "\x1cq", "und"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 60)))).replace("(b)", ", b\t\t") + "." * int(rng.integers(0, 2)), [None, "und", "en", "fr"][k % 4], 1, 2, 3, "x") for k in range(200)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd).repartition(5)
    got = sorted(tuple(r) for r in collocations.top_collocations(docs, least, keep).collect())
    want = phrases([(r.text, r.lang) for r in docs.collect()], least, keep)
    assert got == want
    assert want


def test_collocations_of_nothing(odd):
    assert collocations.top_collocations(odd.limit(0)).count() == 0
    assert collocations.top_collocations(odd.where("text is null or doc_id = 1")).count() == 0


def test_collocations_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert sorted(tuple(r) for r in collocations.op12_collocations(spark, DATA).collect()) == sorted(con.execute(collocations.SQL).fetchall())


def test_sketch_is_an_upper_bound():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    many = rng.choice(hashes, 60000)
    parts = [collocations.Sketch(1 << 10) for _ in range(3)]
    for k, part in enumerate(parts):
        part.add(many[k::3])
    whole = collocations.Sketch(1 << 10, np.minimum(sum(p.cells.astype(int) for p in parts), collocations.LEAST).astype(np.uint8))
    kinds, n = np.unique(many, return_counts=True)
    assert whole.may_reach(kinds[n >= collocations.LEAST]).all()


def test_automata_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b a b a b, a b. c a b a", "b a b"])
    full = collocations.Sketch(1 << 4, np.full((2, 1 << 4), collocations.LEAST, np.uint8))
    whole = collocations.shard_counts(texts, "en", full, full)
    assert whole["a b"] == 6 and whole["a b a"] == 3 and whole["b a b"] == 3 and whole["a b a b"] == 2 and whole["c"] == 1
    monkeypatch.setattr(collocations, "BLOCK", 5)
    assert collocations.shard_counts(texts, "en", full, full) == whole


def test_a_shard_is_hashed_by_slabs(monkeypatch):
    """Words and hashes take many times a text's size, so they are never made of a whole shard at once; counts are of the whole shard all the same."""
    import pyarrow as pa

    texts = pa.array([f"of the sea w{i % 7} " * 8000 for i in range(30)])
    full = collocations.Sketch(1 << 4, np.full((2, 1 << 4), collocations.LEAST, np.uint8))
    sizes, phrases = [], collocations.Phrases
    monkeypatch.setattr(collocations, "Phrases", lambda texts, lang: (sizes.append(sum(len(t) for t in texts.to_pylist())), phrases(texts, lang))[1])
    got = collocations.shard_counts(texts, "en", full, full)
    assert max(sizes) <= textops.SLAB < sum(sizes) == sum(len(t) for t in texts.to_pylist())
    assert got["of"] == got["of the sea"] == 30 * 8000 and got["w0 of"] == 5 * 7999


# --- quality


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    good, bad = rng.beta(6, 2, 70000), rng.beta(1, 9, 30000)
    bins = np.linspace(0, 1, pu_quality.BINS + 1)
    prior = pu_quality.prior_of(np.histogram(np.append(good, bad), bins)[0].astype(float), np.histogram(rng.beta(6, 2, 20000), bins)[0].astype(float))
    assert 0.66 < prior < 0.74


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_risk_gradient(prior):
    """Against differences, on either side of the bracket's zero."""
    rng = np.random.default_rng(2)
    xp, xu = rng.normal(0.3, 1, (40, pu_quality.FEATURES)), rng.normal(0, 1, (50, pu_quality.FEATURES))
    net = pu_quality.Network()
    sig = lambda z: 1 / (1 + np.exp(-z))

    def risk(flat, side):
        own = pu_quality.Network()
        parts, at = [], 0
        for shape in own.SHAPES:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape))
            at += size
        own.parts = parts
        zp, zu = own.forward(xp)[0], own.forward(xu)[0]
        bracket = sig(zu).mean() - prior * sig(zp).mean()
        return prior * sig(-zp).mean() + bracket if side else -bracket

    got, bracket = pu_quality.risk_gradient(net, xp, xu, prior)
    flat = net.flat.astype(np.float64)
    for k in (0, 17, pu_quality.FEATURES * pu_quality.HIDDEN + 3, len(flat) - 30, len(flat) - 1):
        step = np.zeros(len(flat))
        step[k] = 1e-5
        assert got[k] == pytest.approx((risk(flat + step, bracket >= 0) - risk(flat - step, bracket >= 0)) / 2e-5, abs=2e-6)


def test_features_are_those_of_each_text_alone():
    import pyarrow as pa

    texts = [None, "", "a a a b\nc c\n\nc c\n", "X" * 5000, "one two. Three!\n", "é|é | é", " \n ", "one two. Three!\n"]
    whole = pu_quality.features(pa.array(texts))
    assert whole.shape == (8, pu_quality.FEATURES) and np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert (pu_quality.features(pa.array([t], pa.string()))[0] == whole[k]).all()
    assert not whole[0].any() and not whole[1].any()


def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = pu_quality.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    held = out[out.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.85


def test_quality_learns_from_training_labels_only(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    turned = labels.where("crc32(cast(doc_id as string)) % 5 = 0").selectExpr("doc_id", "1 - quality as quality", "toxic").unionByName(kept)
    a, b = (pu_quality.quality_scores(docs.coalesce(1), x.coalesce(1)).toPandas().sort_values("doc_id") for x in (kept, turned))
    assert np.allclose(a.score, b.score)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, 1, 0, "x") for k in (1, 3, 4, 7, 9, 11, 14, 99)] + [(3, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, score string")
    out = pu_quality.quality_scores(odd, labels).toPandas()
    assert len(out) == odd.count() and out.score.between(0, 1).all() and set(out.columns) == {"doc_id", "held_out", "score", "predicted"}
    same = out[out.doc_id == 3].score
    assert len(same) == 2 and same.nunique() == 1
    none = pu_quality.quality_scores(odd, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 1).all()
    assert pu_quality.quality_scores(odd.limit(0), labels).count() == 0


def test_vocabulary_of_bytes():
    byte = bpe.unescaped()
    assert sorted(byte.values()) == list(range(256))
    with open(token_align.BYTE_VOCABULARY) as lines:
        assert {c for t in json.load(lines)["model"]["vocab"] for c in t if t != "<|endoftext|>"} <= set(byte)


# --- language model


def test_language_model_against_a_bigram(spark):
    """Held-out gain over the base, beside that of a smoothed bigram over the same outputs."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = lm.score_documents(docs).where("held_out").toPandas()
    gain = (out.score - out.base_score).sum() / out.n_tokens.sum()
    rows = docs.select("doc_id", "text").toPandas()
    held = rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 10 == 0).to_numpy()
    import pyarrow as pa

    parts = [list(lm._tokens(pa.array(rows.text[held == side]))) for side in (False, True)]
    word, times = np.unique(np.concatenate([t for _, _, t, _ in parts[0]]), return_counts=True)
    top = np.sort(word[np.argsort(-times, kind="stable")[: lm.VOCABULARY]])
    ids = lambda t: np.where(top[np.minimum(np.searchsorted(top, t), len(top) - 1)] == t, np.searchsorted(top, t), len(top))
    pairs = []
    for side in parts:
        u, w = [], []
        for _, _, token, edge in side:
            own = ids(token)
            u.append(lm._contexts(own, edge, len(top) + 1)[0])
            w.append(own)
        pairs.append((np.concatenate(u), np.concatenate(w)))
    (u, w), (hu, hw) = pairs
    p = (np.bincount(w, minlength=len(top) + 1) + 0.1) / (len(w) + 0.1 * (len(top) + 1))
    count = np.zeros((len(top) + 2, len(top) + 1), np.float32)
    np.add.at(count, (u, w), 1)
    bigram = max(float(np.mean(np.log10((count[hu, hw] + k * p[hw]) / (count[hu].sum(1) + k)) - np.log10(p[hw]))) for k in (100, 300, 1000))
    assert gain > bigram and gain > 0.15, (gain, bigram)
