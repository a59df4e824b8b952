"""The pipeline against a plain composition of brute-force decisions on a small corpus."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from heliofield.llm import quality, token_output

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, c0 long, key string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    prose = lambda n: " ".join("w" + str(rng.randrange(3000)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    items = [(i, prose(25)) for i in range(5)]
    rows = [(i, prose(80 + i), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "s1", 1) for i in range(10)]  # copies and near copies
    rows += [(200 + i, prose(40) + " " + items[i][1] + " " + prose(40), "en", "s0", 1) for i in range(5)]  # leaks
    rows += [(300, "junk", "en", "s0", 1), (301, "#$ " * 100, "en", "s0", 1), (302, None, None, None, None)]
    # rows, not ids, are decided: no id, a clean one and a leak; one id twice, the second a leak; equal rows
    rows += [(None, prose(90), "en", None, 1), (None, prose(40) + " " + items[1][1], "en", None, 1), (3, prose(70), "en", "s0", 1), (4, items[2][1] + " " + prose(50), "en", "s1", 1), rows[7], rows[8]]
    rows = [(*r, k, "own") for k, r in enumerate(rows)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    stays = []
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, sf_dir).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            stays.append(collections.Counter(r.c0 for r in docs.collect()))
    number = lambda test: {r.c0 for r in rows if test(r)}
    junk = number(lambda r: r.doc_id in (300, 301, 302))
    assert set(stays[0]) == {r.c0 for r in rows} - junk
    copies, equal = number(lambda r: r.doc_id in range(100, 110)), number(lambda r: r.doc_id in (7, 8))
    assert set(stays[1]) - equal == set(stays[0]) - copies - equal and len(set(stays[1]) & equal) == 2
    leaks = number(lambda r: r.doc_id in range(200, 205)) | {len(rows) - 5, len(rows) - 3}
    assert set(stays[2]) == set(stays[1]) - leaks and max(stays[2].values()) == 1
    assert set(stays[3]) <= set(stays[2])
    assert {r.doc_id for r in docs.collect()} == {rows_.doc_id for rows_ in rows if rows_.c0 in stays[3]}


def test_run_writes_whole_texts(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    encoding, end = token_output.encoder()
    source = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        source[r.doc_id].append(r.text or "")
    words = collections.Counter()
    for r in got:
        ids = [t for t in np.frombuffer(r.ids, np.uint16)[: r.n_tokens].tolist() if t != end]
        words[r.doc_id] += len(encoding.decode(ids).split())
        assert r.seq > 0 or any(t.startswith(encoding.decode(ids)[:20]) for t in source[r.doc_id])
    total = sum(len(source[i][0].split()) for i in range(60)) + len(source[None][0].split()) + len(source[3][1].split())
    assert abs(sum(words.values()) - total) <= 4


def test_registered():
    import __spark_entry__ as entry

    known = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k[: k.index("_") + 1] for k in known if k.startswith("op")} and "pipeline" in known
    assert [k for k in known if k.startswith("op") and len(k.split("_")[0]) < 5]
    assert quality.RULES
