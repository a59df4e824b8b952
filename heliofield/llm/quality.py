"""Quality rules as a short-circuit cascade.

Every rule is a cheap reading of counts that one pass over the text yields, or a costlier reading of the
text itself. ``plan_cascade`` measures each rule's cost and how much it rejects on a bounded sample of rows (at most
``SAMPLE_ROWS`` of at most ``SAMPLE_CHARS`` characters) and orders the rules by rejection per cost; ``apply_cascade`` runs them in that order, each rule only on the
rows that all earlier ones kept. The order changes the work, never the verdict: a row is kept exactly if no
rule rejects it.

Defined results: a null or empty text has no words and fails the base rule; a very long text is measured whole (only the sample leaves it
out); rules that tie in worth keep their order; repeated rows are judged alike; an empty table gives an empty result; columns of the input other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.llm import textops

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
#: Rows of the sample on which costs and selectivities are estimated (they set the order only).
SAMPLE_ROWS = 500
SAMPLE_CHARS = 50_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = {k: k + 32 for k in range(65, 91)}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


@dataclass(frozen=True)
class Rule:
    """``rejects(counts, texts)``: a boolean array; counts has one array a measure, texts the rows' strings."""

    name: str
    rejects: Callable[[dict[str, np.ndarray], pa.Array], np.ndarray]


def _per(text: str | None, test: Callable[[str], bool]) -> bool:
    return bool(text) and test(text)


def _shouting(text: str) -> bool:
    upper = sum(map(str.isupper, text))
    return upper > 0.6 * max(1, sum(map(str.isalpha, text)))


def _few_letters(text: str) -> bool:
    return sum(map(str.isalpha, text)) < 0.3 * max(1, len(text) - text.count(" ") - text.count("\n"))


def _lines_of(text: str) -> list[str]:
    return [x for x in (line.strip(" \t\r\f\v") for line in text.split("\n")) if x]


def _ellipses(text: str) -> bool:
    lines = _lines_of(text)
    return 10 * sum(x.endswith(("...", "\u2026")) for x in lines) > 3 * len(lines)


def _bullets(text: str) -> bool:
    lines = _lines_of(text)
    return 10 * sum(x.startswith(("\u2022", "-", "*")) for x in lines) > 9 * len(lines)


def _wordless(text: str) -> bool:
    words = _WORD.findall(text)
    return 10 * sum(any(map(str.isalpha, w)) for w in words) < 7 * len(words)


#: The default rules, after those published for web corpora; thresholds are far outside ordinary prose of any language.
RULES = (
    Rule("symbols", lambda c, t: c["n_symbols"] * 10 > c["n_words"]),
    Rule("word_length", lambda c, t: (c["word_chars"] > 20 * c["n_words"]) | (c["word_chars"] < 2 * c["n_words"])),
    Rule("duplicate_lines", lambda c, t: c["n_dup_lines"] > np.maximum(3, 0.3 * c["n_lines"])),
    Rule("shouting", lambda c, t: np.array([_per(x, _shouting) for x in t.to_pylist()], bool)),
    Rule("braces", lambda c, t: np.array([_per(x, lambda s: s.count("{") + s.count("}") > 0.05 * len(_WORD.findall(s))) for x in t.to_pylist()], bool)),
    Rule("placeholder", lambda c, t: np.array([_per(x, lambda s: "lorem ipsum" in s.translate(_LOW)) for x in t.to_pylist()], bool)),
    Rule("ellipses", lambda c, t: np.array([_per(x, _ellipses) for x in t.to_pylist()], bool)),
    Rule("bullets", lambda c, t: np.array([_per(x, _bullets) for x in t.to_pylist()], bool)),
    Rule("wordless", lambda c, t: np.array([_per(x, _wordless) for x in t.to_pylist()], bool)),
    Rule("few_letters", lambda c, t: np.array([_per(x, _few_letters) for x in t.to_pylist()], bool)),
)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of every text, over the whole text."""
    data, offsets = textops.utf8(texts)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in (*MEASURES, "n_lines")}
    for i, j in textops.slabs(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        words = textops.Words(part, own)
        out["n_words"][i:j] = np.diff(words.first)
        total = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[own])
        out["word_chars"][i:j] = total(_HEAD[part] & ~textops._SPACE[part])
        out["n_symbols"][i:j] = total(_SYMBOL[part])
        out["n_repeat_words"][i:j] = _repeated(words)
        out["n_dup_lines"][i:j], out["n_lines"][i:j] = _lines(part, own, words)
    return out


def _twins(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether (doc, key) occurs again, and whether it occurred earlier."""
    joint = textops.mix(key + doc.astype(np.uint64) * textops.U64(0xA24BAED4963EE407))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def _repeated(words: textops.Words, k: int = 8) -> np.ndarray:
    """Words that lie in a window of k words found twice or more in the text, the first included."""
    at, doc = textops.inside(words.first, k)
    covered = np.zeros(len(words.start) + 1, np.int64)
    if len(at):
        twice, _ = _twins(textops.grams(words.hash, k)[at], doc)
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + k, -1)
    hit = np.cumsum(covered)[:-1] > 0
    return np.diff(np.concatenate(([0], np.cumsum(hit)))[words.first])


def _lines(part: np.ndarray, own: np.ndarray, words: textops.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the text (all bytes compared), and lines with a word."""
    n = len(own) - 1
    if not len(part):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    brk = np.flatnonzero(part == 0x0A)
    start = np.union1d(own[:-1][own[:-1] < own[1:]], brk + 1)
    doc = np.searchsorted(own, start, "right") - 1
    ok = (start < own[-1]) & (doc < n)
    start, doc = start[ok], doc[ok]
    brk = np.append(brk, len(part))
    end = np.minimum(brk[np.searchsorted(brk, start)], own[doc + 1])
    inside = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[inside], end[inside], doc[inside]
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = end - start
    at = np.cumsum(size) - size
    flat = np.arange(int(size.sum())) - np.repeat(at - start, size)
    place = flat - np.repeat(start, size)
    value = textops._BYTE[part[flat]] * textops._powers(textops._BASE, int(size.max()))[place]
    key = textops.mix(np.add.reduceat(value, at) + size.astype(np.uint64))
    _, later = _twins(key, doc)
    return np.bincount(doc[later], minlength=n), np.bincount(doc, minlength=n)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[str]:
    """Rule names by rejection per cost, estimated on the driver on the first ``sample_rows`` rows that are no longer than ``sample_chars``.

    The estimate affects only the order of evaluation, never a verdict."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") <= sample_chars).take(sample_rows)
    texts = pa.array([r["text"] for r in rows], pa.string())
    counts = measure(texts)
    good = ~base_failed(counts)
    counts, texts = {k: v[good] for k, v in counts.items()}, texts.filter(pa.array(good))
    worth = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = int(np.count_nonzero(rule.rejects(counts, texts)))
        worth[rule.name] = (rejected + 0.5) / max(time.perf_counter() - began, 1e-9)
    return sorted(worth, key=lambda name: -worth[name])


def _ordered(rules: tuple[Rule, ...], order: list[str]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[x] for x in order]


def _judged(texts: pa.Array, steps: list[Rule]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts, base failures, and the first rule that rejects each text ("" if none); later rules see only survivors."""
    counts = measure(texts)
    failed = base_failed(counts)
    why = np.full(len(failed), "", object)
    why[failed] = "base"
    alive = np.flatnonzero(~failed)
    for rule in steps:
        if not len(alive):
            break
        out = rule.rejects({k: v[alive] for k, v in counts.items()}, texts.take(pa.array(alive)))
        why[alive[out]] = rule.name
        alive = alive[~out]
    return counts, failed, why


def apply_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """One row a document: the base counts, ``base_failed``, ``kept`` and the first rule that rejected it."""
    steps = _ordered(rules, order or plan_cascade(docs, rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, why = _judged(batch.column(1), steps)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k]) for k in MEASURES), pa.array(failed), pa.array(why == ""), pa.array([x or None for x in why], pa.string())],
                names=["doc_id", *MEASURES, "base_failed", "kept", "rejected_by"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, RESULT)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with all their columns."""
    names = [f"__c{k}" for k in range(len(docs.columns))]  # names may clash
    at = docs.columns.index("text")
    steps = _ordered(rules, order or plan_cascade(docs, rules))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, why = _judged(batch.column(at), steps)
            yield batch.filter(pa.array(why == ""))

    plain = docs.toDF(*names)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


#: The default rules and counts in DuckDB's SQL.
SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
x as (select rid, count(*) as n_texts, count(*) filter (suffix(line, '...') or suffix(line, '…')) as ends, count(*) filter (prefix(line, '•') or prefix(line, '-') or prefix(line, '*')) as begins
    from (select rid, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) as line from d) y where line <> '' group by rid),
l as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
w as (select rid, unnest(ws) as word, unnest(range(len(ws))) as pos from l),
k as (select rid, pos, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o, lead(word, 5) over o, lead(word, 6) over o, lead(word, 7) over o) as key,
    lead(word, 7) over o is not null as full_ from w window o as (partition by rid order by pos)),
t as (select rid, pos from (select rid, pos, count(*) over (partition by rid, key) as c from k where full_) x where c > 1),
r as (select rid, count(distinct pos + o) as n_repeat_words from t cross join (select unnest(range(8)) as o) u group by rid),
n as (select rid, count(*) filter (regexp_matches(word, '\p{L}')) as lettered, count(*) as n_words, sum(len(word)) as word_chars from w group by rid),
li as (select rid, unnest(string_split(text, chr(10))) as line from d),
g as (select rid, sum(c) as n_lines, sum(c - 1) as n_dup_lines from (select rid, line, count(*) as c from li where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid, line) x group by rid),
c as (select doc_id, text, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, cast(len(text) - len(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, len(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as capitals, len(translate(text, ' ' || chr(10), '')) as solid,
    coalesce(lettered, 0) as lettered, len(text) - len(translate(text, '{}', '')) as braces, coalesce(n_texts, 0) as n_texts, coalesce(ends, 0) as ends, coalesce(begins, 0) as begins
  from d left join x on d.rid = x.rid left join n on d.rid = n.rid left join g on d.rid = g.rid left join r on d.rid = r.rid),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 10 > n_words or word_chars > 20 * n_words or word_chars < 2 * n_words or n_dup_lines > greatest(3, 0.3 * n_lines) or capitals > 0.6 * greatest(1, letters) or letters < 0.3 * greatest(1, solid)
    or braces > 0.05 * n_words or contains(translate(text, 'LOREMIPSU', 'loremipsu'), 'lorem ipsum') or 10 * ends > 3 * n_texts or 10 * begins > 9 * n_texts or 10 * lettered < 7 * n_words) as kept
from b
"""
