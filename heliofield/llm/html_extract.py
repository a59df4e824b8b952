"""HTML main text by equivalence-class template deduction.

Pages of a host share a template. Every page is read into tokens: element paths, and text blocks at their path.
Tokens that occur equally often on every page of the host (same occurrence vector) form an equivalence class. A class is
large and frequent enough, or no template; of those, classes are nested by order and span: a class is valid if it lies in one gap of every
class that was taken before it (or that one in a gap of it). The tokens of valid classes, in order, are the host's template. A page is aligned
to it: blocks that follow the template's order are fixed text, what lies between them are the slots. The deepest template element that
holds most of the host's slot text is its main container. A page's text is its slots in the host's container, without elements whose
role is a menu, header, footer, sidebar, notice, advert, form or comment. An article or main element is further
evidence: it narrows the container where it holds most of its text, stands in where the page has no container,
and its text is taken for template text only if it recurs on ``MAIN_PAGES`` pages or more.

A class name or role tells a side part only if all its words do ("ad-slot", but not "related-work"); in an article, headings' labels and the ids of
pieces of text don't count. Text is kept or dropped by whole blocks, so a block with one word of its own is kept whole; words inside blocks are no tokens.

Occurrence vectors are compared by a fingerprint summed over pages, so no host is gathered in one task: per
(host, token) one partial sum a task is shuffled. Templates are small (each token is on half of the host's pages, so there are at most twice
as many as on its mean page), and
pages meet them in a broadcast join behind a check of their measured size, or in a join with a salted host.

Defined results: a null or empty page has an empty text; a very long page is read whole, in time that follows its length
(paths show ``DEEP`` levels, then a hash of the others; of the side elements around a block the outer ``AROUND`` count); a host with a single page has no template tokens and is
read by roles alone; pages with the same text count as one towards a template, and repeated rows are read alike; of containers that tie in
depth the one with more text counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliofield.llm.runtime import save
from heliofield.llm.url_filter import split_url

SALTS = 32
#: Templates up to this measured size are sent to all tasks; larger ones meet the pages in a salted join.
BROADCAST_BYTES = 16 << 20
#: A class is valid with this many tokens, on at least half of the host's pages.
CLASS_TOKENS = 2
#: Text inside an article or main element is the template's only if it is on this many pages.
MAIN_PAGES = 8
#: Per cent of the host's slot text that the main container holds.
CONTAINER_PERCENT = 60

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)\b.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attr>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[A-Za-z/!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.DOTALL | re.IGNORECASE,
)
_LABEL = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Paths of elements that hold a single piece of text (steps have no digits); none is a container.
_PIECE = r"/(p|h|li|dt|dd|th|pre|blockquote|address|caption|figcaption|summary|legend|ul|ol|dl)(\.[^/]*)?$"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body", "summary", "legend"}
_OWN_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div footer form header main nav ol section table ul dl blockquote td".split())
_SIDE = frozenset("nav footer aside form head dialog menu button fieldset".split())
_STRONG = frozenset("nav footer aside head dialog menu button".split())
#: Words of labels that tell a side part, and words that may stand beside them.
_SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners promo promos promotion sponsor sponsored sponsors menu menus nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets"
    " footer header masthead cookie cookies notice notices consent popup modal newsletter subscribe subscription share sharing social related comment comments replies disqus pagination pager search"
    " contentinfo complementary".split()
)
_PLAIN_WORDS = frozenset(
    "site page main top bottom left right primary secondary global local list box bar block wrap wrapper container inner outer area section button buttons link links post posts article articles"
    " story stories content signup slot unit item items form field input group panel row col column mobile desktop js user reader icons icon media trail toggle dropdown sub level first last bg text"
    " title head body region zone module component sticky float overlay gdpr privacy policy alert wp id class x size large small wide".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold blocks of their own.
_PARTS = frozenset("div section ul ol dl table aside form details center".split())
#: Levels whose steps a path shows, characters of a step, and side elements that are kept of those around a block.
DEEP, STEP_CHARS, AROUND = 64, 96, 64
_DIGITS = str.maketrans("0123456789", "ghijklmnop")


def _tells_side(label: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", label).lower()) if w]
    return any(w in _SIDE_WORDS for w in words) and all(w in _SIDE_WORDS or w in _PLAIN_WORDS for w in words)


def _label(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Path step (digits dropped), whether the element is beside the text outside an article and inside one, whether it is so inside only by its id, whether it is the article."""
    found = [(m[1].lower(), next(filter(None, m.groups()[1:]), "")) for m in _LABEL.finditer(attributes)] if attributes else []
    words = " ".join(x for _, x in found)
    main = name in ("article", "main") or any(x in ("main", "articleBody") for _, x in found)
    plain = main or name in ("html", "body")
    side = name in _SIDE or (not plain and any(_tells_side(w) for _, x in found for w in x.split()))
    # inside an article the id of a heading, or of a piece of text, is what links point to; that of a part with blocks names the part
    inner = name in _SIDE or (not plain and name not in _HEADINGS and any(_tells_side(w) for kind, x in found if kind != "id" for w in x.split()))
    named = not inner and not plain and name in _PARTS and any(_tells_side(w) for kind, x in found if kind == "id" for w in x.split())
    step = re.sub(r"[\d/]+", "", f"{name}.{'.'.join(words.split())}" if words else name)
    return step if len(step) <= STEP_CHARS else f"{step[: STEP_CHARS // 2]}.~{_letters(_hash(step))}", side, inner or named, named, main


def _letters(number: int) -> str:
    """A hash without digits, for paths."""
    return f"{number + 2**63:016x}".translate(_DIGITS)


def _below(path: str, depth: int, step: str) -> str:
    """The path of an element ``depth`` levels down. From ``DEEP`` levels on a path ends in a hash of its further steps, so its length is bounded."""
    if depth <= DEEP:
        return f"{path}/{step}"
    head, _, last = path.rpartition("/")
    return f"{head if depth > DEEP + 1 else path}/~{_letters(_hash(f'{last}/{step}' if depth > DEEP + 1 else step))}"


def _settled(blocks: list[tuple[str, tuple, bool, str]]) -> list[tuple[str, bool, bool, str]]:
    """Blocks with the side elements around them (number, surely a side part, in an article) read as one role.

    A side element around the page's articles is a wrapper if they hold more text than all that is beside no side element; so is one of
    an unsure role that holds most of a page that has no other text."""
    size = lambda own: sum(len(b[3]) for b in own)
    held = [b for b in blocks if b[2] and b[1] and not any(x[2] for x in b[1])]
    if held and size(held) > size([b for b in blocks if not b[1]]):
        blocks = [(b[0], tuple(x for x in b[1] if x[2]), b[2], b[3]) if b[2] else b for b in blocks]
    total = size(blocks)
    while blocks and all(b[1] for b in blocks):
        chars: Counter = Counter()
        for b in blocks:
            if not b[1][0][1]:
                chars[b[1][0][0]] += len(b[3])
        top = chars.most_common(1)
        if not top or 2 * top[0][1] < total:
            break
        blocks = [(b[0], tuple(x for x in b[1] if x[0] != top[0][0]), b[2], b[3]) for b in blocks]
    return [(b[0], bool(b[1]), b[2], b[3]) for b in blocks]


class _Stack:
    """The open elements. For each name the places where it is open are kept, so that what a tag closes is found without a walk."""

    def __init__(self):
        #: name, path, levels of the path, side elements around, in an article
        self.items: list[tuple[str, str, int, tuple, bool]] = [("", "", 0, (), False)]
        self.named: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.scopes, self.cells = [0], [0], []

    def push(self, item: tuple[str, str, int, tuple, bool]) -> None:
        name, at = item[0], len(self.items)
        self.items.append(item)
        self.named[name].append(at)
        if name in _BLOCK:
            self.blocks.append(at)
        if name in _SCOPE:
            (self.cells if name == "td" else self.scopes).append(at)

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            name = self.items.pop()[0]
            self.named[name].pop()
            if name in _BLOCK:
                self.blocks.pop()
            if name in _SCOPE:
                (self.cells if name == "td" else self.scopes).pop()

    def _last(self, name: str) -> int:
        own = self.named.get(name)
        return own[-1] if own else 0

    def end(self, name: str) -> None:
        """An inline end tag reaches up to the nearest block, a block's to any of its name."""
        at = self._last(name)
        if at and (name in _BLOCK or at > self.blocks[-1]):
            self.cut(at)

    def close_for(self, name: str) -> None:
        """What a start tag closes: an open paragraph, and elements of its own sort, within the scope."""
        if name in _CLOSES_P and (at := self._last("p")) > max(self.scopes[-1], self.cells[-1] if self.cells else 0):
            self.cut(at)
        if name in _OWN_CLOSE and (at := max(map(self._last, _OWN_CLOSE[name]))) > self.scopes[-1]:
            self.cut(at)


def read_page(page: str, steps: dict | None = None) -> tuple[list[tuple[str, bool, bool, str]], dict[str, list[int]], list[int]]:
    """Blocks in page order as (path, beside the text, in an article, text), how often and where first each path opens, and the blocks' places."""
    steps = {} if steps is None else steps
    stack = _Stack()
    blocks: list[tuple[str, tuple, bool, str]] = []
    opened: dict[str, list[int]] = {}
    places: list[int] = []
    number = tick = 0
    bare: set[int] = set()  # parts of an article that only an id tells, as long as they hold no blocks
    pending: list[str] = []
    owner: tuple[str, tuple, bool] = ("", (), False)

    def flush() -> None:
        nonlocal tick
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                blocks.append((*owner, text))
                places.append(tick)
                tick += 1
            pending.clear()

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not pending:
                top = stack.items[-1]
                owner = (stack.items[stack.blocks[-1]][1], top[3], top[4])
            pending.append(text)
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            if pending:
                pending.append(" ")
            continue
        block = name in _BLOCK
        if block:
            flush()
        if m["end"]:
            stack.end(name)
            continue
        stack.close_for(name)
        if name in _VOID or m["attr"].endswith("/"):
            continue
        key = (name, m["attr"])
        got = steps.get(key)
        if got is None:
            got = _label(*key)
            if len(steps) < 10000:
                steps[key] = got
        step, side, inner, named, main = got
        _, path, depth, around, article = stack.items[-1]
        if block and bare:
            bare.difference_update(x[0] for x in around)
        side = inner if article else side
        if name == "header":
            side = not article  # an article's own heading
        if block:
            depth += 1
            path = _below(path, depth, step)
            opened.setdefault(path, [0, tick])[0] += 1
            tick += 1
        number += 1
        own = ((number, name in _STRONG or name == "header", article),) if side and len(around) < AROUND else ()
        if own and article and named:
            bare.add(number)
        stack.push((name, path, depth, around + own if own else around, article or main))
    flush()
    if bare:
        blocks = [(path, tuple(x for x in around if x[0] not in bare), article, text) for path, around, article, text in blocks]
    return _settled(blocks), opened, places


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _fixed(path: str, text: str) -> int:
    """The key of a text block: its text at its path."""
    return _hash(f"{path}\n{text}")


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, path, text_hash, n, place, chars, slot, main): a page's tokens; ``text_hash`` is null for element paths."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for host, _, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks, opened, places = read_page(source or "", steps)
                page = _hash("\n".join([b[3] for b in blocks if not b[1]] or [b[3] for b in blocks]))  # copies count once
                found: dict[tuple[str, int | None], list] = {("", None): [1, -1, 0, False, False]}
                for path, (n, place) in opened.items():
                    found[path, None] = [n, place, 0, False, False]
                for (path, side, main, text), place in zip(blocks, places, strict=True):
                    entry = found.setdefault((path, _fixed(path, text)), [0, place, 0, not side, main])
                    entry[0] += 1
                    entry[2] += len(text)
                for (path, text), (n, place, chars, slot, main) in found.items():
                    for col, value in zip(cols, (host, page, path, text, n, place, chars, slot, main), strict=True):
                        col.append(value)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "page", "path", "text_hash", "n", "place", "chars", "slot", "main"])

    return pages.mapInArrow(tokens, "host string, page long, path string, text_hash long, n long, place long, chars long, slot boolean, main boolean")


def occurrences(tokens: DataFrame) -> DataFrame:
    """(host, path, text_hash, pages, vector, place, chars, slot, main): one row a token of a host; equal vectors make a class."""
    vector = F.pmod(F.xxhash64("page", "n"), F.lit(2**31))
    once = tokens.groupBy("host", "page", "path", "text_hash").agg(F.max("n").alias("n"), F.min("place").alias("place"), F.max("chars").alias("chars"), F.bool_and("slot").alias("slot"), F.bool_or("main").alias("main"))
    return once.groupBy("host", "path", "text_hash").agg(F.count("*").alias("pages"), F.sum(vector).alias("vector"), F.avg("place").alias("place"), F.sum("chars").alias("chars"), F.bool_and("slot").alias("slot"), F.bool_or("main").alias("main"))


def nested(classes: dict[tuple[int, int], list[float]]) -> set[tuple[int, int]]:
    """Of classes (pages, vector) with their tokens' places in order: those that nest. Classes on more pages, then larger ones, go first."""
    taken: list[tuple[tuple[int, int], list[float]]] = []
    one_gap = lambda inner, outer: bisect_left(outer, inner[0]) == bisect_right(outer, inner[-1])
    for name in sorted(classes, key=lambda c: (-c[0], -len(classes[c]), c[1])):
        own = sorted(classes[name])
        if all(one_gap(own, x) or one_gap(x, own) for _, x in taken):
            taken.append((name, own))
    return {name for name, _ in taken}


def _templates(hosts: DataFrame) -> DataFrame:
    """(host, path, text_hash, rank) of the tokens of valid classes; ``hosts``: a row a host with its candidate tokens."""

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for host, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                classes = defaultdict(list)
                for t in tokens:
                    classes[t["pages"], t["vector"]].append(t["place"])
                valid = nested(classes)
                fixed = sorted((t for t in tokens if (t["pages"], t["vector"]) in valid), key=lambda t: (t["place"], t["path"], t["text_hash"] or 0))
                for rank, t in enumerate(fixed):
                    for col, value in zip(cols, (host, t["path"], t["text_hash"], rank), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "text_hash", "rank"])

    return hosts.mapInArrow(nest, "host string, path string, text_hash long, rank long")


def deduce_templates(tokens: DataFrame) -> DataFrame:
    """(host, container, template_text, template_rank): the main container's path, and the template's text blocks with their order."""
    seen = save(occurrences(tokens), "tokens")
    size = seen.where("path = '' and text_hash is null").select("host", F.col("pages").alias("host_pages"))
    classes = seen.groupBy("host", "pages", "vector").agg(F.count("*").alias("members"))
    frequent = classes.join(size, "host").where((F.col("members") >= CLASS_TOKENS) & (F.col("pages") * 2 >= F.col("host_pages")) & (F.col("host_pages") >= 2))
    candidates = seen.join(frequent.select("host", "pages", "vector"), ["host", "pages", "vector"])
    # at most twice the tokens of a mean page
    hosts = candidates.groupBy("host").agg(F.collect_list(F.struct("path", "text_hash", "pages", "vector", "place")).alias("tokens"))
    template = save(_templates(hosts), "template-tokens")
    facts = seen.select("host", "path", "text_hash", "pages", "main").join(size, "host")
    same = F.coalesce(F.col("t.text_hash"), F.lit(0)) == F.coalesce(F.col("s.text_hash"), F.lit(0))
    met = template.alias("t").join(facts.alias("s"), (F.col("t.host") == F.col("s.host")) & (F.col("t.path") == F.col("s.path")) & same & F.col("t.text_hash").isNotNull())
    fixed_rows = met.where(f"host_pages >= 3 and (not main or pages >= {MAIN_PAGES})").select("t.host", "t.path", "t.text_hash", "rank")
    fixed = fixed_rows.groupBy("host").agg(F.collect_list(F.struct("text_hash", "rank")).alias("fixed"))
    fixed = fixed.select("host", F.col("fixed.text_hash").alias("template_text"), F.col("fixed.rank").alias("template_rank"))
    slots = seen.where("slot and text_hash is not null").join(fixed_rows.select("host", "path", "text_hash"), ["host", "path", "text_hash"], "left_anti").groupBy("host", "path").agg(F.sum("chars").alias("chars"))
    steps = F.split("path", "/")
    up = slots.select("host", "chars", steps.alias("steps"), F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth"))
    held = up.groupBy("host", "depth", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/").alias("path")).agg(F.sum("chars").alias("chars"))
    total = held.groupBy("host").agg(F.max("chars").alias("total"))
    main = held.join(total, "host").where(F.col("chars") * 100 >= F.col("total") * CONTAINER_PERCENT)
    elements = template.where(F.col("text_hash").isNull() & ~F.col("path").rlike(_PIECE)).select("host", "path")
    main = main.join(elements.withColumn("known", F.lit(True)), ["host", "path"], "left").where((F.col("depth") == 1) | F.col("known"))
    container = main.groupBy("host").agg(F.max(F.struct("depth", "chars", "path"))["path"].alias("container"))
    return size.select("host").join(container, "host", "left").join(fixed, "host", "left")


def _aligned(ranks: list[tuple[int, int]]) -> set[int]:
    """Of (place, rank) in page order the places of a longest run in the template's order."""
    tails: list[int] = []
    ends: list[int] = []
    before: dict[int, int | None] = {}
    for k, (_, rank) in enumerate(ranks):
        at = bisect_right(tails, rank)
        tails[at : at + 1] = [rank]
        ends[at : at + 1] = [k]
        before[k] = ends[at - 1] if at else None
    out, k = set(), ends[-1] if ends else None
    while k is not None:
        out.add(ranks[k][0])
        k = before[k]
    return out


def page_text(source: str, container: str | None, template: dict[int, int], steps: dict) -> str:
    blocks, _, _ = read_page(source, steps)
    keys = [_fixed(b[0], b[3]) for b in blocks] if template else []
    fixed = _aligned([(k, template[x]) for k, x in enumerate(keys) if x in template])
    inside = [(k, b) for k, b in enumerate(blocks) if not b[1]]
    if container:
        under = [(k, b) for k, b in inside if b[0] == container or b[0].startswith(container + "/")]
        outside = any(b[2] for _, b in inside) and not any(b[2] for _, b in under)
        held = {k for k, _ in under}
        inside = [(k, b) for k, b in inside if b[2] or k in held] if outside else under or inside
    slots = [b for k, b in inside if k not in fixed]
    main = [b for b in slots if b[2]]
    if 2 * sum(len(b[3]) for b in main) >= sum(len(b[3]) for b in slots):
        slots = main or slots
    return "\n".join(b[3] for b in slots)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text, n_chars."""
    host, _ = split_url(F.col("url"))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col("html").cast("string").alias("html"))
    templates = save(deduce_templates(page_tokens(source.select("host", "page_id", "html"))), "templates")
    weight = templates.agg(F.sum(64 + F.octet_length("host") + F.coalesce(F.octet_length("container"), F.lit(0)) + 16 * F.greatest(F.size("template_text"), F.lit(0))).alias("n")).first()["n"] or 0
    if weight <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict = {}
        for batch in batches:
            out = [page_text(h or "", c, dict(zip(t or (), r or (), strict=True)), steps) for h, c, t, r in zip(*(x.to_pylist() for x in batch.columns[3:7]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "host", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "container", "template_text", "template_rank").mapInArrow(texts, "page_id long, url string, host string, text string, n_chars long")
