"""Mixing sources to target weights, in DataFrame operations only.

Each source gets a share of all words by weight, at most ``max_epochs`` times what it holds; the excess is
shared again by weight. Within a source, documents are ordered by a hash key; key ranges give distributed
prefix sums (one sum a range, then a running sum inside each range), and the source is cut at its exact word
budget after as many whole epochs as fit. The last document of the cut may be taken in part.

No source is ever in one task: ranges of the key are, and there are 4,096 of them a source. Equal rows are
counted before the shuffle and spread again after it, so a group of them is one row in its range.

Defined results: a null or empty text has no words; a very long text is one row like any other, and only it can be cut; a null source is a
source of its own, last in order; a null ``doc_id`` is kept, and rows of one id are told apart by their texts; rows that tie in id and text
are interchangeable, each counts; an empty table gives an empty result; only ``doc_id``, ``text`` and ``source`` are read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliofield.llm.runtime import save

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range of a source: 4,096 ranges.
RANGE_DIGITS = 3
#: A row is repeated at most this often in one step of a task.
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(sk, source_size, target) from one row a source: weights repeat over the sources in code-point order.

    A source is full at ``max_epochs`` times its size. In order of the level at which sources fill up, those
    below the final level are full and the others get that level times their weight."""
    order = Window.orderBy("sk")
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_epochs
    by_level = Window.orderBy(cap / F.col("w"), "sk")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / F.sum("w").over(after)
    # the level rises while sources fill up and falls from the first one that stays open: the highest is final
    stepped = ranked.withColumn("level", level)
    return stepped.withColumn("target", F.least((F.col("source_size") * max_epochs).cast("double"), F.max("level").over(whole) * F.col("w"))).select("sk", "source_size", "target")


def _groups(docs: DataFrame, seed: str, others: Column) -> DataFrame:
    """(sk, range, key, doc_id, source, size, tie, n): equal rows as one row with their number, saved.

    ``tie`` tells rows of equal key apart (a hash of further columns, or nothing)."""
    rows = docs.select(
        _source_key().alias("sk"),
        _key(seed).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        others.alias("tie"),
    )
    return save(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "mix-groups").withColumn("range", F.substring("key", 1, RANGE_DIGITS))


def _source_key() -> Column:
    return F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source").cast("string"), F.lit("")))


def _key(seed: str) -> Column:
    name, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text"))
    return F.md5(F.concat(F.lit(seed + ":"), name, F.lit(":"), F.md5(text)))


def _placed(groups: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """The groups with source_size, target, epochs, and ``part``: words of the group in the last, cut pass."""
    words = F.col("size") * F.col("n")
    ranges = groups.groupBy("sk", "range").agg(F.sum(words).alias("range_size"))
    targets = source_targets(ranges.groupBy("sk").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    based = (
        ranges.withColumn("base", F.coalesce(F.sum("range_size").over(Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(targets, "sk")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (F.floor(F.col("target") + 0.5) - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("sk", "range", "base", "source_size", "target", "epochs", "rest")
    )
    # rows of equal keys have equal texts, and so equal sizes
    run = Window.partitionBy("sk", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("before", F.coalesce(F.sum(words).over(run), F.lit(0))).join(based, ["sk", "range"])
    return placed.withColumn("part", F.greatest(F.lit(0), F.least(words, F.col("rest") - F.col("base") - F.col("before"))).cast("long"))


def _expanded(groups: DataFrame, number: Column, name: str) -> DataFrame:
    """Each group ``number`` times, numbered from 0 as ``name``; large numbers are dealt over tasks in chunks of ``CHUNK``."""
    chunks = groups.withColumn("__of", number.cast("long")).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__of - 1) div {CHUNK}"))))
    if not groups.where(number > CHUNK).isEmpty():
        chunks = chunks.repartition("sk", "__chunk", "key")
    first = F.col("__chunk") * CHUNK
    return chunks.withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK, F.col("__of")) - 1))).drop("__of", "__chunk")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs (whole passes), part (words of a last, cut pass)."""
    rows = _expanded(save(_placed(_groups(docs, seed, F.lit(0)), weights, max_epochs), "mix-placed"), F.col("n"), "i")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("i") * F.col("size"))).cast("long")
    return rows.withColumn("part", part).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "part")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The rows of the mix, repeated as often as it takes them; a cut copy keeps its first words.

    Rows are decided, not ids: a source's cut is one place in the order of all its rows, so each row finds its decision by comparing its own
    place with the cut. Texts are not shuffled, but for the rows that are equal to the one at the cut. Rows without words are not taken."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # the rows' own columns may have any name
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text", "source")}
    keyed = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)), *(F.col(c) for c in at))
    tie = F.xxhash64(*names)
    placed = save(_placed(_groups(keyed, seed, tie), weights, max_epochs).where("size > 0"), "mix-placed")
    order = F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "tie")
    first_cut = placed.where("part < size * n").groupBy("sk").agg(F.min(F.struct(order.alias("at"), "part")).alias("cut"))
    # one row a source, saved, so that its size is known when it is joined
    cuts = save(placed.groupBy("sk").agg(F.first("epochs").alias("epochs")).join(first_cut, "sk", "left").select("sk", "epochs", F.col("cut.at").alias("cut"), F.col("cut.part").alias("part")), "mix-cuts")
    place = F.struct(_key(seed).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), tie.alias("tie"))
    met = keyed.where(F.col("text").rlike(WORD)).select(*names, _source_key().alias("sk"), place.alias("at")).join(cuts, "sk")
    # all but the rows at the cut: one more pass before it, none after it
    whole = met.where("cut is null or at <> cut").withColumn("copies", F.col("epochs") + F.when(F.col("at") < F.col("cut"), 1).otherwise(0))
    whole = whole.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select(*names)
    # equal rows at the cut: as many more as fit whole, and one in part
    equal = met.where("at = cut").withColumn("size", word_count(F.col(at["text"]))).groupBy(*names, "sk", "size", "epochs", "part").agg(F.count("*").alias("n"), F.first("at.key").alias("key"))
    equal = save(equal, "mix-at-cut")  # one row a source
    total = F.col("epochs") * F.col("n") + F.ceil(F.col("part") / F.col("size"))
    cut = _expanded(equal.where(total > 0), total, "i").withColumn("left", F.col("epochs") * F.col("n") * F.col("size") + F.col("part") - F.col("i") * F.col("size"))
    text = F.array_join(F.slice(F.regexp_extract_all(at["text"], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("left").cast("int")), "")
    cut = cut.withColumn(at["text"], F.when(F.col("left") < F.col("size"), text).otherwise(F.col(at["text"]))).select(*names)
    return whole.unionByName(cut).toDF(*docs.columns)


def op2_source_mix(spark, sf_dir):
    from heliofield.llm.runtime import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, case when source is null then '1' else '0' || source end as sk, md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select sk, cast(sum(size) as bigint) as source_size from d group by sk),
w as (select *, [5, 2, 1][cast((row_number() over (order by sk) - 1) % 3 + 1 as integer)] as w from s),
l as (select *, cast(sum(source_size) over () - coalesce(sum(source_size * 3) over (order by cast(source_size * 3 as double) / w, sk rows between unbounded preceding and 1 preceding), 0) as double)
    / sum(w) over (order by cast(source_size * 3 as double) / w, sk rows between current row and unbounded following) as level from w),
t as (select sk, source_size, least(cast(source_size * 3 as double), max(level) over () * w) as target from l),
b as (select *, case when source_size > 0 then cast(floor(target + 0.5) as bigint) // source_size else 0 end as epochs from t),
p as (select d.*, b.source_size, b.target, b.epochs, cast(floor(target + 0.5) as bigint) - epochs * b.source_size as rest,
    coalesce(sum(size) over (partition by d.sk order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d join b on d.sk = b.sk)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken from p
"""
