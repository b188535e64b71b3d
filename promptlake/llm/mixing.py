"""Mixing sources to target weights by entropy balancing (operator 13).

Each source is to give a target number of words. Among all document rates that
meet the targets and stay between 0 and `most`, those nearest to one copy of each
document (least relative entropy) are exp(l * size), cut at `most`, with one
multiplier l for each source: the solution of a convex dual. Newton steps inside a
bracket find all multipliers at once. A step is one grouped sum over the counts of
documents of equal source and size, which lose nothing, since such documents have
equal rates. The multipliers stay a table and never come to the driver.

Rounding: the expected copies of a (source, size) class are rounded by a hash, what
a source then lacks or has too much is made good with one class for each power of two of
the sizes, and a class's copies go to its documents evenly, one more to those
with the smallest hashes.

Only DataFrame functions are used. Defined results: null and blank texts have size 0, are
taken as 0 words and have 0 copies; a null source is a source of its own and comes last; rows equal in id and text get equal
copies; an empty table gives an empty result; a source whose words are all taken `most` times is at its target; with no words at all every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlake.llm.base import discard, hidden, ranked, stored

#: What counts as a word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Relative distance to its target at which a source's multiplier is found, and the steps at most; bisection inside the bracket halves it in any step.
NEAR, STEPS = 1e-6, 60
#: Rounds that make good what rounding left, and the relative distance at which a source needs none.
REPAIRS, CLOSE = 6, 2e-4
#: Further roundings tried for sources of which the first is more than five times as far away.
ATTEMPTS = 64
#: Documents of a class that are ordered in one task, and classes in one part of a table of classes.
ORDERED, PART_ROWS = 512, 50_000
_CLASS = ["none", "source", "size"]


def _kept(df: DataFrame, name: str, parts: int) -> DataFrame:
    """Stored in so many parts: the rounds write small tables again and again, one file for each partition of a shuffle."""
    return stored(df.coalesce(parts), name)


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """sources (none, source, source_size) with source_no from 1 and the target.

    `weights` repeat over the sources by code point, null last. No target is above `most`
    times its source's size; what is above is shared out again by weight, until none is.
    """
    told = ranked(sources, [F.col("none"), F.col("source")], "source_no")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    told = told.withColumn("weight", weight).withColumn("top", most * F.col("source_size").cast("double"))
    total = told.agg(_sum("source_size")).first()[0] * share
    level, full = 0.0, -1
    while True:
        over = F.col("top") <= F.col("weight") * level
        row = told.agg(F.count(F.when(over, 1)).alias("n"), _sum(F.when(over, F.col("top"))).alias("top"), _sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row.n == full or not row.open:
            break
        full, level = row.n, max(level, (total - row.top) / row.open)
    return told.withColumn("target", F.least(F.col("weight") * level, F.col("top"))).drop("weight", "top")


def multipliers(classes: DataFrame, sources: DataFrame, most: int, parts: int = 1) -> DataFrame:
    """(source_no, target, scale, lam): each source's multiplier of size / scale, by Newton steps on the dual.

    classes: source_no, size, n. The first bracket holds the solution: at its lower end even a size of 1
    has too small a rate, at its upper end every rate is `most`.
    """
    size = F.col("size").cast("double")
    known = classes.groupBy("source_no").agg(_sum(F.col("n") * size).alias("words"), _sum(F.col("n") * size * size).alias("squares"))
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(1.0)
    state = sources.select("source_no", "target").join(known, "source_no").withColumn("scale", F.when(F.col("words") > 0, F.col("squares") / F.col("words")).otherwise(1.0))
    full = ratio >= most * (1 - 1e-12)
    state = state.select(
        "source_no",
        "target",
        "scale",
        F.when(full, F.col("scale") * math.log(most)).otherwise(F.log(F.greatest(ratio, F.lit(1e-300)))).alias("lam"),
        F.when(ratio < 1, F.col("scale") * F.log(F.greatest(ratio, F.lit(1e-300)))).otherwise(0.0).alias("lo"),
        F.when(ratio > 1, F.col("scale") * math.log(most)).otherwise(0.0).alias("hi"),
        (full | (F.col("words") == 0)).alias("done"),
    )
    state = _kept(state, "mix-state", parts)
    power = F.col("lam") * size / F.col("scale")
    rate = F.exp(F.least(power, F.lit(math.log(most))))
    for _ in range(STEPS):
        # the dual's slope is words - target, its second derivative is bend
        sums = classes.join(state, "source_no").groupBy(*state.columns).agg(
            _sum(F.col("n") * size * rate).alias("words"),
            _sum(F.when(power < math.log(most), F.col("n") * size * size / F.col("scale") * rate)).alias("bend"),
        )
        lo = F.when(F.col("words") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("words") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + (F.col("target") - F.col("words")) / F.when(F.col("bend") > 0, F.col("bend"))
        inside = F.coalesce((newton > lo) & (newton < hi), F.lit(False))
        done = F.col("done") | (F.abs(F.col("words") - F.col("target")) <= NEAR * F.col("target"))
        moved = F.when(done, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2)
        new = _kept(sums.select("source_no", "target", "scale", moved.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "mix-state", parts)
        discard(state)
        state = new
        if state.where("NOT done").isEmpty():
            break
    return state.select("source_no", "target", "scale", "lam")


def _rounded(classes: DataFrame, found: DataFrame, most: int, seed: int, attempts: range, parts: int) -> DataFrame:
    """classes with whole `copies`, for each attempt a rounding of its own whose words come near the targets."""
    each = ["attempt", "source_no"]
    rate = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(most))))
    chance = F.pmod(F.xxhash64(F.lit(seed), *each, "size"), F.lit(1 << 30)) / float(1 << 30)
    rounded = F.when(F.col("size") > 0, F.least(most * F.col("n"), F.floor(F.col("n") * rate + chance))).otherwise(0)
    told = classes.join(found, "source_no").withColumn("attempt", F.explode(F.array(*map(F.lit, attempts)))).withColumn("copies", rounded)
    told = _kept(told.select("attempt", *classes.columns, "target", "copies"), "mix-copies", parts * len(attempts))
    for _ in range(REPAIRS):
        left = told.groupBy(*each, "target").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        left = left.withColumn("lacks", F.floor(F.col("target") - F.col("words") + 0.5)).where(F.abs("lacks") > CLOSE * F.col("target")).drop("words", "target")
        room = F.when(F.col("lacks") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        offer = told.join(left, each).withColumn("room", room).where((F.col("room") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("lacks")))
        # of each power of two the class with the most room: at most 64 a source
        best = offer.groupBy(*each, "lacks", F.floor(F.log2("size")).alias("power")).agg(F.max(F.struct(F.col("room") * F.col("size"), "size", "room")).alias("best"))
        lists = best.groupBy(*each, "lacks").agg(F.sort_array(F.collect_list(F.struct("best.size", "best.room")), asc=False).alias("offers"))
        none = F.array().cast("array<struct<size:bigint,change:bigint>>")

        def take(state: Column, x: Column) -> Column:
            k = F.least(x["room"], F.floor(state["open"] / x["size"]))
            return F.struct((state["open"] - k * x["size"]).alias("open"), F.concat(state["moves"], F.array(F.struct(x["size"].alias("size"), k.alias("change")))).alias("moves"))

        moves = F.aggregate("offers", F.struct(F.abs("lacks").alias("open"), none.alias("moves")), take, lambda s: s["moves"])
        changes = lists.select(*each, F.signum("lacks").cast("long").alias("sign"), F.explode(moves).alias("m")).select(*each, "m.size", (F.col("sign") * F.col("m.change")).alias("change")).where("change != 0")
        changes = _kept(changes, "mix-changes", parts)
        if changes.isEmpty():
            discard(changes)
            break
        new = _kept(told.join(changes, [*each, "size"], "left").select("attempt", *classes.columns, "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")), "mix-copies", parts * len(attempts))
        for old in (told, changes):
            discard(old)
        told = new
    return told


def class_copies(classes: DataFrame, found: DataFrame, most: int, seed: int, parts: int = 1) -> DataFrame:
    """classes (source_no, size, n) with whole `copies` whose words come near each source's target.

    Sources of few documents that one rounding leaves too far away get ATTEMPTS more; the nearest counts.
    """

    def missed(told: DataFrame) -> DataFrame:
        gap = F.abs(F.sum(F.col("size") * F.col("copies")) - F.first("target"))
        return told.groupBy("source_no", "attempt").agg(gap.alias("gap"), F.first("target").alias("target"))

    first = _rounded(classes, found, most, seed, range(1), parts)
    far = _kept(missed(first).where(F.col("gap") > 5 * CLOSE * F.col("target")).select("source_no"), "mix-far", parts)
    if far.isEmpty():
        discard(far)
        told = first.drop("attempt", "target")
        told.stored_at = first.stored_at
        return told
    again = _rounded(classes.join(far, "source_no", "left_semi"), found, most, seed, range(1, ATTEMPTS + 1), parts)
    both = first.unionByName(again)
    nearest = missed(both).groupBy("source_no").agg(F.min(F.struct("gap", "attempt"))["attempt"].alias("attempt"))
    best = _kept(both.join(nearest, ["source_no", "attempt"], "left_semi").drop("attempt", "target"), "mix-copies", parts)
    for old in (first, again, far):
        discard(old)
    return best


def _cuts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with `base` and `cut`: documents with a hash up to cut (none, if null) get one copy more than base.

    A large class is first counted by ranges of its hashes, about ORDERED documents each; only the
    documents of the range in which the last extra copy lies are put in order.
    """
    base = F.floor(F.col("copies") / F.col("n"))
    told = classes.withColumn("base", base).withColumn("extra", F.col("copies") - base * F.col("n"))
    ranges = F.ceil(F.col("n") / ORDERED)
    where = F.floor((F.shiftrightunsigned("mark", 12) / float(1 << 52)) * F.col("ranges")).cast("long")
    open_ = told.where("extra > 0").select(*_CLASS, "extra", ranges.alias("ranges"))
    marked = rows.join(open_, _CLASS).withColumn("at", where)
    counts = marked.groupBy(*_CLASS, "at", "extra").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_CLASS).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("n") >= F.col("extra")))
    inside = marked.drop("extra", "ranges").join(last.select(*_CLASS, "at", (F.col("extra") - F.col("before")).alias("rest")), [*_CLASS, "at"])
    # equal marks are equal rows: counted first, then all of them or none, whichever is nearer
    equal = inside.groupBy(*_CLASS, "rest", F.shiftrightunsigned("mark", 12).alias("high"), "mark").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_CLASS).orderBy("high", "mark"))
    chosen = equal.withColumn("upto", upto).where(2 * F.col("upto") - F.col("n") <= 2 * F.col("rest"))
    cut = chosen.groupBy(*_CLASS).agg(F.max(F.struct("high", "mark")).alias("cut"))
    # without one in the last range, the ranges before it still count
    edge = last.select(*_CLASS, "at").join(open_.select(*_CLASS, "ranges"), _CLASS)
    edge = edge.select(*_CLASS, F.struct((F.floor(F.col("at") * float(1 << 52) / F.col("ranges")).cast("long") - 1).alias("high"), F.lit((1 << 63) - 1).alias("mark")).alias("edge"))
    return told.join(edge, _CLASS, "left").join(cut, _CLASS, "left").select(*_CLASS, "source_no", "base", F.coalesce("cut", "edge").alias("cut"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: int = 13,
    as_column: str = "mix",
) -> DataFrame:
    """docs with a struct column: size, source_size, target (both of its source), copies, taken (size * copies).

    The targets share `share` times all words by `weights`.
    """
    name = hidden(docs, "row__")
    row = F.struct(
        F.isnull(source).alias("none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), key, text).alias("mark"),
    )
    told = docs.withColumn(name, row)
    rows = stored(told.select(f"{name}.*"), "mix-rows")
    counted = stored(rows.groupBy(*_CLASS).agg(F.count("*").alias("n")), "mix-counts")
    parts = 1 + counted.count() // PART_ROWS
    ordered = source_targets(counted.groupBy("none", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    sources = _kept(ordered, "mix-sources", parts)
    classes = _kept(counted.join(sources.select("none", "source", "source_no"), ["none", "source"]), "mix-classes", parts)
    copies = class_copies(classes, multipliers(classes, sources, most, parts), most, seed, parts)
    plan = _cuts(rows, copies).join(sources.select("source_no", "source_size", "target"), "source_no").drop("source_no")
    plan = _kept(plan, "mix-plan", parts)
    for done in (rows, counted, sources, classes, copies):
        discard(done)
    place = hidden(docs, "plan__")
    plan = plan.select(*(F.col(c).alias(f"{place}{c}") for c in _CLASS), F.struct("base", "cut", "source_size", "target").alias(place))
    joined = told.join(plan, [F.col(f"{name}.{c}") == F.col(f"{place}{c}") for c in _CLASS])
    mark = F.struct(F.shiftrightunsigned(f"{name}.mark", 12).alias("high"), F.col(f"{name}.mark").alias("mark"))
    number = F.col(f"{place}.base") + F.coalesce((mark <= F.col(f"{place}.cut")).cast("long"), F.lit(0))
    result = F.struct(
        F.col(f"{name}.size").alias("size"),
        F.col(f"{place}.source_size").alias("source_size"),
        F.col(f"{place}.target").alias("target"),
        number.alias("copies"),
        (number * F.col(f"{name}.size")).alias("taken"),
    )
    return joined.select(*(F.col(c) for c in docs.columns), result.alias(as_column))


def copied(mixed: DataFrame, column: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it has copies."""
    again = hidden(mixed, "copy__")
    times = F.sequence(F.lit(1), F.col(f"{column}.copies"))
    return mixed.where(F.col(f"{column}.copies") > 0).withColumn(again, F.explode(times)).drop(again)


__all__ = ["class_copies", "copied", "mix", "multipliers", "source_targets"]
