"""Mix sources to target weights by entropy balancing, in DataFrame functions only.

Every document has a rate, 1 at first. Among all rates from 0 to ``most`` whose words meet the
target of each source, those of least relative entropy are exponentials of the source's
multiplier times the document's words, held at ``most``. The multipliers solve the convex dual
by Newton's method: each round sums rate-weighted words (gradient) and their squares
(curvature) over all documents, counted by source and size beforehand, which is exact as equal
sizes of a source have equal rates; the counts of a source are one row. A bracket around each multiplier takes over where a step
would leave it.

A rate becomes whole copies by a dither that a hash of the document fixes: copy k is taken if
(k - dither) / rate stays below the source's level. The level is a weighted quantile of these
places, found by three passes of finer and finer buckets; a few single documents then take up
what remains. So copies follow from the row and from a few numbers of its source alone:
neither ranks nor texts are shuffled, and reruns agree.

Defined cases: null or blank text has size 0 and is taken once, as 0 words; a null source is
a source of its own, last in order; rows that share id and text share their fate; sources
without words have target 0; an empty table gives no rows. ``replicated`` may be given columns
of any names; they pass through.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, no source's target is a larger multiple of its size.
MOST_COPIES = 3
#: Sources up to which their numbers are broadcast; beyond that rows are joined by source.
BROADCAST_SOURCES = 200_000
#: Buckets of a pass for the level (the first covers levels up to 4), repairs by one document,
#: and the share of a target by which its source's words may be off without one.
BUCKETS, PASSES, REPAIRS, NEAR = 1024, 3, 10, 1e-4
#: Documents of like size among which a repair chooses.
EACH = 8


def ordered(df: DataFrame, *by: Column) -> DataFrame:
    """``df`` with ``_index``, its 0-based place in the order of ``by``: rows are dealt by
    range, numbered in each range and moved by the sizes of the ranges before."""
    own = df.repartitionByRange(*by).sortWithinPartitions(*by)
    low = F.monotonically_increasing_id()
    own = common.stored(own.withColumns({"_part": F.shiftright(low, 33).cast("int"), "_in": low.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    return own.join(starts, "_part").withColumn("_index", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source``, where null meets null; keeps the columns of both once."""
    return a.join(b.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Weights repeat along the sources in code point order. Targets share out all words by
    weight; a target stops at ``most`` times its source, and what exceeds is shared again
    by weight until none is above. Each round is one aggregation to two numbers.
    """
    own = ordered(sizes, F.col("source").isNull().asc(), F.col("source").asc())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    own = common.stored(own.withColumn("weight", cycle[(F.col("_index") % len(weights)).cast("int")]).drop("_index"), "sources")
    total, weight = own.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, before = (total / weight if weight else 0.0), -1.0
    cap, share = most * F.col("source_size").cast("double"), F.col("weight")
    while level and level > before:  # the level only rises, and stops when no more sources are full
        full, open_ = own.agg(F.sum(F.when(share * level > cap, cap).otherwise(0.0)), F.sum(F.when(share * level > cap, 0.0).otherwise(share))).first()
        before, level = level, ((total - full) / open_ if open_ else level)
    return own.withColumn("target", F.least(cap, share * F.lit(level)))


def rate(most: float, multiplier: Column | None = None, size: Column | None = None) -> Column:
    """Rate of a document from ``size``, ``scale`` and ``multiplier``."""
    m, size = F.col("multiplier") if multiplier is None else multiplier, F.col("size") if size is None else size
    return F.greatest(F.lit(1e-300), F.least(F.lit(float(most)), F.exp(m * size / F.col("scale"))))


def multipliers(cells: DataFrame, by_source: DataFrame, most: float = MOST_COPIES, most_rounds: int = 100, settled: float = 1e-10) -> DataFrame:
    """``by_source`` (source, source_size, target, scale) with the ``multiplier`` for which
    the sum of n * size * rate over the source's ``cells`` (source, size, n) is its target.

    A source of w words has at most sqrt(2 * w) different sizes (200,000 for 20 thousand million
    words), so its cells are one row, on which all its rounds run: a query a round would leave
    the driver a plan and generated code for each.
    """
    target, scale = F.col("target"), F.col("scale")
    full = target >= most * F.col("source_size") * (1 - 1e-12)
    none = F.lit(None).cast("double")
    # twice what brings a document of one word to the most
    start = F.struct(F.when(full, 2 * log(most) * scale).otherwise(0.0).alias("m"), none.alias("low"), none.alias("high"), (~full & (target > 0)).alias("open"))

    def add(m: Column):
        def one(sums: Column, cell: Column) -> Column:
            r, words = rate(most, m, cell["size"]), cell["n"] * cell["size"]
            return common.let(r, lambda r: F.struct((sums["now"] + words * r).alias("now"), (sums["slope"] + F.when(r < most, words * r * cell["size"] / scale).otherwise(0.0)).alias("slope")))

        return one

    def moved(s: Column, sums: Column) -> Column:
        off, m = target - sums["now"], s["m"]
        low, high = F.when(off > 0, m).otherwise(s["low"]), F.when(off > 0, s["high"]).otherwise(m)
        newton = m + off / F.when(sums["slope"] > 0, sums["slope"])
        fits = newton.isNotNull() & F.coalesce(newton > low, F.lit(True)) & F.coalesce(newton < high, F.lit(True))
        middle = F.coalesce((low + high) / 2, m + F.signum(off) * (1 + F.abs(m)))
        still = F.abs(off) > settled * target
        return F.struct(F.when(still, F.when(fits, newton).otherwise(middle)).otherwise(m).alias("m"), low.alias("low"), high.alias("high"), still.alias("open"))

    def step(s: Column, _: Column) -> Column:
        sums = F.aggregate("_cells", F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("slope")), add(s["m"]))
        return F.when(s["open"], common.let(sums, lambda sums: moved(s, sums))).otherwise(s)

    listed = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("_cells"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most_rounds)), start, step)
    # rounded, as exponentials may differ in their last digits between machines
    return same_source(by_source, listed, "left").select(*by_source.columns, F.round(end["m"], 9).alias("multiplier"))


def few(by_source: DataFrame, n: int | None = None) -> DataFrame:
    """Marked for broadcast if its size (``n`` where that is known) is small enough."""
    return F.broadcast(by_source) if (by_source.count() if n is None else n) <= BROADCAST_SOURCES else by_source


def place(k: int, most: float) -> Column:
    """Level from which on copy ``k`` of a document is taken."""
    return (k - F.col("dither")) / rate(most)


def levels(own: DataFrame, by_source: DataFrame, most: int) -> DataFrame:
    """``by_source`` with ``level``: up to it the copies of the source's documents stay within its target."""
    state = common.stored(by_source.withColumns({"level": F.lit(0.0), "width": F.lit(4.0), "taken": F.lit(0.0)}), "levels", 4)
    n = state.count()
    for _ in range(PASSES):
        at = same_source(own.where("size > 0"), few(state, n)).select("source", "size", "level", "width", F.explode(F.array(*[place(k, most) for k in range(1, most + 1)])).alias("at"))
        at = at.where((F.col("at") >= F.col("level")) & (F.col("at") < F.col("level") + F.col("width")))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("at") - F.col("level")) / F.col("width") * BUCKETS))
        sums = at.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        # a row for each bucket
        upto = sums.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
        fits = F.col("taken") + F.col("upto") <= F.col("target")
        # the first bucket that has places and doesn't fit holds the level; without one all fit
        found = same_source(upto, few(state.select("source", "target", "taken"), n)).groupBy("source").agg(F.max(F.when(fits, F.col("upto"))).alias("more"), F.min(F.when(~fits, F.col("bucket"))).alias("next"))
        width = F.col("width") / BUCKETS
        new = same_source(state, found, "left")
        new = new.withColumns({"level": F.col("level") + F.when(F.col("next").isNull(), F.col("width")).otherwise(F.col("next") * width), "width": F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(width), "taken": F.col("taken") + F.coalesce("more", F.lit(0.0))})
        state = common.stored(new.select(state.columns), "levels", 4)
    return state.drop("width", "taken")


def copied(own: DataFrame, by_source: DataFrame, most: int) -> DataFrame:
    """``own`` (with source, size and dither) with the columns of ``by_source``, ``rate`` and ``copies``."""
    both = same_source(own, few(by_source))
    taken = sum((F.when(place(k, most) < F.col("level"), 1).otherwise(0) for k in range(1, most + 1)), F.lit(0))
    return both.withColumns({"rate": rate(most), "copies": F.when(F.col("size") == 0, 1).otherwise(taken).cast("int")})


def fixed(own: DataFrame, fixes: DataFrame) -> DataFrame:
    """``copies`` after the repairs: a few documents of each source."""
    own = own.join(few(fixes.withColumnsRenamed({"source": "_source", "key": "_key"})), F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key")), "left")
    return own.withColumn("copies", F.col("copies") + F.coalesce("fix", F.lit(0))).drop("_source", "_key", "fix")


def repairs(own: DataFrame, most: int) -> DataFrame:
    """(source, key, fix): documents to be taken once more or less, at most ``REPAIRS`` of each
    source, each the one that brings the source's words nearest to its target.

    One pass finds how far each source is off and, for each direction and size (quarters of
    powers of two), up to ``EACH`` documents that may change; the rest works on these alone.
    """
    off = own.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"), F.first("target").alias("target"))
    off = common.stored(off.where(F.abs("off") > NEAR * F.col("target")).select("source", "off"), "off", 4)
    live = own.where("size > 0").select("source", "size", "key", F.explode(F.filter(F.array(F.when(F.col("copies") < most, 1), F.when(F.col("copies") > 0, -1)), lambda x: x.isNotNull())).alias("fix"))
    may = live.groupBy("source", "fix", F.floor(4 * F.log2("size")).alias("band"), F.pmod("key", F.lit(EACH)).alias("part")).agg(F.min("key").alias("key"))
    may = common.stored(same_source(may, off.select("source")).select("source", "fix", "key"), "may", 4)
    # rows that share a key go together
    keys = few(may.select(F.col("source").alias("_source"), F.col("key").alias("_key")).distinct())
    words = own.join(keys, F.col("source").eqNullSafe(F.col("_source")) & (F.col("key") == F.col("_key"))).groupBy("source", "key").agg(F.sum("size").alias("words"))
    may = common.stored(_same(may, words, ["source", "key"]), "may", 4)
    # some hundred candidates a source at most, so its repairs are chosen in one row
    listed = may.groupBy("source").agg(F.collect_list(F.struct("key", "fix", "words")).alias("_may"))

    def pick(s: Column, _: Column) -> Column:
        left = lambda c: F.abs(s["off"] - c["fix"] * c["words"])
        here = F.filter("_may", lambda c: (left(c) < F.abs(s["off"])) & ~F.exists(s["done"], lambda d: d["key"] == c["key"]))
        best = F.array_min(F.transform(here, lambda c: F.struct(left(c).alias("left"), c["key"].alias("key"), c["fix"].alias("fix"), c["words"].alias("words"))))
        more = lambda p: F.struct((s["off"] - p["fix"] * p["words"]).alias("off"), F.concat(s["done"], F.array(F.struct(p["key"].alias("key"), p["fix"].alias("fix")))).alias("done"))
        return common.let(best, lambda p: F.when(p.isNull(), s).otherwise(more(p)))

    start = F.struct(F.col("off").alias("off"), F.array().cast("array<struct<key:bigint,fix:int>>").alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(REPAIRS)), start, pick)
    return common.stored(same_source(off, listed).select("source", F.explode(end["done"]).alias("d")).select("source", "d.key", "d.fix"), "fixes", 4)


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on ``source`` and a key, where null meets null for the source."""
    source, key = on
    b = b.withColumnsRenamed({c: f"_{c}" for c in on})
    match = F.col(source).eqNullSafe(F.col(f"_{source}")) & (F.col(key) == F.col(f"_{key}"))
    return a.join(b, match, how).drop(*[f"_{c}" for c in on])


def sized(docs: DataFrame, id: str, text: str, source: str) -> dict[str, Column]:
    """Columns that the mix works on, by name."""
    key = F.xxhash64(F.col(id), F.xxhash64(text))
    dither = F.shiftrightunsigned(F.xxhash64(key), 11) * 2.0**-53
    return {"source": F.col(source), "size": common.n_words(F.col(text)), "key": key, "dither": dither}


def solved(docs: DataFrame, id: str, text: str, source: str, weights: tuple[float, ...], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents by size, numbers of the sources, repairs)."""
    own = common.stored(docs.select(F.col(id).alias("id"), *[c.alias(n) for n, c in sized(docs, id, text, source).items()]), "sizes")
    cells = common.stored(own.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n"))
    by_source = targets(sums.select("source", "source_size"), weights, most)
    scale = F.greatest(F.lit(1.0), F.col("source_size") / F.col("n"))
    by_source = same_source(by_source, sums.select("source", "n")).select("source", "source_size", "target", scale.alias("scale"))
    by_source = common.stored(by_source, "sources", 4)
    by_source = levels(own, multipliers(cells, by_source, most), most)
    return own, by_source, repairs(copied(own, by_source, most), most)


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) of every document."""
    own, by_source, fixes = solved(docs, id, text, source, weights, most)
    return fixed(copied(own, by_source, most), fixes).select("id", "source", "size", "source_size", "target", "rate", "copies")


def replicated(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (columns unchanged)."""
    _, by_source, fixes = solved(docs, id, text, source, weights, most)
    row = common.free(docs, "__row")
    own = docs.select(F.struct(*docs.columns).alias(row), *[c.alias(n) for n, c in sized(docs, id, text, source).items()])
    own = fixed(copied(own, by_source, most), fixes).where("copies > 0")
    return own.select(row, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{row}.*")
