"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines (trimmed, blank ones left out) that are equal, or that few enough insertions, deletions
and substitutions separate, are links; of each connected class the first line in order of
document id and place is kept. How many edits count as few follows the shorter line's length
at every size: one for each full ``chars_an_edit`` characters, ``edits`` at most, so that no
word becomes another one. A distinct line with t edits is cut into t + 1 segments, of which
an edit-close line must hold one unchanged near its place; it is looked up among the
substrings that length and place allow. Most keys belong to one line; they go before anything
but the key is shuffled with them. Lines that share one differ little in letter counts or
aren't compared; the rest are verified by a banded bit-parallel edit distance.

Keys that very many lines share meet in a join whose sides adaptive execution splits; pairs
are filtered by letter counts inside it, so a group is never emitted whole.

Defined cases: null text has no lines; a repeated row's lines are copies of the first row's;
null ids come last; an empty table gives no rows. ``deduplicated`` may be given columns
``__id`` and ``__keep``; they pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

EDITS, CHARS_AN_EDIT = 2, 10
#: Letters whose counts are compared, eight to a sketch.
LETTERS = ("etaoinsr", "hldcumfp", "gywbvk .")
#: Line ids (8 bytes each) up to which candidates' ids are broadcast to fetch their texts;
#: beyond that the texts are shuffled.
BROADCAST_IDS = 2_000_000


def allowed(length: Column, edits: int, chars_an_edit: int) -> Column:
    """Edits that may separate a line of this length from a longer or equal one."""
    return F.least(F.lit(edits), F.floor(length / chars_an_edit)).cast("int")


def segment(length: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """(1-based start, length) of segment ``i`` of an even partition; later ones are longer."""
    base, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    before = F.greatest(F.lit(0), i - parts + extra)
    return 1 + i * base + before, base + F.when(i >= parts - extra, 1).otherwise(0)


def cuts(edits: int, probe: bool) -> list[tuple[int, int, int, int]]:
    """(edits of the shorter line, segment, characters that the other line is longer by, move)
    of the places to be looked up; an index key stands at its own place.

    Segment i moves by at most i edits before it and the others after it, seen from either end
    of the line.
    """
    if not probe:
        return [(t, i, 0, 0) for t in range(1, edits + 1) for i in range(t + 1)]
    return [(t, i, less, move) for t in range(1, edits + 1) for less in range(t + 1) for i in range(t + 1) for move in range(max(-i, less - (t - i)), min(i, less + t - i) + 1)]


def keys(own: DataFrame, edits: int, chars_an_edit: int, probe: bool) -> DataFrame:
    """(line_id, t, key): a row for each segment of a line, or for each substring that
    can equal a segment of another line of the same length or less.

    ``own``: line_id, n, chars (four bytes each, so that a substring is found at once).
    Places come as rows, so the key is one small expression that the compiler takes.
    """
    places = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(x, ("t", "i", "less", "move"), strict=True)]) for x in cuts(edits, probe)])
    rows = own.select("line_id", "n", "chars", F.explode(places).alias("p")).select("line_id", "n", "chars", "p.*")
    of = F.col("n") - F.col("less")
    rows = rows.where(allowed(of, edits, chars_an_edit) == F.col("t"))
    start, size = segment(of, F.col("i"), F.col("t") + 1)
    rows = rows.select("line_id", "t", "i", "n", of.alias("of"), "chars", (start + F.col("move")).alias("at"), size.alias("size"))
    rows = rows.where((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n")))
    part = F.substring("chars", 4 * F.col("at") - 3, 4 * F.col("size"))
    return rows.select("line_id", "t", F.xxhash64("t", "i", "of", part).alias("key"))


def sketch(line: Column, letters: str) -> Column:
    """Counts of up to eight letters modulo 256, one in each byte."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(letters):
        n = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(255)), 8 * k))
    return out


def sketches(line: Column) -> list[Column]:
    return [sketch(line, k).alias(f"sketch{i}") for i, k in enumerate(LETTERS)]


def sketch_distance(a: str, b: str) -> Column:
    """At most twice the edit distance: each edit changes two counts by one at most. ``a``,
    ``b``: prefixes of the columns of two lines."""
    total = F.lit(0)
    for i, letters in enumerate(LETTERS):
        x, y = F.col(f"{a}sketch{i}"), F.col(f"{b}sketch{i}")
        for k in range(len(letters)):
            d = F.abs(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)) - F.shiftright(y, 8 * k).bitwiseAND(F.lit(255)))
            total = total + F.least(d, 256 - d)
    return total


def distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else more than that: Hyyrö's
    bit-parallel recurrence on a diagonal band of 2 * edits + 1 bits, one step for each character of the
    shorter string. The band's lowest cell is followed down to the last row, then along it.
    """
    width = 2 * edits + 1
    ones = (1 << width) - 1
    bit_and, bit_or, bit_xor = Column.bitwiseAND, Column.bitwiseOR, Column.bitwiseXOR
    inverse = lambda x: bit_xor(x, F.lit(ones))
    n = lambda x: F.lit(x).cast("int")

    def run(s: Column) -> Column:
        long, short = s["long"], s["short"]
        rows = F.size(long)

        def step(x: Column, i: Column) -> Column:
            c = F.get(short, i)
            match = n(0)
            for b in range(width):
                match = bit_or(match, F.when(F.get(long, i + (b - edits)) == c, n(1 << b)).otherwise(n(0)))
            with_match = lambda m: bit_and(bit_or(bit_or(bit_xor(bit_and(m, x["vp"]) + x["vp"], x["vp"]), m), x["vn"]), n(ones))
            return common.let(common.let(match, with_match), lambda d0: moved(x, i, d0))

        def moved(x: Column, i: Column, d0: Column) -> Column:
            hp = bit_or(x["vn"], inverse(bit_or(d0, x["vp"])))
            return common.let(F.struct(d0.alias("d0"), hp.alias("hp"), bit_and(d0, x["vp"]).alias("hn")), lambda h: after(x, i, h))

        def after(x: Column, i: Column, h: Column) -> Column:
            down = F.shiftright(h["d0"], 1)
            along = i >= rows - edits  # the band's lowest cell has passed the last row
            last = F.when(along, F.call_function("shiftright", n(1 << width - 1), (i - rows + edits + 1).cast("int"))).otherwise(n(0))
            seen = lambda v: F.when(bit_and(v, last) != 0, 1).otherwise(0)
            gain = F.when(along, seen(h["hp"]) - seen(h["hn"])).otherwise(F.when(bit_and(h["d0"], n(1 << width - 1)) != 0, 0).otherwise(1))
            return F.struct(bit_or(h["hn"], inverse(bit_or(down, h["hp"]))).alias("vp"), bit_and(down, h["hp"]).alias("vn"), (x["dist"] + gain).cast("int").alias("dist"))

        first = F.struct(n(ones ^ ((1 << edits) - 1)).alias("vp"), n(0).alias("vn"), n(edits).alias("dist"))
        return F.aggregate(F.sequence(n(0), F.size(short) - 1), first, step, lambda x: x["dist"])

    swap = F.length(a) < F.length(b)
    both = F.struct(F.split(F.when(swap, b).otherwise(a), "").alias("long"), F.split(F.when(swap, a).otherwise(b), "").alias("short"))
    shortest = F.least(F.length(a), F.length(b))
    usual = (F.abs(F.length(a) - F.length(b)) <= edits) & (shortest > edits)
    # a string no longer than the band is compared by the built-in distance
    return F.when(usual, common.let(both, run)).otherwise(F.levenshtein(a, b))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``."""
    return distance(a, b, edits) <= edits


def occurrences(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(_doc, id, pos, line) of each non-blank line; a row with null line for a document of none."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(" \t\n\x0b\x0c\r")).alias("line"))), lambda x: x["line"] != "")
    own = docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(id).alias("id"), lines.alias("l"))
    own = own.select("_doc", "id", F.explode_outer("l").alias("l"))
    return own.select("_doc", "id", "l.pos", "l.line")


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its size is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def classes(distinct: DataFrame, edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """(line_id, root, n_links) of those of ``distinct`` (line_id, line) that link to others:
    the least line_id of the class and the number of texts that are edit-close."""
    own = distinct.select("line_id", F.length("line").alias("n"), F.encode("line", "UTF-32").alias("chars"))
    index = keys(own, edits, chars_an_edit, False)
    probes = keys(own, edits, chars_an_edit, True).toDF("b", "t", "key")
    probes = common.stored(probes.join(index, (probes.key == index.key) & (F.col("b") != F.col("line_id")), "left_semi").select("b", "key"), "probes")
    met = common.stored(probes.select("key").distinct(), "keys")
    index = common.stored(index.join(small(met), "key", "left_semi").select(F.col("line_id").alias("a"), "t", "key"), "index")
    ids = common.stored(index.select(F.col("a").alias("line_id")).unionByName(probes.select(F.col("b").alias("line_id"))).distinct(), "ids")
    texts = common.stored(distinct.join(small(ids), "line_id", "left_semi").select("line_id", "line", *sketches(F.col("line"))), "texts")
    counts = texts.drop("line")
    a, b = counts.toDF("a", *[f"a_{c}" for c in counts.columns[1:]]), counts.toDF("b", *[f"b_{c}" for c in counts.columns[1:]])
    near = (F.col("a") != F.col("b")) & (sketch_distance("a_", "b_") <= 2 * F.col("t"))
    pairs = index.join(a, "a").join(probes.join(b, "b"), "key").where(near)
    pairs = common.stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    few = allowed(F.least(F.length("x"), F.length("y")), edits, chars_an_edit)
    x, y = texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), texts.select(F.col("line_id").alias("b"), F.col("line").alias("y"))
    links = pairs.join(x, "a").join(y, "b").where(distance(F.col("x"), F.col("y"), edits) <= few)
    links = common.stored(links.select("a", "b"), "links")
    degrees = links.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("n_links"))
    roots = common.components(links).withColumnRenamed("node", "line_id")
    return degrees.join(roots, "line_id", "left").select("line_id", F.coalesce("root", "line_id").alias("root"), "n_links")


def marked(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """(_doc, id, pos, class_id, n_links, kept, near) of each non-blank line, stored.
    ``class_id``: 128-bit hash of the class's first line, so equal for all lines of a class;
    ``n_links``: number of other texts that are edit-close to the line's; ``near``: its class
    holds more than one text. Documents without lines keep one row with null pos."""
    lines = occurrences(docs, id, text)
    h = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")]
    distinct = common.stored(lines.where("line is not null").groupBy("line").count().select(F.monotonically_increasing_id().alias("line_id"), "line", *h), "lines")
    members = distinct.select("line_id", "h1", "h2").join(classes(distinct.select("line_id", "line"), edits, chars_an_edit), "line_id")
    members = common.stored(members.select("h1", "h2", "root", "n_links"), "members")
    own = lines.select("_doc", "id", "pos", *[F.when(F.col("line").isNotNull(), x).alias(n) for x, n in zip(h, ("h1", "h2"), strict=True)])
    own = common.stored(own, "occurrences").join(members, ["h1", "h2"], "left")
    own = own.select("_doc", "id", "pos", "h1", "h2", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("c2"), F.col("root").isNotNull().alias("near"))
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("pos").alias("p"), F.col("_doc").alias("d"))
    digest = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in ("h1", "h2")])
    first = own.where("pos is not null").groupBy("c1", "c2", "near").agg(F.min(F.struct(place.alias("place"), digest.alias("class_id"))).alias("first"))
    kept = F.coalesce(F.col("first.place") == place, F.lit(False))
    return common.stored(own.join(first, ["c1", "c2", "near"], "left").select("_doc", "id", "pos", "first.class_id", "n_links", kept.alias("kept"), "near"), "marked")


def by_document(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """(id, n_lines, n_kept, n_near, lines) of every row of ``docs``: non-blank lines, those
    kept, those whose class holds more than one text, and each line's (pos, class_id,
    n_links, kept) in order of place."""
    own = marked(docs, id, text, edits, chars_an_edit)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    lines = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "class_id", "n_links", "kept")))).alias("lines")
    return own.groupBy("_doc", F.col("id").alias(id)).agg(F.count("pos").alias("n_lines"), count(F.col("kept")).alias("n_kept"), count(F.col("near") & F.col("pos").isNotNull()).alias("n_near"), lines).drop("_doc")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, chars_an_edit: int = CHARS_AN_EDIT) -> DataFrame:
    """``docs`` with the lines that are kept, blank ones left out; of rows that share an id
    each keeps the lines that any of them does."""
    key, keep = common.free(docs, "__id"), common.free(docs, "__keep")
    own = marked(docs, id, text, edits, chars_an_edit).where("kept").groupBy(F.col("id").alias(key)).agg(F.collect_set("pos").alias(keep))
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: F.array_contains(F.col(keep), i))
    joined = docs.join(own, F.col(id).eqNullSafe(F.col(key)), "left").withColumn(keep, F.coalesce(keep, F.array().cast("array<int>")))
    return joined.withColumn(text, F.array_join(lines, "\n")).select(*docs.columns)
