"""Word shingle sets of whole texts, and an exact join of them on their Jaccard similarity.

Shingles have one order for all texts, in which those that a sample finds in many texts come
last. Two sets whose similarity reaches ``least`` share a shingle among the first
size - ceil(least * size) + 1 of each (prefix filter), and at their first shared one enough
others follow in both (position filter). So every such pair meets and nothing is missed. Those
that meet are compared by bitmaps first: a bit tells whether an odd number of a set's shingles
has its hash, so two bitmaps differ in at most as many bits as the sets in shingles. Those that
may still reach ``least`` are verified on their whole sets. Equal sets count as one from the start. Pairs that
are known to be likely (of like fingerprints, say) and one star for each prefix shingle link
most texts at linear cost. While texts of different components still meet often at crowded
shingles, they are held against a few more centres there, others in each round. Then all pairs
that meet across components are verified, after the join itself has compared their bitmaps; at
crowded shingles it gives a pair once. Where many are left, one pair of each two components goes
first, as a link makes the others needless.

Rows are told apart by their place in the table's files, so no text is stored or shuffled but
those that are verified.

Defined cases: null, empty or blank texts have the empty set and equal each other; a text of
fewer words than a shingle is one shingle; repeated rows and repeated ids are rows of their own;
an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Texts of the sample that orders the shingles (the order changes the cost, not the result);
#: its shingles with so many texts at least come last; so many of them at most.
SAMPLE, COMMON_TEXTS, MOST_COMMON = 20_000, 3, 300_000
#: Rows of two numbers up to which nodes to be verified and rows to be dropped are broadcast;
#: beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Sets from which on a shingle is crowded; meetings across components for each of its rows at
#: which the rounds of centres end, centres of a shingle in a round, and the share of meetings
#: that a round must do away with.
CROWD, FEW_MEETINGS, CENTRES, GAIN = 100, 0.25, 4, 0.1
#: Pairs across components up to which all are verified at once.
FEW_PAIRS = 20_000
#: Pairs of texts that the verification takes at a time.
PAIR_ROWS = 100
#: Bits of a bitmap as powers of two: of sets up to so many shingles, and of larger ones.
SMALL_SET, SMALL_LOG, LARGE_LOG = 800, 10, 13


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its size is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles (A-Z lower-cased) in order, repeats included. No words: none."""
    # bytes.lower and bytes.split know exactly A-Z and U+0020, U+0009..U+000D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last + 1].tolist(), ends[last - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - last + 1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes for each value of their first bits."""
    log = SMALL_LOG if len(own) <= SMALL_SET else LARGE_LOG
    odd = np.bincount((own >> np.uint64(64 - log)).astype(np.int64), minlength=1 << log) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def common_shingles(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, their number of texts) of the shingles that many texts of a sample have."""
    n = docs.count()

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), shingle).view(np.int64))], ["h"])

    own = docs.select(text)
    own = own.sample(SAMPLE / n, seed=42) if n > SAMPLE else own
    counts = common.mapped(own, run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_TEXTS)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()  # 16 bytes each
    own, texts = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(own)
    return own[order], texts[order]


def prefix(own: np.ndarray, often: np.ndarray, texts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in the common order: the rare by hash, then the others by
    number of texts and hash."""
    take = len(own) - ceil(least * len(own) - 1e-9) + 1 if len(own) else 0
    if len(often) and len(own):
        at = np.minimum(often.searchsorted(own), len(often) - 1)
        known = often[at] == own
        late = own[known]
        own = np.concatenate([own[~known], late[np.lexsort((late, texts[at[known]]))]])
    return own[:take]


def keyed(docs: DataFrame, text: str, id: str, shingle: int, least: float, fingerprint) -> DataFrame:
    """A row for each of ``docs`` (as from ``placed``), stored: its place (file, at), ``row``
    (a number), id, size and digest of its set, its prefix, its bitmap and ``fingerprint(hashes)``."""
    often, texts = common_shingles(docs, text, shingle)
    file, at = common.place_of(docs)
    own = docs.select(F.col(file).alias("file"), F.col(at).alias("at"), F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    names = ["file", "at", "row", "id", "size", "digest", "prefix", "bits", "fp"]

    def run(batches):
        for batch in batches:
            sizes, digests, firsts, bits, prints = [], [], [], [], []
            for x in batch.column(4):
                hashes = shingle_hashes(x.as_py(), shingle)
                prints.append(fingerprint(hashes))
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                firsts.append(prefix(hashes, often, texts, least).view(np.int64))
                bits.append(bitmap(hashes))
            new = [pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), *[pa.array(x, pa.list_(pa.int64())) for x in (firsts, bits)], pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], names)

    kinds = (T.IntegerType(), T.BinaryType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType()), T.LongType())
    schema = T.StructType([*own.schema.fields[:4], *(T.StructField(n, k) for n, k in zip(names[4:], kinds, strict=True))])
    return common.stored(common.mapped(own, run, schema), "shingles")


def may_reach(size: Column, pos: Column, other_size: Column, other_pos: Column, least: float) -> Column:
    """Whether two sets whose first shared shingle has these 0-based places can reach ``least``."""
    need = F.ceil(F.lit(least / (1 + least)) * (size + other_size) - 1e-9)
    return F.least(size - pos, other_size - other_pos) >= need


def bitmaps_allow(least: float) -> Column:
    """Whether sets with ``a_size``, ``a_bits`` and ``b_size``, ``b_bits`` may reach ``least``;
    bitmaps of unlike length tell nothing."""
    one = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    small = sum((one(F.col("a_bits")[k], F.col("b_bits")[k]) for k in range((1 << SMALL_LOG) // 64)), F.lit(0))
    large = F.aggregate(F.zip_with("a_bits", "b_bits", one), F.lit(0), lambda n, x: n + x)
    few = F.lit((1 - least) / (1 + least)) * (F.col("a_size") + F.col("b_size")) + 1e-9
    both = F.greatest("a_size", "b_size") <= SMALL_SET
    return F.when(both, small <= few).when(F.size("a_bits") == F.size("b_bits"), large <= few).otherwise(True)


def allowed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose bitmaps allow ``least``."""
    a, b = sets.select(*[F.col(x).alias(y) for x, y in (("node", "a"), ("size", "a_size"), ("bits", "a_bits"))]), sets.select(*[F.col(x).alias(y) for x, y in (("node", "b"), ("size", "b_size"), ("bits", "b_bits"))])
    return pairs.join(a, "a").join(b, "b").where(bitmaps_allow(least)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose sets reach ``least``, stored. ``sets``: node, size
    and bits of all, and the place (file, at) of the text in ``docs``."""
    pairs = common.stored(pairs.select("a", "b"), "meeting")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = common.stored(sets.select("node", "file", "at").join(small(common.stored(ids, "ids")), "node"), "places")
    file, at = common.place_of(docs)
    own = docs.select(F.col(file).alias("file"), F.col(at).alias("at"), F.col(text).alias("text"))
    texts = common.stored(own.join(small(ids), ["file", "at"]).select("node", "text"), "texts")

    def run(batches):
        before, own = None, None
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            near = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                if (node := a[k].as_py()) != before:
                    before, own = node, shingle_set(x[k].as_py(), shingle)
                other = shingle_set(y[k].as_py(), shingle)
                both = len(np.intersect1d(own, other, assume_unique=True))
                near[k] = both >= least * (len(own) + len(other) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(near))

    both = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
    out = common.stored(common.mapped(both, run, "a long, b long", PAIR_ROWS), "near")
    common.forget(texts)
    return out


def across(keys: DataFrame, roots: DataFrame) -> tuple[DataFrame, float]:
    """(rows of ``keys`` whose key joins texts of several components, with their ``root``;
    number of pairs of rows that meet across components)."""
    rooted = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n = rooted.groupBy("key", "root").agg(F.count("*").cast("double").alias("n"))
    n = n.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("meetings")).where("meetings > 0")
    n = common.stored(n, "open")
    return common.stored(rooted.join(n.select("key"), "key", "left_semi"), "rooted"), (n.agg(F.sum("meetings")).first()[0] or 0.0) / 2


def apart(rooted: DataFrame, also: Column) -> DataFrame:
    """(a, b, ra, rb) of the rows that share a key across components and for which ``also`` holds,
    with their roots."""
    a, b = rooted.toDF(*[f"a_{c}" for c in rooted.columns]), rooted.toDF(*[f"b_{c}" for c in rooted.columns])
    meet = (F.col("a_key") == F.col("b_key")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
    return a.join(b, meet & also).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_root").alias("ra"), F.col("b_root").alias("rb"))


def firsts(cross: DataFrame) -> DataFrame:
    """One pair of ``cross`` (a, b, ra, rb) for each two components."""
    return cross.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")


def still_apart(cross: DataFrame, done: DataFrame, roots: DataFrame) -> DataFrame:
    """``cross`` (a, b, ra, rb) without the pairs of ``done``, with the components that ``roots``
    (node, root) tells; pairs within one are left out."""
    own = cross.join(done, ["a", "b"], "left_anti")
    for c in ("ra", "rb"):  # a root belongs where its component does
        own = own.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_now")), c, "left").withColumn(c, F.coalesce(f"{c}_now", c)).drop(f"{c}_now")
    return own.where("ra <> rb").select("a", "b", "ra", "rb")


def clusters(own: DataFrame, docs: DataFrame, text: str, shingle: int, least: float, likely=None) -> DataFrame:
    """(row, root) of every row of ``own`` (as from ``keyed``; it is deleted): the same root for rows that
    chains of pairs of similarity ``least`` or more connect. ``likely(sets)`` may give pairs
    (a, b) of nodes to begin with; they are verified like all others."""
    nodes = common.stored(own.groupBy("digest").agg(F.min("row").alias("node")), "nodes")
    sets = common.stored(own.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "sets")
    rows, own = own, common.stored(own.select("row", "digest"), "digests")
    common.forget(rows)
    keys = sets.select("node", "size", F.posexplode("prefix").alias("pos", "key"))
    # most keys are of one set: they go before anything but the key itself is shuffled with them;
    # the others grow with the table and are never broadcast
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    keys = common.stored(keys.join(shared.hint("merge"), "key", "left_semi"), "keys")
    every, sets = sets, common.stored(sets.drop("prefix", "digest"), "nodes")
    common.forget(every)
    meet = keys.join(keys.groupBy("key").agg(F.min(F.struct("node", "size", "pos")).alias("c")), "key")

    star = meet.where(F.col("node") != F.col("c.node")).where(may_reach(F.col("size"), F.col("pos"), F.col("c.size"), F.col("c.pos"), least))
    star = star.select(F.col("c.node").alias("a"), F.col("node").alias("b"))
    if likely is not None:
        star = star.unionByName(likely(sets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    star = common.stored(star.distinct(), "star")
    links = verified(allowed(star, sets, least), docs, sets, text, shingle, least)
    roots, tested, before = common.components(links), star, None
    crowded = common.stored(keys.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")
    hot = common.stored(keys.join(crowded, "key", "left_semi"), "hot")
    for k in range(1, 1_000):
        rooted, meetings = across(hot, roots)
        if meetings <= FEW_MEETINGS * rooted.count() or before is not None and meetings > (1 - GAIN) * before:
            break
        before = meetings
        hashed = lambda j: F.struct(F.xxhash64("node", F.lit(CENTRES * k + j)).alias("h"), *rooted.columns)
        centres = rooted.groupBy("key").agg(F.array(*[F.min(hashed(j)) for j in range(CENTRES)]).alias("cs")).select("key", F.explode("cs").alias("c"))
        met = rooted.join(centres, "key").where(F.col("root") != F.col("c.root")).where(may_reach(F.col("size"), F.col("pos"), F.col("c.size"), F.col("c.pos"), least))
        met = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        met = common.stored(met.join(tested, ["a", "b"], "left_anti"), "met")
        tested = common.stored(tested.unionByName(met), "tested")
        links = common.stored(links.unionByName(verified(allowed(met, sets, least), docs, sets, text, shingle, least)), "links")
        roots = common.components(links)

    # a pair whose first shared key is crowded is emitted at one of its crowded keys, others where they meet
    shared = rooted.groupBy("node").agg(F.collect_set("key").alias("shared"))
    rooted = common.stored(rooted.join(sets.select("node", "bits"), "node").join(shared, "node"), "crossing")
    once = F.array_min(F.array_intersect("a_shared", "b_shared")) == F.col("a_key")
    cross = apart(rooted, bitmaps_allow(least) & once)
    calm, _ = across(keys.join(crowded, "key", "left_anti"), roots)
    calm = common.stored(calm.join(sets.select("node", "bits"), "node"), "calm")
    cross = cross.unionByName(apart(calm, may_reach(F.col("a_size"), F.col("a_pos"), F.col("b_size"), F.col("b_pos"), least) & bitmaps_allow(least)))
    cross = common.stored(cross.distinct().join(tested, ["a", "b"], "left_anti"), "cross")
    before = None
    while (n := cross.count()) > FEW_PAIRS and (before is None or n <= (1 - GAIN) * before):
        before, first = n, common.stored(firsts(cross), "first")
        links = common.stored(links.unionByName(verified(first, docs, sets, text, shingle, least)), "links")
        roots, last = common.components(links), cross
        cross = common.stored(still_apart(cross, first, roots), "cross")
        common.forget(last)
    roots = common.components(links.unionByName(verified(cross, docs, sets, text, shingle, least)))
    every = own.select("row", "digest").join(nodes, "digest").join(roots, "node", "left")
    return every.select("row", F.coalesce("root", "node").alias("root"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` (as from ``placed``) without the rows at the places of ``dropped`` (file, at)."""
    place = common.place_of(docs)
    return docs.join(small(dropped.toDF(*place)), [*place], "left_anti").drop(*place)
