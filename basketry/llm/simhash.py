"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated fingerprint bits share a part, each part has its own threshold, and thresholds
are allocated by dynamic programming on candidate counts that are estimated from the
bit statistics of all fingerprints. If two fingerprints differ in at most ``radius`` bits
and the thresholds t_i obey sum(t_i + 1) = radius + 1, some part differs in at most t_i bits.
Every fingerprint indexes its own part keys and probes all keys within t_i bits; those who
meet are verified on all 64 bits. Meetings give the edges of a spanning forest only, so a
dense group of n near copies yields at most n - 1 edges for each key and never n^2 pairs.

``component_ids`` links by the fingerprints alone. ``deduplicated`` asks for the similarity of
the shingle sets: links of fingerprints are candidates there, which are verified on the sets,
and since sets of that similarity often differ in more bits than a radius can cover, an exact
join of the sets (``neardup``) finds the others.

Defined cases: null, empty or blank text has fingerprint zero, which links like any other;
repeated rows and repeated ids are rows of their own with the same component; a null id is
never the least of a component unless all of it is null; an empty table gives no rows. Columns of any names pass through.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, neardup

#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Index rows of one part key that one group holds; keys with more are dealt over blocks.
BLOCK = 20_000
#: Rows of one key that are held at once, beside those that are indexed.
MOST_HELD = 400_000
#: Cost of a shuffled row against that of a compared pair, for the allocation.
ROW_COST, PAIR_COST = 1.0, 0.01


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes. None: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text from the XXH64 of each word shingle (A-Z lower-cased)."""
    return fingerprint_of(neardup.shingle_hashes(text, shingle, seed))


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp", shingle: int = 4) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed long."""

    names = [c for c in docs.columns if c != to]
    at = names.index(text)

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*names, to])

    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(to, T.LongType())])
    return common.mapped(docs.select(*names), run, schema)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def partial(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            flat = np.append(total.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "n"])

    rows = prints.select("fp").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(64 * 64 + 1)
    for cell, n in rows:  # 4,097 cells at most
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into parts of about equal size, correlated bits together (greedy)."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    near = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, out = set(range(64)), []
    for part in range(parts):
        want = 64 // parts + (part < 64 % parts)
        own = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < want:
            own.append(max(sorted(free), key=lambda b: near[b, own].sum()))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def allocate(n: int, together: np.ndarray, radius: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part; parts with threshold -1 are never probed and left out.

    The estimate for a part is the number of pairs whose part differs in at most t bits
    when bit j differs with probability 2 f_j (1 - f_j); the dynamic programme minimises
    probe rows plus candidates over all allocations with sum(t_i + 1) = radius + 1.
    """
    share = np.diag(together) / max(n, 1)
    differs = 2 * share * (1 - share)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, min(most_parts, radius + 1) + 1):
        groups = group_bits(n, together, parts)
        options = []
        for bits in groups:
            chance = np.array([1.0])
            for b in bits:
                chance = np.convolve(chance, [1 - differs[b], differs[b]])
            within = np.cumsum(chance)
            cost, probes = [0.0], 0
            for t in range(min(radius, len(bits)) + 1):
                probes += comb(len(bits), t)
                cost.append(ROW_COST * n * probes + PAIR_COST * n * n / 2 * within[t] if probes <= 100_000 else np.inf)
            options.append(cost)
        least = {0: (0.0, [])}
        for cost in options:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (so_far, chosen) in least.items():
                for extra, c in enumerate(cost):
                    if spent + extra <= radius + 1 and so_far + c < step.get(spent + extra, (np.inf,))[0]:
                        step[spent + extra] = (so_far + c, [*chosen, extra - 1])
            least = step
        total, chosen = least.get(radius + 1, (np.inf, []))
        if chosen and (best is None or total < best[0]):
            best = total, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


def part_key(part: int, bits: list[int], fp: Column) -> Column:
    """Key of one part: its number on top of its bits."""
    mask = sum(1 << b for b in bits)
    return F.xxhash64(F.lit(part), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def _probe(part: int, bits: list[int]):
    return lambda flip: F.struct(part_key(part, bits, F.col("fp").bitwiseXOR(flip)).alias("key"), (flip == 0).alias("index"))


def forest(fps: np.ndarray, indexed: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``radius`` bits between indexed members and all
    members of one key, breadth first; every member is taken from the queue once."""
    out: list[tuple[int, int]] = []
    own, other = np.unique(fps[indexed]), np.unique(fps[~indexed])
    other = np.setdiff1d(other, own, assume_unique=True)
    while len(own):
        queue, own = [(own[0], True)], own[1:]
        while queue:
            x, is_own = queue.pop()
            near = np.bitwise_count(own ^ x) <= radius
            if near.any():
                out += [(x, y) for y in own[near]]
                queue += [(y, True) for y in own[near]]
                own = own[~near]
            if is_own and len(other):
                near = np.bitwise_count(other ^ x) <= radius
                if near.any():
                    out += [(x, y) for y in other[near]]
                    queue += [(y, False) for y in other[near]]
                    other = other[~near]
    return out


def _edges_of(radius: int, most_held: int):
    """Stream a partition that is sorted by key, indexed rows first, and emit forest edges key
    by key. Of a key with more than ``most_held`` rows so many are linked at a time: its
    indexed rows, at most about BLOCK, stay for the next, so no link is lost.
    """

    def flush(key, block, fp, index):
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        start, end = np.append(0, cut), np.append(cut, len(key))
        keep = (end - start > 1) & (np.add.reduceat(index.astype(np.int64), start) > 0)
        start, end = start[keep], end[keep]
        two = end - start == 2  # most groups are pairs: all at once
        a, b = fp[start[two]], fp[end[two] - 1]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        out = [(a[near], b[near])]
        for s, e in zip(start[~two].tolist(), end[~two].tolist(), strict=True):
            if edges := forest(fp[s:e], index[s:e], radius):
                x = np.array(edges, np.uint64)
                out.append((x[:, 0], x[:, 1]))
        a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[2] = cols[2].view(np.uint64)
            same = held and held[-1][0][-1] == cols[0][-1] and held[-1][1][-1] == cols[1][-1]
            held.append(cols)
            if same and cols[0][0] == cols[0][-1] and cols[1][0] == cols[1][-1]:  # one key fills the whole batch
                if sum(len(x[0]) for x in held) > most_held:
                    every = [np.concatenate(x) for x in zip(*held, strict=True)]
                    start = int(np.flatnonzero((every[0] != every[0][-1]) | (every[1] != every[1][-1]))[-1]) + 1 if (every[0][0], every[1][0]) != (every[0][-1], every[1][-1]) else 0
                    yield flush(*every)
                    stay = np.flatnonzero(every[3][start:]) + start
                    held = [[x[stay if len(stay) else slice(-1, None)] for x in every]]
                continue
            key, block, fp, index = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1 if (key[0], block[0]) != (key[-1], block[-1]) else 0
            if last:
                yield flush(key[:last], block[:last], fp[:last], index[:last])
            held = [[key[last:], block[last:], fp[last:], index[last:]]]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, which connect exactly those that
    chains of differences of at most ``radius`` bits connect."""
    spark = prints.sparkSession
    n, together = bit_statistics(prints)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    plan = allocate(n, together, radius)
    own = F.array(*[part_key(i, bits, F.col("fp")) for i, (bits, _) in enumerate(plan)])
    hot = prints.select(F.explode(own).alias("key")).groupBy("key").count().where(F.col("count") > BLOCK)
    hot = hot.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    probes = []
    for i, (bits, t) in enumerate(plan):
        flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
        flips = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips])
        probes.append(F.transform(flips, _probe(i, bits)))
    rows = prints.select("fp", F.explode(F.concat(*probes)).alias("p")).select("p.key", "fp", "p.index")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    home = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "fp", home.alias("home"), "index")
    rows = rows.select("key", "block", "fp", (F.col("index") & (F.col("home") == F.col("block"))).alias("index"))
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("index"))
    return rows.mapInArrow(_edges_of(radius, MOST_HELD), "a long, b long")


def roots(own: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of every fingerprint of ``own``: a fingerprint of its component."""
    prints = common.stored(own.select("fp").distinct(), "distinct")
    linked = common.components(links(prints, radius))
    return prints.join(linked, prints.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def component_ids(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the least id reachable)."""
    with common.scratch(docs.sparkSession) as keep:
        own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        own = common.stored(with_fingerprint(own, "text", "fp", shingle).select("id", "fp"), "prints")
        every = keep(common.stored(own.join(roots(own, radius), "fp"), "clusters"))
    least = every.groupBy("root").agg(F.min("id").alias("component_id"))
    fp = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return every.join(least, "root").select(F.col("id").alias(id), fp.alias("fingerprint"), "component_id")


def likely_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """(a, b) of ``sets`` (node, fp) whose fingerprints are equal or linked: each with the
    first of its fingerprint, and the firsts of linked ones."""
    first = common.stored(sets.groupBy("fp").agg(F.min("node").alias("a")), "firsts")
    same = sets.join(first, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    near = links(first.select("fp"), radius).toDF("x", "y")
    return same.unionByName(near.join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y").select("a", "b"))


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 5, radius: int = 4, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group that chains of pairs of similarity ``least`` or more
    connect: that with the least id (nulls last), and of rows that share it the first."""
    with common.scratch(docs.sparkSession) as keep:
        docs = common.placed(docs)
        if hasattr(docs, "_basketry_path"):
            keep(docs)
        own = neardup.keyed(docs, text, id, shingle, least, fingerprint_of)
        rows = common.stored(own.select("file", "at", "row", "id"), "rows")
        every = neardup.clusters(own, docs, text, shingle, least, lambda sets: likely_pairs(sets, radius))
        every = common.stored(rows.join(every, "row"), "clusters")
        order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"))
        stays = every.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.r").alias("row"))
        dropped = keep(common.stored(every.join(stays, "row", "left_anti").select("file", "at"), "dropped"))
    return neardup.without(docs, dropped)
