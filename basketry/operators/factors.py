"""Matrix factorisation by pairwise ranking, trained by stochastic gradient descent on strata.

Users and items are dealt over p parts each, so purchases fall into p x p blocks. A sub-epoch takes
p blocks that share neither users nor items: part u of the users meets part (u + s) mod p of the
items, so its p tasks change different factors and need no locks. Between sub-epochs factors are
written to the checkpoint folder and change partners; p sub-epochs see every purchase once.

A step takes a purchase and an item of the same part that the user never bought. Draws depend on
the seed, the epoch and the block alone, and rows are in a fixed order, so a rerun gives the same
factors wherever its tasks run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearest
from .ordering import scratch, settled

#: Purchases of a block, about; steps whose gradients are taken together.
BLOCK, STEPS = 1 << 20, 64
PART = "part int, ids array<long>, f array<double>"


def start(ids: np.ndarray, width: int, seed: int, side: int) -> np.ndarray:
    """Small factors of each id, the same in every part and run; the last column is the bias."""
    lanes = np.arange(1, width + 1, dtype=np.uint64)
    x = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (lanes * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(seed * 2 + side)
    for shift in (30, 27, 31):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0x94D049BB133111EB)
    f = (x >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5
    f = f / width
    f[:, -1] = 0 if side else 1  # a user's last factor takes the item's bias
    return f


def step_all(u: np.ndarray, i: np.ndarray, uf: np.ndarray, vf: np.ndarray, rate: float, penalty: float, rng: np.random.Generator) -> None:
    """One pass over the purchases (u, i) of a block, in random order, in place."""
    if not len(u) or len(vf) < 2:
        return
    bought = np.unique(u * len(vf) + i)
    order = rng.permutation(len(u))
    other = rng.integers(0, len(vf), len(u))
    at = np.minimum(np.searchsorted(bought, u * len(vf) + other), len(bought) - 1)
    fair = bought[at] != u * len(vf) + other  # what was bought is no worse
    order = order[fair[order]]
    for low in range(0, len(order), STEPS):
        k = order[low : low + STEPS]
        a, b, c = uf[u[k]], vf[i[k]], vf[other[k]]
        z = 1 / (1 + np.exp(np.clip((a * (b - c)).sum(1), -50, 50)))[:, None]
        da = rate * (z * (b - c) - penalty * a)
        da[:, -1] = 0
        np.add.at(uf, u[k], da)
        np.add.at(vf, i[k], rate * (z * a - penalty * b))
        np.add.at(vf, other[k], rate * (-z * a - penalty * c))


def trained(purchases: DataFrame, user: str = "customer_id", item: str = "article_id", width: int = 16, epochs: int = 10, rate: float = 0.05, penalty: float = 0.01, seed: int = 42, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, f), (id, f)): factors of users and items; the inner product ranks. ``width``
    includes the bias. Purchases without a user or item are left out, repeats count once."""
    own = settled(purchases.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i")).where("u is not null and i is not null").distinct())
    p = parts or max(2, int(np.ceil(np.sqrt(own.count() / BLOCK))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")

    def begin(c: str, side: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                f = [start(np.array(ids, np.int64), width, seed, side).ravel() for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.list_(pa.float64()))], ["part", "ids", "f"])

        return settled(own.select(c).distinct().groupBy(part(c).alias("part")).agg(F.array_sort(F.collect_list(c)).alias("ids")).mapInArrow(run, PART))

    users, items = begin("u", 0), begin("i", 1)
    blocks = settled(own.groupBy(part("u").alias("pu"), part("i").alias("pi")).agg(F.array_sort(F.collect_list(F.struct("u", "i"))).alias("pairs")))
    for epoch in range(epochs):
        for s in range(p):
            met = users.select(F.col("part").alias("pu"), F.col("ids").alias("uid"), F.col("f").alias("uf"), F.pmod(F.col("part") + s, F.lit(p)).alias("pi"))
            # the stratum has one block for each part of the items, so no other travels, and all meet by that part
            stratum = blocks.where(F.pmod(F.col("pi") - F.col("pu"), F.lit(p)) == s).select("pi", "pairs")
            met = met.join(items.select(F.col("part").alias("pi"), F.col("ids").alias("vid"), F.col("f").alias("vf")), "pi", "full").join(stratum, "pi", "left")
            both = settled(met.select("pu", "uid", "uf", "pi", "vid", "vf", "pairs").mapInArrow(_sub_epoch(width, rate, penalty, (seed, epoch, s)), f"side int, {PART}"))
            users, items = (both.where(F.col("side") == k).drop("side") for k in (0, 1))
    flat = lambda t: t.select(F.explode(F.arrays_zip("ids", F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda k: F.slice("f", k * width + 1, width)).alias("f"))).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.f").alias("f"))
    return flat(users), flat(items)


def _sub_epoch(width: int, rate: float, penalty: float, seeds: tuple[int, int, int]):
    """Passes over the blocks of a sub-epoch; a part without a partner stays as it is."""

    def cell(batch: pa.RecordBatch, name: str, r: int):
        column = batch.column(batch.schema.get_field_index(name))
        return column.slice(r, 1).flatten() if column[r].is_valid else None

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sides = []
                for ids, f in (("uid", "uf"), ("vid", "vf")):
                    own = cell(batch, ids, r)
                    sides.append(None if own is None else (own.to_numpy(), cell(batch, f, r).to_numpy().reshape(-1, width).copy()))
                pairs = cell(batch, "pairs", r)
                if all(sides) and pairs is not None:
                    (uid, uf), (vid, vf) = sides
                    u, i = (np.searchsorted(known, pairs.field(k).to_numpy()) for k, known in ((0, uid), (1, vid)))
                    step_all(u, i, uf, vf, rate, penalty, np.random.default_rng([*seeds, batch.column(0)[r].as_py()]))
                for k, (own, at) in enumerate(zip(sides, ("pu", "pi"), strict=True)):
                    if own:
                        part = batch.column(batch.schema.get_field_index(at))[r].as_py()
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([own[0]], pa.list_(pa.int64())), pa.array([own[1].ravel()], pa.list_(pa.float64()))], ["side", "part", "ids", "f"])

    return run


def recommended(purchases: DataFrame, users: DataFrame, items: DataFrame, k: int = 12, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """(user, item, score, place): the k best items of each user among those never bought, which
    are left out where products are taken."""
    own = purchases.select(F.col(user).cast("long").alias("id"), F.col(item).cast("long").alias("item")).groupBy("id").agg(F.collect_set("item").alias("bought"))
    with scratch(purchases.sparkSession) as keep:
        top, _ = nearest.searched(users.join(own, "id"), nearest.packed(items, "id", "f"), k, "id", "f", skip="bought")
        if hasattr(top, "_settled_path"):
            keep(top)
    return top.select(F.col("user").alias(user), F.col("id").alias(item), "score", "place")


def pairwise_auc(held_out: DataFrame, purchases: DataFrame, users: DataFrame, items: DataFrame, draws: int = 5, seed: int = 42, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """(auc, n): how often a later purchase scores above an item drawn by hash that the user
    bought neither before nor then; ties count half."""
    from .ordering import placed

    late = held_out.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i")).distinct()
    known = late.unionByName(purchases.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i"))).distinct()
    every = settled(placed(items.select("id"), F.col("id"), to="k"))
    n = every.count()
    drawn = late.select("u", "i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("d"))
    drawn = drawn.withColumn("k", F.pmod(F.xxhash64("u", "i", "d", F.lit(seed)), F.lit(n))).join(every.withColumnRenamed("id", "j"), "k")
    drawn = drawn.join(known.select("u", F.col("i").alias("j")), ["u", "j"], "left_anti")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    with_f = drawn.join(users.select(F.col("id").alias("u"), F.col("f").alias("uf")), "u").join(items.select(F.col("id").alias("i"), F.col("f").alias("vf")), "i").join(items.select(F.col("id").alias("j"), F.col("f").alias("wf")), "j")
    a, b = dot(F.col("uf"), F.col("vf")), dot(F.col("uf"), F.col("wf"))
    return with_f.agg(F.avg(F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)).alias("auc"), F.count("*").alias("n"))
