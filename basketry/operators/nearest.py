"""The k greatest inner products of each query, exactly, without all pairs.

Rows are packed into blocks of bounded size, those of one pivot in the order of their distance
from it, so a block holds rows that lie together. A block has a centre, a radius and a greatest norm. By
Cauchy and Schwarz no row of it has a product above q.centre + |q| radius, nor above |q| norm.
Queries of the same best block lie together in packs of bounded size. A pack first meets the best
blocks of its queries, which gives each query a k-th score; then it meets every block that some
query of it may still need, the most promising first, and a query takes part while the bound is no
less than its k-th score. Blocks travel to packs, and a task holds one pack and one block at a
time, so a search shuffles the queries twice and the blocks at most once for each pack.
Products are taken in single precision first; those that may count, with the greatest possible
error allowed for, are computed again in doubles.

Packs are as large as a task may hold, since what travels is packs times blocks; vectors that single
precision holds exactly travel in it. For Euclidean distances blocks are lifted where they are met:
the product of (q, 1) and (v, -|v|^2 / 2) is largest where the distance is least. The distance is
taken there too, so no vector travels to its pairs. Ids that a query may not have are left out there.
A query that asks for no more than whether some known ids are among its k best is done as soon as
its k-th score is above all of theirs.

Null vectors and null ids take no part; equal products are ordered by id; products are rounded to
nine digits, as sums in another order differ in the last ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import placed, scratch, settled

#: Pivots at most; bytes of all blocks' centres at most (they go to every task; blocks grow
#: where they would be more); bytes of the queries of a pack; products and bounds that are held
#: at a time; digits of a product.
PIVOTS, CENTRE_BYTES, PACK_BYTES, CELLS, DIGITS = 256, 1 << 24, 1 << 27, 1 << 20, 9


def packed(rows: DataFrame, id: str, vector: str, size: int = 1024, lift: bool = False) -> DataFrame:
    """(block, ids, m, centre, radius, norm): blocks of ``size`` rows at most, m their vectors in a
    row, in single precision if that is exact. ``lift``: the other columns are of lifted vectors."""
    with scratch(rows.sparkSession) as keep:
        own = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
        own = settled(own)
        same = F.forall("v", lambda x: x.cast("float").cast("double").eqNullSafe(x))
        n, width, exact = own.agg(F.count("*"), F.max(F.size("v")), F.min(same)).first()
        kind = "float" if exact else "double"
        types = f"block long, ids array<long>, m array<{kind}>, centre array<double>, radius double, norm double"
        if not n:
            return keep(settled(own.sparkSession.createDataFrame([], types)))
        size = max(size, -(-n * 8 * (width + 2) // CENTRE_BYTES))
        some = own.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // size))).collect()
        pivots = np.array([r.v for r in some])
        pivots = lifted(pivots) if lift else pivots

        def near(batches):
            for batch in batches:
                v = matrix(batch.column(1))
                v = lifted(v) if lift and len(v) else v
                d = np.sqrt(np.maximum((v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1), 0)) if len(v) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d.argmin(1) if len(v) else [], pa.int32()), pa.array(d.min(1) if len(v) else [], pa.float64())], ["id", "v", "cell", "far"])

        dealt = own.mapInArrow(near, "id long, v array<double>, cell int, far double") if len(some) > 1 else own.withColumns({"cell": F.lit(0), "far": F.lit(0.0)})
        dealt = placed(dealt.withColumn("v", F.col("v").cast(f"array<{kind}>")), F.col("cell"), F.col("far"), F.col("id"))
        first = dealt.groupBy("cell").agg(F.min("place").alias("first"))  # a row for each pivot
        nth = F.floor((F.col("place") - F.col("first")) / size)
        dealt = dealt.join(F.broadcast(first), "cell").withColumn("block", F.col("cell") + nth * PIVOTS)

        def pack(pdf):
            import pandas as pd

            pdf = pdf.sort_values("id")
            plain = np.stack(pdf["v"].to_numpy())
            m = plain.astype(np.float64)
            m = lifted(m) if lift else m
            centre = m.mean(0)
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["id"].to_numpy()], "m": [plain.ravel()], "centre": [centre], "radius": [float(np.sqrt(((m - centre) ** 2).sum(1)).max())], "norm": [float(np.sqrt((m * m).sum(1)).max())]})

        return keep(settled(dealt.select("block", "id", "v").groupBy("block").applyInPandas(pack, types)))


def lifted(m: np.ndarray) -> np.ndarray:
    """Rows v as (v, -|v|^2 / 2)."""
    return np.column_stack([m, -(m * m).sum(1) / 2])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Bounds:
    """Upper bounds of all blocks; small enough for every task."""

    def __init__(self, blocks: DataFrame):
        rows = blocks.select("block", "centre", "radius", "norm").collect()
        self.block = np.array([r.block for r in rows], np.int64)
        self.centre = np.array([r.centre for r in rows])
        self.radius, self.norm = np.array([r.radius for r in rows]), np.array([r.norm for r in rows])

        self.at = {int(b): k for k, b in enumerate(self.block)}

    def of(self, q: np.ndarray, at=slice(None)) -> np.ndarray:
        """For each query the bounds of the blocks ``at``, with room for rounding."""
        length = np.sqrt((q * q).sum(1))[:, None]
        bound = np.minimum(q @ self.centre[at].T + length * self.radius[at], length * self.norm[at])
        return bound + 1e-9 * (1 + np.abs(bound) + length * self.norm[at])

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the blocks, greatest bound first, and these bounds."""
        bound = self.of(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        return order, np.take_along_axis(bound, order, 1)

    def slices(self, n: int):
        """Slices of ``n`` queries whose bounds are held at a time."""
        step = max(1, CELLS // max(1, len(self.block)))
        return [slice(k, k + step) for k in range(0, n, step)]


def visits(state: DataFrame, bounds: Bounds, width: int) -> DataFrame:
    """(user, q, k, bar, block): the next ``width`` blocks of each query that may still reach its
    bar, for one that is followed by itself."""

    def run(batches):
        for batch in batches:
            for part in bounds.slices(batch.num_rows):
                some = batch.slice(part.start, part.stop - part.start)
                order, bound = bounds.order(matrix(some.column(1)))
                bar, done = some.column(3).to_numpy(), some.column(4).to_numpy()
                nth = np.arange(order.shape[1])
                row, col = np.nonzero((nth >= done[:, None]) & (nth < done[:, None] + width) & (bound >= bar[:, None]))
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(at) for c in range(4)], pa.array(bounds.block[order[row, col]], pa.int64())], ["user", "q", "k", "bar", "block"])

    return state.select("user", "q", "k", "bar", "done").mapInArrow(run, "user long, q array<double>, k int, bar double, block long")


def homes(state: DataFrame, bounds: Bounds) -> DataFrame:
    """``state`` (user, q, k, goal, skip) with ``home``: the block of greatest bound."""

    def run(batches):
        for batch in batches:
            q = matrix(batch.column(1))
            own = [bounds.of(q[part]).argmax(1) for part in bounds.slices(len(q))]
            at = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds.block[at], pa.int64())], ["user", "q", "k", "goal", "skip", "home"])

    return state.mapInArrow(run, "user long, q array<double>, k int, goal double, skip array<long>, home long")


def needed(state: DataFrame, bounds: Bounds, before: DataFrame) -> DataFrame:
    """(pack, block, bound): the blocks that some query of a pack may still need, and the greatest
    bound of these queries. ``before``: (pack, block, ...) of the home blocks, which were met, also those
    of queries that are done by now."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pack, q, k = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
            bar = kth(batch.column(4), k)
            for one in np.unique(pack):
                rows = np.flatnonzero(pack == one)
                most = np.full(len(bounds.block), -np.inf)
                for part in bounds.slices(len(rows)):
                    b = bounds.of(q[rows[part]])
                    most = np.maximum(most, np.where(b >= bar[rows[part], None], b, -np.inf).max(0))
                at = np.flatnonzero(most > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), one)), pa.array(bounds.block[at]), pa.array(most[at])], ["pack", "block", "bound"])

    each = state.select("pack", "q", "k", "ids", "scores").mapInArrow(run, "pack long, block long, bound double")
    asked = each.groupBy("pack", "block").agg(F.max("bound").alias("bound"))
    return asked.join(before, ["pack", "block"], "left_anti")


def kth(scores: pa.Array, k: np.ndarray) -> np.ndarray:
    """The k-th of each list of scores, which are in descending order; none: no bar."""
    n, flat = np.diff(scores.offsets.to_numpy()), scores.flatten().to_numpy()
    bar = np.full(len(k), -np.inf)
    full = (n >= k) & (k > 0)
    bar[full] = flat[(np.cumsum(n) - n)[full] + k[full] - 1]
    return bar


class Pack:
    """Queries of one pack with their best so far, row by row: of equal scores the lower id first."""

    def __init__(self, table: pa.Table, lift: bool = False):
        whole = table.combine_chunks()
        column = lambda c: whole.column(c).combine_chunks() if isinstance(whole.column(c), pa.ChunkedArray) else whole.column(c)
        self.pack, self.user, self.home = (column(c).to_numpy(zero_copy_only=False) for c in ("pack", "user", "home"))
        self.q, self.k = matrix(column("q")), column("k").to_numpy(zero_copy_only=False).astype(np.int64)
        self.single, self.length = self.q.astype(np.float32), np.sqrt((self.q * self.q).sum(1))
        self.visited, self.goal = column("visited").to_numpy(zero_copy_only=False).copy(), column("goal").to_numpy(zero_copy_only=False)
        ids, scores, far, skip = column("ids"), column("scores"), column("far"), column("skip")
        self.skip, self.skip_at = skip.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(skip.offsets.to_numpy())))
        most = max(1, int(self.k.max()))
        self.lift = lift
        self.ids, self.scores, self.far = np.zeros((len(self.k), most), np.int64), np.full((len(self.k), most), -np.inf), np.zeros((len(self.k), most if lift else 0))
        n = np.diff(ids.offsets.to_numpy())
        row, nth = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.ids[row, nth], self.scores[row, nth] = ids.flatten().to_numpy(), scores.flatten().to_numpy()
        if lift:
            self.far[row, nth] = far.flatten().to_numpy()

    def skips(self, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each id is among those that its query may not have; by bisection."""
        low, high = self.skip_at[row], self.skip_at[row + 1]
        end, last = high, len(self.skip) - 1
        if last < 0:
            return np.zeros(len(row), bool)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = self.skip[np.minimum(mid, last)] < ids
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return (low < end) & (self.skip[np.minimum(low, last)] == ids)

    def bar(self) -> np.ndarray:
        own = self.scores[np.arange(len(self.k)), np.maximum(self.k, 1) - 1]
        return np.where(self.k > 0, own, np.inf)

    def meet(self, ids: np.ndarray, m: np.ndarray, bounds: Bounds, at: int) -> None:
        """Take what of a block belongs to the best of each query."""
        bar = self.bar()
        rows = np.flatnonzero(bar <= self.goal)
        rows = rows[bounds.of(self.q[rows], slice(at, at + 1))[:, 0] >= bar[rows]]
        self.visited[rows] += 1
        single = np.ascontiguousarray(m.astype(np.float32).T)
        error = (m.shape[1] + 4) * 2.4e-7 * bounds.norm[at] + 1e-30
        step = max(1, CELLS // len(ids))
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            s = self.single[own] @ single
            slack = error * self.length[own] + 1e-8
            least = bar[own] - slack
            open_ = np.flatnonzero(~np.isfinite(least))
            room = self.ids.shape[1] + int((self.skip_at[own + 1] - self.skip_at[own]).max())  # what is left out may stand before
            # rounding to single precision goes down, so nothing is lost
            enough = s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
            if len(open_) or np.count_nonzero(enough) > 8 * s.shape[0] * room:
                some = open_ if len(open_) else np.arange(len(own))
                most = min(room, s.shape[1])
                least[some] = np.maximum(least[some], np.partition(s[some], s.shape[1] - most, axis=1)[:, s.shape[1] - most] - 2 * slack[some])
                enough = s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
            r, c = np.divmod(np.flatnonzero(enough), enough.shape[1])  # far faster than by rows
            fair = ~self.skips(own[r], ids[c])
            r, c = own[r[fair]], c[fair]
            far = np.sqrt(((self.q[r, :-1] - m[c, :-1]) ** 2).sum(1)) if self.lift else np.zeros(len(r))
            self._take(r, ids[c], np.round(np.einsum("ij,ij->i", self.q[r], m[c]), DIGITS), far)

    def _take(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray, far: np.ndarray) -> None:
        if not len(row):
            return
        changed = np.unique(row)
        have, nth = np.nonzero(self.scores[changed] > -np.inf)
        row = np.concatenate([changed[have], row])
        ids, scores = np.concatenate([self.ids[changed[have], nth], ids]), np.concatenate([self.scores[changed[have], nth], scores])
        far = np.concatenate([self.far[changed[have], nth], far]) if self.lift else far
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k[row]
        row, nth = row[keep], nth[keep]
        self.ids[row, nth], self.scores[row, nth] = ids[keep], scores[keep]
        if self.lift:
            self.far[row, nth] = far[order][keep]

    def batches(self):
        n = np.minimum((self.scores > -np.inf).sum(1), self.k)
        inside = np.arange(self.ids.shape[1]) < n[:, None]
        starts = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(x[inside])) for x in (self.ids, self.scores)]
        lists.append(pa.ListArray.from_arrays(starts if self.lift else pa.array(np.zeros(len(self.k) + 1), pa.int32()), pa.array(self.far[inside] if self.lift else [], pa.float64())))
        lists.append(pa.ListArray.from_arrays(pa.array(self.skip_at, pa.int32()), pa.array(self.skip, pa.int64())))
        width = pa.array(np.arange(len(self.k) + 1) * self.q.shape[1], pa.int32())
        cols = [pa.array(self.pack), pa.array(self.user), pa.ListArray.from_arrays(width, pa.array(self.q.ravel())), pa.array(self.k, pa.int32()), pa.array(self.goal), pa.array(self.home), pa.array(self.visited, pa.int32()), *lists]
        whole = pa.RecordBatch.from_arrays(cols, STATE)
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)


STATE = ["pack", "user", "q", "k", "goal", "home", "visited", "ids", "scores", "far", "skip"]
STATE_TYPES = "pack long, user long, q array<double>, k int, goal double, home long, visited int, ids array<long>, scores array<double>, far array<double>, skip array<long>"


def met(state: DataFrame, asked: DataFrame, blocks: DataFrame, bounds: Bounds, packs: int, lift: bool = False) -> DataFrame:
    """``state`` after each pack has met the blocks it asked for (pack, block, bound), those of
    greatest bound first."""
    none = lambda c: F.lit(None).cast(state.schema[c].dataType).alias(c)
    goes = asked.join(blocks.select("block", F.col("ids").alias("ids"), "m"), "block")
    goes = goes.select("pack", none("user"), none("q"), none("k"), none("goal"), F.col("block").alias("home"), none("visited"), "ids", none("scores"), none("far"), none("skip"), "m", F.lit(1).alias("kind"), (-F.col("bound")).alias("nth"))
    both = state.select(*STATE, F.lit(None).cast(blocks.schema["m"].dataType).alias("m"), F.lit(0).alias("kind"), F.lit(0.0).alias("nth")).unionByName(goes)
    both = both.repartition(packs, "pack").sortWithinPartitions("pack", "kind", "nth", "home").select(*STATE, "m", "kind")

    def run(batches):
        held, own = [], None
        for batch in batches:
            pack, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pack", "kind"))
            cuts = np.flatnonzero((np.diff(pack) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pack)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if own is not None or held and held[0].column(0)[0].as_py() != pack[a]:
                        yield from (own or Pack(pa.Table.from_batches(held), lift)).batches()
                        held, own = [], None
                    held.append(part)
                    continue
                own, held = own or Pack(pa.Table.from_batches(held), lift), []
                for r in range(part.num_rows):
                    ids = part.column("ids").slice(r, 1).flatten().to_numpy()
                    m = part.column("m").slice(r, 1).flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
                    own.meet(ids, lifted(m) if lift else m, bounds, bounds.at[part.column("home")[r].as_py()])
        if held or own is not None:
            yield from (own or Pack(pa.Table.from_batches(held), lift)).batches()

    return both.mapInArrow(run, STATE_TYPES)


def searched(queries: DataFrame, blocks: DataFrame, k: int, user: str, vector: str, own_k: str | None = None, skip: str | None = None, goal: str | None = None, lift: bool = False) -> tuple[DataFrame, DataFrame]:
    """((user, id, score, place), (user, visited, n_blocks)): the k best of each query, and how
    many blocks it took. ``own_k``: a column with each query's own k; ``skip``: one with the ids
    that it may not have. ``goal``: one with a score; a query whose k-th score is found to be above it is
    left out of the first table. ``lift``: the blocks are lifted, queries end in 1, and the first table has
    ``distance``."""
    spark = queries.sparkSession
    many = F.col(own_k) if own_k else F.lit(k)
    out = F.array_sort(F.array_compact(F.coalesce(F.col(skip).cast("array<long>"), F.array().cast("array<long>")))) if skip else F.array().cast("array<long>")
    state = queries.select(F.col(user).cast("long").alias("user"), F.col(vector).cast("array<double>").alias("q"), many.cast("int").alias("k"), F.coalesce(F.col(goal).cast("double") if goal else F.lit(None), F.lit(float("inf"))).alias("goal"), out.alias("skip")).where("user is not null and q is not null")
    bounds = Bounds(blocks)
    if not len(bounds.block):
        return spark.createDataFrame([], "user long, id long, score double, place int, distance double").select("user", "id", "score", "place", *["distance"] * lift), state.select("user", F.lit(0).alias("visited"), F.lit(0).alias("n_blocks"))
    with scratch(spark) as keep:
        state = settled(homes(state, bounds))
        n, most, skipped = state.agg(F.count("*"), F.max("k"), F.sum(F.size("skip"))).first()
        room = n * 8 * (bounds.centre.shape[1] * 2 + 3 * (most or 1) + 4) + 8 * (skipped or 0)
        packs = max(1, -(-room // PACK_BYTES), min(spark.sparkContext.defaultParallelism, n // 256))
        own = placed(state, F.col("home"), F.col("user")).withColumn("pack", F.floor(F.col("place") * packs / F.lit(max(n, 1))).cast("long"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        zero = own.withColumns({"visited": F.lit(0), "ids": none("long"), "scores": none("double"), "far": none("double")}).select(*STATE)
        first = settled(zero.select("pack", F.col("home").alias("block")).distinct().withColumn("bound", F.lit(0.0)))
        open_ = (F.size("ids") < F.col("k")) | F.coalesce(F.try_element_at("scores", F.col("k")) <= F.col("goal"), F.lit(True))
        state = settled(met(zero, first, blocks, bounds, packs, lift).where(open_))
        state = keep(settled(met(state, settled(needed(state, bounds, first)), blocks, bounds, packs, lift).where(open_)))
    zipped = F.arrays_zip("ids", "scores", "far") if lift else F.arrays_zip("ids", "scores")
    top = state.select("user", F.posexplode(zipped).alias("place", "x"))
    top = top.select("user", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"), (F.col("place") + 1).alias("place"), *[F.col("x.far").alias("distance")] * lift)
    top._settled_path = state._settled_path
    return top, state.select("user", "visited", F.lit(len(bounds.block)).alias("n_blocks"))


def nearest_of(asked: DataFrame, rows: DataFrame, id: str, vector: str, k: int, size: int = 1024) -> DataFrame:
    """(a, b, distance): the k nearest ``rows`` of each of ``asked`` by Euclidean distance, of
    equals the lower id."""
    queries = asked.select(F.col(id).cast("long").alias("id"), F.concat(F.col(vector).cast("array<double>"), F.array(F.lit(1.0))).alias("q"))
    with scratch(rows.sparkSession) as keep:
        top, _ = searched(queries, packed(rows, id, vector, size, lift=True), k, "id", "q", lift=True)
        if hasattr(top, "_settled_path"):
            keep(top)
    return top.select(F.col("user").alias("a"), F.col("id").alias("b"), F.round("distance", DIGITS).alias("distance"))


def nearest(rows: DataFrame, id: str, vector: str, k: int, size: int = 1024) -> DataFrame:
    """(a, b, distance): the k nearest other rows of each."""
    near = nearest_of(rows, rows, id, vector, k + 1, size).where("a <> b")
    nth = F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))
    return near.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
