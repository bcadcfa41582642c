"""Segment vectors, statistics, profiles and agreement of labellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def weight_vectors(users: DataFrame, weights: str, vocabulary: list[str], user: str = "customer_id") -> DataFrame:
    """(user, vector): weights of a map column in the order of ``vocabulary``, 0 if absent."""
    return users.select(user, F.array(*[F.coalesce(F.col(weights)[v], F.lit(0.0)) for v in vocabulary]).alias("vector"))


def frequent_keys(users: DataFrame, weights: str, k: int) -> DataFrame:
    """(key, n): the k keys of a map column that most users have, ties by key."""
    return users.select(F.explode(F.map_keys(weights)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)


def profile_vectors(profiles: DataFrame, maps: dict[str, list[str]], user: str = "customer_id") -> DataFrame:
    """(user, vector): map weights, one-hot price quintile (missing: 3), online share
    (missing: 0.5) and diversity (missing: 0)."""
    parts = [F.coalesce(F.col(m)[v], F.lit(0.0)) for m, vocabulary in maps.items() for v in vocabulary]
    quintile = F.coalesce(F.col("quintile"), F.lit(3))
    parts += [F.when(quintile == q, 1.0).otherwise(0.0) for q in range(1, 6)]
    clean = lambda c, d: F.when(F.col(c).isNull() | F.isnan(c), d).otherwise(F.col(c))
    return profiles.select(user, F.array(*parts, clean("online_ratio", 0.5), clean("diversity", 0.0)).alias("vector"))


Section = tuple[str, str, list[str] | None]


def sectioned_vectors(txn: DataFrame, facts: DataFrame, sections: list[Section], user: str = "customer_id") -> DataFrame:
    """(user, vector): sections in their order, one aggregation over a user's purchases.

    A section is (kind, column, values): the shares of a column's values (``share``) or of a JSON
    list's members (``list``), which sum to 1 or are all 0; plain counts of a list's members
    (``count``); or the mean of a scale of 1 to 5 over 5, 0.5 if missing (``mean``).
    """
    own = txn.join(facts, "article_id", "left").select(user, *[C.json_list(F.col(c)).alias(c) if kind in ("list", "count") else F.col(c) for kind, c, _ in sections])
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    sums = []
    for k, (kind, c, values) in enumerate(sections):
        if kind == "mean":
            sums.append(F.coalesce(F.avg(F.col(c).cast("double")) / 5, F.lit(0.5)).alias(f"_{k}"))
        else:
            sums.append(F.array(*[one(F.array_contains(c, v) if kind != "share" else F.col(c) == v) for v in values]).alias(f"_{k}"))
    agg = own.groupBy(user).agg(*sums)

    def section(k: int, kind: str) -> Column:
        x = F.col(f"_{k}")
        if kind == "mean":
            return F.array(x)
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        return x if kind == "count" else F.transform(x, lambda v: F.when(total > 0, v / total).otherwise(0.0))

    return agg.select(user, F.concat(*[section(k, kind) for k, (kind, _, _) in enumerate(sections)]).alias("vector"))


def attribute_vectors(txn: DataFrame, facts: DataFrame, enums: dict[str, list[str]], lists: dict[str, list[str]], means: list[str], raw: dict[str, list[str]] | None = None, user: str = "customer_id") -> DataFrame:
    """(user, vector): shares of enum and list values, then means, then plain counts of the
    list values of ``raw``; see ``sectioned_vectors``."""
    sections = [("share", c, v) for c, v in enums.items()] + [("list", c, v) for c, v in lists.items()] + [("mean", c, None) for c in means] + [("count", c, v) for c, v in (raw or {}).items()]
    return sectioned_vectors(txn, facts, sections, user)


def statistics(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Size and means of each label."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in columns])


def top_keys(rows: DataFrame, label: str, weights: str, k: int = 3) -> DataFrame:
    """(label, key, n, place): keys of a map column that most users of a label have."""
    n = rows.select(label, F.explode(F.map_keys(weights)).alias("key")).groupBy(label, "key").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(label).orderBy(F.desc("n"), "key"))
    return n.withColumn("place", place).where(F.col("place") <= k)


def discriminative_keys(rows: DataFrame, label: str, weights: str, least: float = 0.01, k: int = 3) -> DataFrame:
    """(label, key, ratio, side, place): keys whose share of weight in a label is most above
    or below their share overall; keys absent from a label have ratio 0."""
    w = rows.select(label, F.explode(weights).alias("key", "w")).groupBy(label, "key").agg(F.sum("w").alias("w"))
    share = w.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(label)))
    every = w.groupBy("key").agg(F.sum("w").alias("a"))
    total = every.agg(F.sum("a").alias("t"))
    population = every.crossJoin(F.broadcast(total)).select("key", (F.col("a") / F.col("t")).alias("p")).where(F.col("p") >= least)  # one row
    grid = share.select(label).distinct().crossJoin(F.broadcast(population))  # at most 1/least keys
    ratio = grid.join(share.select(label, "key", "share"), [label, "key"], "left").withColumn("ratio", F.coalesce("share", F.lit(0.0)) / F.col("p"))
    side = ratio.where("ratio <> 1").withColumn("side", F.when(F.col("ratio") > 1, "over").otherwise("under"))
    order = F.when(F.col("side") == "over", -F.col("ratio")).otherwise(F.col("ratio"))
    place = F.row_number().over(W.partitionBy(label, "side").orderBy(F.round(order, 9), "key"))
    return side.withColumn("place", place).where(F.col("place") <= k).select(label, "key", "ratio", "side", "place")


def effective_k(rows: DataFrame, label: str) -> DataFrame:
    """exp of the entropy of label sizes, and evenness; labels below 0 are left out."""
    n = rows.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))
    own = p.agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count("*").alias("k"))
    return own.select("k", F.exp("h").alias("effective_k"), F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(0.0).alias("evenness"))


def label_means(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, mean) of a vector column."""
    return rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("mean"))


def dimension_variance(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, variance) of a vector column, population variance."""
    return rows.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from contingency counts; rows with a label below
    0 are left out."""
    n = rows.where((F.col(a) >= 0) & (F.col(b) >= 0)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = n.agg(two("n").alias("ij"), F.sum("n").alias("total"))
    rows_a = n.groupBy("a").agg(F.sum("n").alias("n")).agg(two("n").alias("sa"))
    rows_b = n.groupBy("b").agg(F.sum("n").alias("n")).agg(two("n").alias("sb"))
    own = cells.crossJoin(F.broadcast(rows_a)).crossJoin(F.broadcast(rows_b))  # one row each
    expected = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    return own.select(F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def label_agreement(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(a, b, ari) of all pairs of label columns."""
    parts = [adjusted_rand(rows, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ari") for k, a in enumerate(labels) for b in labels[k:]]
    return reduce(DataFrame.unionByName, parts)


def transition_shares(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): contingency of two labels, each row of it summing to 1."""
    n = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("a")))


def conditional_entropy(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Entropy of b given a, in bits."""
    p = transition_shares(rows, a, b)
    total = F.sum("n").over(W.partitionBy())
    return p.select(((F.col("n") / total) * -F.log2("share")).alias("h")).agg(F.sum("h").alias("conditional_entropy"))


def excess_similarity(pairs: DataFrame, score: str, thresholds: list[float], base: float) -> DataFrame:
    """(threshold, n, mean, excess, most): pairs at or above each threshold against a base."""
    cut = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    own = pairs.select(F.col(score).alias("s"), cut).where("s >= threshold")
    return own.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.avg("s") - base, 4).alias("excess"), F.round(F.max("s") - base, 4).alias("most"))
