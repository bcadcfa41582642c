"""Candidate sources, their blend and re-rank features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .analysis import with_both
from .ordering import settled


def interactions(txn: DataFrame) -> DataFrame:
    """(customer_id, article_id, n)."""
    return txn.groupBy("customer_id", "article_id").agg(F.count("*").alias("n"))


def popular(txn: DataFrame, k: int) -> DataFrame:
    """The k most bought articles, of equals the lower id."""
    return txn.groupBy("article_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article_id").limit(k)


def last_days(txn: DataFrame, days: int) -> DataFrame:
    """Rows from ``days`` days before the last day on; both ends count."""
    last = txn.agg(F.max("t_dat").alias("last"))
    return txn.crossJoin(F.broadcast(last)).where(F.col("t_dat") >= F.date_sub("last", days)).drop("last")  # one row


def popular_for_all(txn: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The same k articles for every user."""
    top = popular(txn, k).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "article_id")))
    return users.select("customer_id").distinct().crossJoin(F.broadcast(top.select("article_id", "place")))  # k rows


def repurchase(txn: DataFrame, articles: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Own past articles and their siblings by product code, at 1 and 0.5 times the count.

    All siblings of a product that a customer doesn't own share one score and one last day, so
    products are ranked first and only those spread that can bring an article among the k best
    (ties kept whole), each to k articles and as many as the customer owns of it. Of a product no more
    articles are met than the customer who owns most of it may need, so a pair costs no more on a
    larger catalogue. A customer's purchases are dealt once and stored.
    """
    by_product = W.partitionBy("product_code")
    of = articles.where(F.col("product_code").isNotNull()).select("article_id", "product_code")
    of = of.withColumns({"at": F.row_number().over(by_product.orderBy("article_id")), "size": F.count("*").over(by_product)})
    own = txn.join(users.select("customer_id").distinct(), "customer_id", "left_semi")
    own = own.groupBy("customer_id", "article_id").agg(F.count("*").alias("n"), F.max("t_dat").alias("last")).join(of.drop("at"), "article_id").repartition("customer_id")
    product = W.partitionBy("customer_id", "product_code")
    own = own.withColumns({"half": 0.5 * F.max("n").over(product), "last": F.max("last").over(product), "owned": F.count("*").over(product), "first": F.row_number().over(product.orderBy("article_id")) == 1})
    size = F.when(F.col("first"), F.col("size")).otherwise(0)  # once for each product
    upto = F.sum(size).over(W.partitionBy("customer_id").orderBy(F.desc("half"), F.desc("last")))  # ties included
    own = settled(own.withColumn("before", upto - F.sum(size).over(W.partitionBy("customer_id", "half", "last"))).drop("size"))
    kept = own.where(F.col("first") & (F.col("before") < k)).select("customer_id", "product_code", "half", "last", "owned")
    most = k + (kept.agg(F.max("owned")).first()[0] or 0)
    near = settled(of.where(F.col("at") <= most).select("article_id", "product_code", "at"))
    spread = kept.join(near, "product_code").where(F.col("at") <= k + F.col("owned")).select("customer_id", "article_id", F.col("half").alias("score"), "last")
    mine = own.select("customer_id", "article_id", F.greatest(F.col("n").cast("double"), "half").alias("score"), "last")
    best = mine.unionByName(spread).repartition("customer_id").groupBy("customer_id", "article_id").agg(F.max("score").alias("score"), F.max("last").alias("last"))
    place = F.row_number().over(W.partitionBy("customer_id").orderBy(F.desc("score"), F.desc("last"), "article_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def age_popular(txn: DataFrame, customers: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """For every user the k most bought articles of the user's age group."""
    ages = customers.select("customer_id", C.decade(F.col("age")).alias("age_group"))
    n = txn.join(ages, "customer_id").groupBy("age_group", "article_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("age_group").orderBy(F.desc("n"), "article_id"))
    ranked = n.withColumn("place", place).where(F.col("place") <= k)
    return ages.join(users.select("customer_id").distinct(), "customer_id", "left_semi").join(ranked, "age_group").select("customer_id", "article_id", F.col("n").cast("double").alias("score"), "place")


def recent_popular(txn: DataFrame, users: DataFrame, days: int, k: int) -> DataFrame:
    """For every user the k most bought articles of the last days."""
    top = popular(last_days(txn, days), k)
    return users.select("customer_id").distinct().crossJoin(F.broadcast(top)).select("customer_id", "article_id", F.col("n").cast("double").alias("score"))  # k rows


def blend(sources: list[DataFrame], k: int) -> DataFrame:
    """Union of sources (customer_id, article_id, score): best score of each article, k best
    articles of each user, whose rows are dealt once. A single source stays as it is."""
    if len(sources) == 1:
        return sources[0]
    every = reduce(DataFrame.unionByName, [s.select("customer_id", "article_id", "score") for s in sources])
    best = every.repartition("customer_id").groupBy("customer_id", "article_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("customer_id").orderBy(F.desc("score"), "article_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


USER_NUMBERS = ["n_purchases", "avg_price", "price_std", "n_types", "n_colours", "days_since_first", "days_since_last", "online_ratio"]
USER_CODES = ["age_code", "club_code", "news_code"]


def rerank_features(candidates: DataFrame, users: DataFrame, items: DataFrame, txn: DataFrame, articles: DataFrame, reference: str, facts: DataFrame | None = None, taste: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Features of every candidate: score, rank and gap; all numbers and codes of user and item;
    crosses of both; the pair's and the product type's history.

    ``facts`` (article_id, ...) adds encoded attributes, of which unknown articles have 0;
    ``taste`` (customer_id, centroid) with ``vectors`` (article_id, v) adds their cosine.
    """
    by_user = W.partitionBy("customer_id").orderBy(F.desc("score"), "article_id")
    own = candidates.select("customer_id", "article_id", "score")
    own = own.withColumn("rank", (F.row_number().over(by_user) - 1).cast("long")).withColumn("gap", F.first("score").over(by_user) - F.col("score"))
    ref = F.lit(reference).cast("date")
    pairs = txn.groupBy("customer_id", "article_id").agg(F.count("*").alias("pair_n"), F.datediff(ref, F.max("t_dat")).cast("long").alias("pair_days"))
    types = articles.select("article_id", "product_type_name")
    kinds = txn.join(types, "article_id").groupBy("customer_id", "product_type_name").agg(F.count("*").alias("type_n"))
    codes = [c for c in items.columns if c.endswith("_code")]
    named = lambda df, names, prefix, key: df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in names])
    own = own.join(named(users, USER_NUMBERS + USER_CODES, "u", "customer_id"), "customer_id", "left").join(named(items, ["n_sold", "avg_price", *codes], "i", "article_id"), "article_id", "left")
    own = own.join(pairs, ["customer_id", "article_id"], "left").join(types, "article_id", "left").join(kinds, ["customer_id", "product_type_name"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    price = F.when(F.col("i_avg_price") > 0, zero("u_avg_price") / (F.col("i_avg_price") + 1e-8)).otherwise(0.0)
    out = own.select(
        "customer_id", "article_id", "score", "rank", "gap",
        *[zero(f"u_{c}").alias(f"u_{c}") for c in USER_NUMBERS + USER_CODES], *[zero(f"i_{c}").alias(f"i_{c}") for c in ["n_sold", "avg_price", *codes]],
        (zero("u_age_code") * 100 + zero("i_section_name_code")).alias("age_section"), price.alias("price_ratio"),
        (zero("u_days_since_last") * zero("i_n_sold")).alias("recency_popularity"),
        F.when(F.col("pair_n") > 0, 1).otherwise(0).cast("long").alias("has_pair"), zero("pair_n").alias("pair_n"), F.coalesce("pair_days", F.lit(999)).alias("pair_days"),
        F.when(F.col("type_n") > 0, 1).otherwise(0).cast("long").alias("has_type"), zero("type_n").alias("type_n"), price.alias("pair_price_ratio"),
    )
    if facts is not None:
        out = out.join(facts, "article_id", "left").fillna(0, [c for c in facts.columns if c != "article_id"])
    if taste is not None and vectors is not None:
        near = C.dot(F.col("centroid"), F.col("v")) / ((C.norm(F.col("centroid")) + 1e-8) * (C.norm(F.col("v")) + 1e-8))
        out = with_both(out, taste.select("customer_id", "centroid"), vectors, candidates, "left")
        out = out.withColumn("cosine", F.coalesce(near, F.lit(0.0))).drop("centroid", "v")
    return out


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """``label`` 1 if the pair is in ``truth`` (customer_id, article_id), else 0."""
    hit = truth.select("customer_id", "article_id").distinct().withColumn("hit", F.lit(1))
    return candidates.join(hit, ["customer_id", "article_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def hash_split(rows: DataFrame, column: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``part``: train for about ``share`` of the values of a column, else held_out."""
    bucket = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1000))
    return rows.withColumn("part", F.when(bucket < int(1000 * share), "train").otherwise("held_out"))


def stratified(rows: DataFrame, label: str, id: str, each: int, total: int | None = None, seed: int = 42) -> DataFrame:
    """``each`` rows of every label in hash order, then others in hash order up to ``total``."""
    order = F.xxhash64(id, F.lit(seed))
    own = rows.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy(order, id)))
    if total is None:
        return own.where(F.col("_k") <= each).drop("_k")
    return own.orderBy(F.when(F.col("_k") <= each, 0).otherwise(1), order, id).limit(total).drop("_k")


def candidate_arrays(candidates: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(user_idx, items, scores): for each of ``users`` (customer_id, user_idx) the indices of
    the k best known articles (``items``: article_id, item_idx) and their scores, zeros behind."""
    place = F.row_number().over(W.partitionBy("customer_id").orderBy(F.desc("score"), "article_id"))
    best = candidates.join(items.select("article_id", "item_idx"), "article_id").withColumn("_p", place).where(F.col("_p") <= k)
    own = best.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("_p", "item_idx", "score"))).alias("_x"))
    here = F.coalesce("_x", F.array().cast(own.schema["_x"].dataType))
    padded = lambda c, zero: F.concat(F.transform(here, lambda x: x[c]), F.array_repeat(F.lit(zero), k - F.size(here)))
    return users.join(own, "customer_id", "left").select("user_idx", padded("item_idx", 0).alias("items"), padded("score", 0.0).alias("scores"))


def sampled(rows: DataFrame, n: int, id: str, seed: int = 42) -> DataFrame:
    """n rows in hash order: the same for every run."""
    return rows.orderBy(F.xxhash64(id, F.lit(seed)), id).limit(n)


def steps(rows: int, batch: int) -> int:
    """Full batches of an epoch."""
    return rows // batch
