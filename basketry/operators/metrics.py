"""Ranking metrics over long predictions (user, item, place from 1) and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running


def per_user(predicted: DataFrame, truth: DataFrame, k: int = 12, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """Average precision, hit rate, NDCG and reciprocal rank at k of every user of ``truth``
    (distinct pairs); users without predictions get zeros."""
    actual = truth.select(user, item).distinct()
    sizes = actual.groupBy(user).agg(F.least(F.count("*"), F.lit(k)).alias("_most"))
    hits = predicted.where(F.col("place") <= k).select(user, item, "place").join(actual, [user, item])
    nth = F.row_number().over(W.partitionBy(user).orderBy("place"))
    hits = hits.withColumn("_nth", nth).groupBy(user).agg(
        F.sum(F.col("_nth") / F.col("place")).alias("_ap"),
        F.sum(1 / F.log2(F.col("place") + 1)).alias("_dcg"),
        F.min("place").alias("_first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("_most").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    own = sizes.join(hits, user, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return own.select(user, zero(F.col("_ap") / F.col("_most")).alias("ap"), F.when(F.col("_first").isNotNull(), 1.0).otherwise(0.0).alias("hr"), zero(F.col("_dcg") / ideal).alias("ndcg"), zero(1 / F.col("_first")).alias("rr"))


def evaluated(predicted: DataFrame, truth: DataFrame, k: int = 12, cohorts: DataFrame | None = None, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """Means over all users of ``truth``, by ``cohort`` if ``cohorts`` (user, cohort) is given."""
    own = per_user(predicted, truth, k, user, item)
    means = [F.round(F.avg(c), 6).alias(n) for c, n in (("ap", "map"), ("hr", "hr"), ("ndcg", "ndcg"), ("rr", "mrr"))]
    if cohorts is None:
        return own.agg(*means, F.count("*").alias("n_users"))
    return own.join(cohorts, user).groupBy("cohort").agg(*means, F.count("*").alias("n_users"))


def auc(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Rank-based area under the curve with average ranks for ties, for each group of ``by``.

    Scores are counted first, so the window runs over distinct scores only; without groups they are
    summed range by range.
    """
    by = by or []
    counts = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    if by:
        below = F.sum("n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        counts = counts.withColumn("_below", below)
    else:
        counts = running(counts, F.col(score), amount=F.col("n"), to="_below")
    won = counts.withColumn("won", F.col("p") * (F.col("_below") + F.col("n") / 2.0))
    own = won.groupBy(*by) if by else won.groupBy()
    return own.agg((F.sum("won") / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
