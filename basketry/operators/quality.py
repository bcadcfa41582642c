"""Reports on the quality of attributes and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

# fixed values: how a text begins that says nothing
GENERIC = ("Unknown", "N/A", "Not available", "No data", "Insufficient")


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, share): filled share of each field, a missing column counts as 0; ``mean`` last."""
    here = [f for f in fields if f in rows.columns]
    own = rows.agg(*[F.avg(F.when(C.is_filled(F.col(f)), 1.0).otherwise(0.0)).alias(f) for f in here], F.lit(0).alias("_"))
    pairs = [F.struct(F.lit(f).alias("field"), (F.coalesce(f, F.lit(0.0)) if f in here else F.lit(0.0)).alias("share")) for f in fields]
    mean = reduce(lambda a, b: a + b, [p["share"] for p in pairs]) / len(fields)
    return own.select(F.explode(F.array(*pairs, F.struct(F.lit("mean").alias("field"), mean.alias("share")))).alias("x")).select("x.*")


def token_budget(rows: DataFrame, text: str, budget: int = 512, per_word: float = 1.3) -> DataFrame:
    """Estimated tokens (words times ``per_word``, cut): mean, median, p95, p99, most, over."""
    words = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(F.col(text)), "\\s+")))
    n = rows.select(F.floor(words * per_word).cast("long").alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return n.agg(F.avg("n").alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("n").alias("most"), F.sum(F.when(F.col("n") > budget, 1).otherwise(0)).alias("over"), F.avg(F.when(F.col("n") > budget, 1.0).otherwise(0.0)).alias("share_over"))


def enum_distribution(rows: DataFrame, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """(column, value, n, share): counts of values, members of list columns each."""
    parts = [rows.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    parts += [rows.select(F.lit(c).alias("column"), F.explode(C.json_list(F.col(c))).alias("value")) for c in lists]
    n = reduce(DataFrame.unionByName, parts).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("column")))


def enum_summary(dist: DataFrame) -> DataFrame:
    """(column, n_unique, entropy, evenness, top_share) of an enum distribution."""
    h = -F.sum(F.col("share") * F.log2("share"))
    return dist.groupBy("column").agg(F.count("*").alias("n_unique"), h.alias("entropy"), F.when(F.count("*") > 1, h / F.log2(F.count("*"))).otherwise(0.0).alias("evenness"), F.max("share").alias("top_share"))


def completeness(rows: DataFrame, fields: list[str], generic: tuple[str, ...] = GENERIC, least_chars: int = 100) -> DataFrame:
    """(what, value): share of rows whose field is filled and not generic, for each field;
    ``overall``, their mean; ``n_generic``, rows with any generic field; ``n_short``, rows whose
    fields have under ``least_chars`` characters in all."""
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    is_generic = lambda f: reduce(lambda a, b: a | b, [F.lower(F.trim(text(f))).startswith(g.lower()) for g in generic])
    shares = [F.avg(F.when((F.trim(text(f)) != "") & ~is_generic(f), 1.0).otherwise(0.0)) for f in fields]
    chars = reduce(lambda a, b: a + b, [F.length(text(f)) for f in fields])
    any_generic = reduce(lambda a, b: a | b, [is_generic(f) for f in fields])
    own = rows.agg(*[s.alias(f) for s, f in zip(shares, fields, strict=True)], F.sum(F.when(any_generic, 1.0).otherwise(0.0)).alias("n_generic"), F.sum(F.when(chars < least_chars, 1.0).otherwise(0.0)).alias("n_short"))
    own = own.withColumn("overall", reduce(lambda a, b: a + b, [F.col(f) for f in fields]) / len(fields))
    return own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(c, F.lit(0.0)).alias("value")) for c in [*fields, "overall", "n_generic", "n_short"]])).alias("x")).select("x.*")


def unique_ratios(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, ratio): distinct values over filled rows of each field, 0 if none is filled."""
    ratio = lambda f: F.when(F.count(f) > 0, F.count_distinct(f) / F.count(f)).otherwise(0.0)
    parts = [rows.agg(F.lit(f).alias("field"), ratio(f).alias("ratio")) for f in fields]  # one row each
    return reduce(DataFrame.unionByName, parts)


def word_trigrams(rows: DataFrame, text: str) -> DataFrame:
    """``n_trigrams``: distinct triples of neighbouring words of a lower-cased text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")
    starts = F.when(F.size("_w") > 2, F.sequence(F.lit(1), F.size("_w") - 2)).otherwise(F.array().cast("array<int>"))
    own = rows.withColumn("_w", words)
    return own.withColumn("n_trigrams", F.size(F.array_distinct(F.transform(starts, lambda i: F.slice("_w", i, 3))))).drop("_w")


def discriminability(rows: DataFrame, id: str, text: str, most: int = 500, seed: int = 42) -> DataFrame:
    """Mean and median TF-IDF cosine of pairs of at most ``most`` texts (chosen by hash; the
    sample is the feature), and their mean number of distinct word trigrams."""
    sample = rows.where(F.col(text).isNotNull()).orderBy(F.xxhash64(id, F.lit(seed)), id).limit(most)
    grams = word_trigrams(sample, text).agg(F.avg("n_trigrams").alias("mean_trigrams"))
    own = sample.select(F.col(id).alias("id"), F.regexp_extract_all(F.lower(text), F.lit("(?U)\\w\\w+"), F.lit(0)).alias("w"))
    tf = own.select("id", F.explode("w").alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    n = own.agg(F.count("*").alias("docs"))
    weight = tf.join(df, "t").crossJoin(F.broadcast(n)).withColumn("x", F.col("n") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    unit = weight.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("id")))).select("id", "t", "x")
    pairs = own.select(F.col("id").alias("a")).join(own.select(F.col("id").alias("b")), F.col("a") < F.col("b"))  # of the bounded sample
    dots = unit.toDF("a", "t", "x").join(unit.toDF("b", "t", "y"), "t").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    cosine = pairs.join(dots, ["a", "b"], "left").select(F.coalesce("s", F.lit(0.0)).alias("s"))
    return cosine.agg(F.avg("s").alias("mean_cosine"), F.percentile("s", F.lit(0.5)).alias("median_cosine"), F.count("*").alias("n_pairs")).crossJoin(F.broadcast(grams))  # one row each


def verdicts(measures: DataFrame, criteria: list[tuple[str, str, float]]) -> DataFrame:
    """(name, op, threshold, value, verdict) of each criterion (name, >= or <=, threshold)
    against (name, value); one without a value passes as SKIP."""
    table = measures.sparkSession.createDataFrame(criteria, "name string, op string, threshold double")
    own = F.broadcast(table).join(measures, "name", "left")
    good = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return own.select("name", "op", "threshold", "value", F.when(F.col("value").isNull(), "SKIP").when(good, "GO").otherwise("NO-GO").alias("verdict"))


def judge_summary(scores: DataFrame, dimensions: list[str], passing: float = 3.5) -> DataFrame:
    """Means of scores held within 1 and 5, and the share of rows whose mean passes."""
    held = {d: F.least(F.greatest(F.col(d).cast("double"), F.lit(1.0)), F.lit(5.0)) for d in dimensions}
    own = scores.select(*[c.alias(d) for d, c in held.items()])
    mean = reduce(lambda a, b: a + b, [F.col(d) for d in dimensions]) / len(dimensions)
    return own.agg(*[F.avg(d).alias(d) for d in dimensions], F.avg(F.when(mean >= passing, 1.0).otherwise(0.0)).alias("pass_rate"), F.count("*").alias("n"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, what, value): measures of several reports, each (what, value), in one table."""
    own = [df.select(F.lit(name).alias("part"), F.col("what").cast("string").alias("what"), F.col("value").cast("double").alias("value")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, own)


def as_measures(row: DataFrame) -> DataFrame:
    """(what, value) of the columns of a one-row table."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")).select("x.*")
