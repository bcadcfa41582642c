"""Learned operators that Spark hosts, and the formulas of losses and graph propagation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .factors import recommended
from .ordering import running, settled


def normalized_edges(txn: DataFrame) -> DataFrame:
    """(customer_id, article_id, weight): distinct purchases weighted by one over the root of
    both degrees."""
    e = txn.select("customer_id", "article_id").distinct()
    du = e.groupBy("customer_id").agg(F.count("*").alias("du"))
    di = e.groupBy("article_id").agg(F.count("*").alias("di"))
    return e.join(du, "customer_id").join(di, "article_id").select("customer_id", "article_id", (1 / F.sqrt(F.col("du") * F.col("di"))).alias("weight"))


def propagated(edges: DataFrame, users: DataFrame, items: DataFrame, layers: int = 2) -> tuple[DataFrame, DataFrame]:
    """Mean of ``layers`` graph convolutions over (customer_id, article_id, weight) of user
    and item vectors in long form (id, pos, x)."""
    u, i = users.toDF("customer_id", "pos", "x"), items.toDF("article_id", "pos", "x")
    all_u, all_i = u, i
    for _ in range(layers):
        nu = edges.join(i, "article_id").groupBy("customer_id", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        ni = edges.join(u, "customer_id").groupBy("article_id", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        u, i = nu, ni
        all_u, all_i = all_u.unionByName(u), all_i.unionByName(i)
    mean = lambda d, k: d.groupBy(k, "pos").agg((F.sum("x") / (layers + 1)).alias("x"))
    return mean(all_u, "customer_id"), mean(all_i, "article_id")


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def pairwise_loss(positive: Column, negative: Column) -> Column:
    return F.log1p(F.exp(-F.abs(positive - negative))) + F.greatest(negative - positive, F.lit(0.0))


def l2_penalty(a: Column, b: Column, weight: float) -> Column:
    """Mean over rows of weight * (|a|^2 + |b|^2) / 2 of two vector columns; an aggregate."""
    return F.lit(weight) * F.avg(C.dot(a, a) + C.dot(b, b)) / 2


def align_loss(a: Column, b: Column) -> Column:
    """Mean squared difference of two vector columns over rows and dimensions; an aggregate."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sum(C.dot(d, d)) / F.sum(F.size(a))


def diversity_loss(a: Column, b: Column) -> Column:
    """Mean cosine of two vector columns; an aggregate."""
    return F.avg(C.dot(a, b) / ((C.norm(a) + 1e-8) * (C.norm(b) + 1e-8)))


def expert_block(rows: DataFrame, facts: str, reasons: str, fact_gate: str, reason_gate: str, to: str = "experts") -> DataFrame:
    """``rows`` with one array of both experts' outputs and their two gates behind."""
    return rows.withColumn(to, F.concat(*[F.col(c).cast("array<double>") for c in (facts, reasons)], F.array(F.col(fact_gate).cast("double"), F.col(reason_gate).cast("double"))))


def als_recommendations(txn: DataFrame, k: int = 12, rank: int = 16, seed: int = 42) -> DataFrame:
    """(customer_id, article_id, score, place) by implicit ALS, bought articles left out. Items
    are searched in blocks, most of which a user's bounds rule out."""
    from pyspark.ml.recommendation import ALS

    counts = txn.groupBy("customer_id", "article_id").agg(F.count("*").cast("float").alias("n")).select(F.col("customer_id").cast("int"), F.col("article_id").cast("int"), "n")
    model = ALS(userCol="customer_id", itemCol="article_id", ratingCol="n", implicitPrefs=True, rank=rank, maxIter=5, seed=seed, coldStartStrategy="drop").fit(counts)
    vectors = lambda t: t.select("id", F.col("features").alias("f"))
    top = recommended(counts, vectors(model.userFactors), vectors(model.itemFactors), k)
    return top.select(F.col("customer_id").cast("int"), F.col("article_id").cast("int"), F.col("score").cast("float"), "place")


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = rows.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(featuresCol="_f", predictionCol="cluster", k=k, seed=seed).fit(own).transform(own).drop("_f")


def silhouettes(rows: DataFrame, vector: str, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, silhouette) of k-means for each k, squared Euclidean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    own = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    scores = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(own).transform(own)))) for k in ks]
    own.unpersist()
    return rows.sparkSession.createDataFrame(scores, "k int, silhouette double")


def whitened(rows: DataFrame, vector: str, share: float = 0.95, least: int = 2, whiten: bool = True) -> DataFrame:
    """``rows`` with ``components``: standardised, projected to as many principal components
    as explain ``share`` of the variance, each divided by its deviation if ``whiten``."""
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = rows.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="_f", outputCol="_s", withMean=True).fit(own)
    own = scaler.transform(own)
    d = len(scaler.mean)
    ratio = np.array(PCA(k=d, inputCol="_s", outputCol="_p").fit(own).explainedVariance)
    k = min(d, max(least, int(np.searchsorted(np.cumsum(ratio), share)) + 1))
    own = PCA(k=k, inputCol="_s", outputCol="_p").fit(own).transform(own)
    live = float((np.array(scaler.std) > 0).sum())
    scale = [1 / np.sqrt(max(r * live, 1e-12)) if whiten else 1.0 for r in ratio[:k]]
    return own.withColumn("components", F.zip_with(vector_to_array("_p"), F.array(*map(F.lit, scale)), lambda x, s: x * s)).drop("_f", "_s", "_p")


def nearest_centroid(rows: DataFrame, vector: str, labels: str) -> DataFrame:
    """``rows`` with outliers (label -1) given the label of the nearest class mean."""
    flat = rows.where(F.col(labels) >= 0).select(F.col(labels).alias("_l"), F.posexplode(vector).alias("pos", "x")).groupBy("_l", "pos").agg(F.avg("x").alias("x"))
    means = flat.groupBy("_l").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("m"))
    table = means.agg(F.collect_list(F.struct("m", "_l")).alias("_all"))  # one row: a mean for each class
    distance = lambda m: F.aggregate(F.zip_with(F.col(vector), m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = F.array_min(F.transform("_all", lambda e: F.struct(distance(e["m"]).alias("d"), e["_l"].alias("l"))))["l"]
    return rows.crossJoin(F.broadcast(table)).withColumn(labels, F.when(F.col(labels) < 0, near).otherwise(F.col(labels))).drop("_all")


def topic_words(texts: DataFrame, topic: str, text: str, k: int = 10, least_documents: int = 2, words: int = 5000, stop: tuple[str, ...] = ()) -> DataFrame:
    """Class-based TF-IDF: (topic, term, score, place) of words and word pairs; smoothed idf
    over topics, scores of a topic have unit length.

    The terms are the ``words`` most frequent of two topics or more, of equals the first. A pair is
    not more frequent than its words and comes after its first word among equals, so only pairs can
    count whose first word is among as many words and whose second is as frequent as the last of
    these. Others are dropped before they are counted; the result is that of counting all.
    """
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("(?U)\\b\\w\\w+\\b"), F.lit(0)), lambda w: ~w.isin(*stop) if stop else F.lit(True))
    own = texts.select(F.col(topic).alias("topic"), tokens.alias("w"))
    single = settled(own.select("topic", F.explode("w").alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n")))

    def frequent(n: DataFrame) -> DataFrame:
        return n.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least_documents)

    often = settled(frequent(single))
    first = settled(often.orderBy(F.desc("total"), "term").limit(words))
    full, least = first.agg(F.count("*"), F.min("total")).first()
    second = often.where(F.col("total") >= least) if full == words else often
    pair = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = own.select("topic", F.explode(pair).alias("p")).select("topic", "p.a", "p.b").join(F.broadcast(first.select(F.col("term").alias("a"))), "a", "left_semi")
    if second.limit(2 * words + 1).count() <= 2 * words:  # else very many words share the least frequency, and all go on
        pairs = pairs.join(F.broadcast(second.select(F.col("term").alias("b"))), "b", "left_semi")
    pairs = pairs.groupBy("topic", "a", "b").agg(F.count("*").alias("n")).select("topic", F.concat_ws(" ", "a", "b").alias("term"), "n")
    n = settled(single.join(F.broadcast(first.select("term")), "term", "left_semi").select("topic", "term", "n").unionByName(pairs))
    df = frequent(n).orderBy(F.desc("total"), "term").limit(words)
    topics = single.select("topic").distinct().agg(F.count("*").alias("topics"))
    scored = n.join(df, "term").crossJoin(F.broadcast(topics)).withColumn("s", F.col("n") * (F.log((1 + F.col("topics")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy("topic")))
    unit = scored.withColumn("score", F.col("s") / length)
    place = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("score"), "term"))
    return unit.withColumn("place", place).where(F.col("place") <= k).select("topic", "term", "score", "place")


def boosted_scores(rows: DataFrame, features: list[str], label: str, part: str = "part", trees: int = 20) -> DataFrame:
    """``rows`` with ``model_score`` by gradient boosted trees fitted where part = train."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep").transform(rows)
    model = GBTClassifier(featuresCol="_f", labelCol=label, maxIter=trees, maxDepth=4, seed=42).fit(own.where(F.col(part) == "train"))
    return model.transform(own).withColumn("model_score", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")


@dataclass
class Boosted:
    """A fitted sequence of trees. ``rounds``: (round, auc) of each prefix on the validation part;
    ``best``: the round to stop after; ``importance``: (feature, gain) over the trees up to there."""

    trees: list
    weights: list[float]
    rounds: DataFrame
    best: int
    importance: DataFrame
    assembler: object

    def scores(self, rows: DataFrame, to: str = "model_score") -> DataFrame:
        """``rows`` with the chance of label 1 by the trees up to the best round."""
        own = _votes(self.assembler.transform(rows), self.trees[: self.best], self.weights)
        return own.withColumn(to, 1 / (1 + F.exp(-2 * F.aggregate("_votes", F.lit(0.0), lambda s, x: s + x)))).drop("_f", "_votes")


def _votes(rows: DataFrame, trees: list, weights: list[float]) -> DataFrame:
    """``rows`` with what each tree adds to the margin, in one pass."""
    for k, tree in enumerate(trees):
        rows = tree.setPredictionCol(f"_t{k}").transform(rows)
    own = rows.withColumn("_votes", F.array(*[F.col(f"_t{k}") * w for k, w in zip(range(len(trees)), weights, strict=False)]))
    return own.drop(*[f"_t{k}" for k in range(len(trees))])


def round_aucs(votes: DataFrame, label: str) -> DataFrame:
    """(round, auc) of the running sums of ``_votes``; equal margins share their place. Rows are
    counted by round and margin first; running counts are taken range by range."""
    margins = F.aggregate("_votes", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    flat = votes.select(F.col(label).alias("y"), F.posexplode(margins).alias("round", "m")).groupBy(F.col("round") + 1, F.round("m", 9)).agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg")).toDF("round", "m", "pos", "neg")
    ran = running(flat, F.col("round"), F.col("m"), amount=F.col("neg"), to="before")
    own = ran.groupBy("round").agg(F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2)).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("before").alias("first"))
    return own.select("round", ((F.col("s") - F.col("first") * F.col("p")) / (F.col("p") * F.col("n"))).alias("auc"))


def stop_round(aucs: list[float], patience: int) -> int:
    """The best round (from 1) when training stops after ``patience`` rounds without a better one."""
    best = 0
    for k, auc in enumerate(aucs):
        if auc > aucs[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def _splits(node) -> list[tuple[int, float]]:
    """(feature, gain of all rows) of the splits of a tree; as many as the model has nodes."""
    out, work = [], [node]
    while work:
        node = work.pop()
        if node.getClass().getSimpleName() == "InternalNode":
            out.append((node.split().featureIndex(), node.gain() * node.impurityStats().count()))
            work += [node.leftChild(), node.rightChild()]
    return out


def boosted(rows: DataFrame, features: list[str], label: str, part: str = "part", trees: int = 100, depth: int = 4, patience: int = 50, seed: int = 42) -> Boosted:
    """Gradient boosted trees fitted where part = train; the number that counts is chosen on the
    rows where part = held_out, all prefixes of which are scored in one pass."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = rows.sparkSession
    assembler = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep")
    own = assembler.transform(rows)
    model = GBTClassifier(featuresCol="_f", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(own.where(F.col(part) == "train"))
    grown, weights = list(model.trees), list(model.treeWeights)
    rounds = settled(round_aucs(_votes(own.where(F.col(part) == "held_out"), grown, weights).select(label, "_votes"), label))
    aucs = [r.auc for r in rounds.orderBy("round").collect()]  # a number for each tree
    best = stop_round(aucs, patience) if aucs and all(x is not None for x in aucs) else len(grown)
    gain = dict.fromkeys(features, 0.0)
    for tree in grown[:best]:
        for k, g in _splits(tree._call_java("rootNode")):
            gain[features[k]] += g
    importance = spark.createDataFrame(sorted(gain.items(), key=lambda x: (-x[1], x[0])), "feature string, gain double")
    return Boosted(grown, weights, rounds, best, importance, assembler)
