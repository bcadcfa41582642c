"""Queries of the retail operators over the sample tables, with their checks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analysis, attributes, candidates, features, metrics, profiles
from .sql import OTHER, TRAIN_END, Plan, text, view

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(check: str | Plan | None = None):
    """Register a query under its name; ``check`` is SQL over the retail views."""

    def add(f):
        QUERIES[f.__name__] = f
        if check:
            CHECKS[f.__name__] = text(check if callable(check) else lambda d: check, OTHER)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, integers as longs: the form in which results are compared. ``nudge``
    moves means of cents off the middle between two roundings."""
    kinds = {c: F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes}
    return df.select(*kinds.values())


def small_tasks(spark: SparkSession) -> None:
    """For queries, whose session is their own: adaptive execution joins shuffled partitions up to
    8 MB instead of 64, as a task that ranks candidates holds about thirty times what it reads."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")


class Shop:
    """The retail views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._of = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(*self._of, name)

    @property
    def vectors(self) -> DataFrame:
        spark, sf_dir = self._of
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("v"))


USER = f"""user_stats AS (SELECT t.customer_id, count(*) AS n_purchases, avg(price) AS avg_price, coalesce(stddev_samp(price), 0) AS price_std, count(DISTINCT a.product_type_name) AS n_types,
    count(DISTINCT a.colour_group_name) AS n_colours, date_diff('day', min(t_dat), DATE '{TRAIN_END}') AS days_since_first, date_diff('day', max(t_dat), DATE '{TRAIN_END}') AS days_since_last,
    avg(CASE WHEN sales_channel_id = 2 THEN 1e0 ELSE 0e0 END) AS online_ratio FROM train t JOIN articles a ON t.article_id = a.article_id GROUP BY t.customer_id)"""


@query(f"""WITH {USER} SELECT u.customer_id, n_purchases, round(avg_price + 1e-8, 4) AS avg_price, round(price_std + 1e-8, 4) AS price_std, n_types, n_colours, days_since_first, days_since_last,
    round(online_ratio + 1e-8, 4) AS online_ratio, CAST(CASE WHEN age < 18 THEN 1 WHEN age < 25 THEN 2 WHEN age < 35 THEN 3 WHEN age < 45 THEN 4 WHEN age < 55 THEN 5 WHEN age < 65 THEN 6 ELSE 0 END AS BIGINT) AS age_code,
    CAST(CASE WHEN club_member_status IS NULL THEN 0 WHEN club_member_status = 'ACTIVE' THEN 1 WHEN club_member_status = 'PRE-CREATE' THEN 2 WHEN club_member_status = 'LEFT CLUB' THEN 3 ELSE 4 END AS BIGINT) AS club_code,
    CAST(CASE WHEN fashion_news_frequency IS NULL THEN 0 WHEN fashion_news_frequency = 'NONE' THEN 1 WHEN fashion_news_frequency = 'Regularly' THEN 2 ELSE 3 END AS BIGINT) AS news_code
    FROM user_stats u LEFT JOIN customers c ON u.customer_id = c.customer_id""")
def user_features(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(features.user_features(s.train, s.articles, s.customers, TRAIN_END), 4, 1e-8)


@query("""WITH sold AS (SELECT article_id, count(*) AS n, avg(price) AS p FROM train GROUP BY article_id)
    SELECT a.article_id, coalesce(s.n, 0) AS n_sold, round(coalesce(s.p, 0) + 1e-8, 4) AS avg_price, CAST(dense_rank() OVER (ORDER BY a.product_type_name) AS BIGINT) AS product_type_name_code,
    CAST(dense_rank() OVER (ORDER BY a.section_name) AS BIGINT) AS section_name_code,
    CAST(CASE WHEN a.index_name IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY a.index_name NULLS LAST) END AS BIGINT) AS index_name_code
    FROM articles a LEFT JOIN sold s ON a.article_id = s.article_id""")
def item_features(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(features.item_features(s.train, s.articles, ["product_type_name", "section_name", "index_name"]), 4, 1e-8)


@query("SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS user_idx FROM (SELECT DISTINCT customer_id FROM train) x")
def id_maps(spark, sf_dir):
    return features.dense_ids(Shop(spark, sf_dir).train, "customer_id", "user_idx")


@query("""WITH p AS (SELECT customer_id, count(DISTINCT article_id) AS n FROM train GROUP BY customer_id)
    SELECT customer_id, n AS positives, CAST(4 * n AS BIGINT) AS negatives, CAST(0 AS BIGINT) AS clashes FROM p""")
def train_pairs(spark, sf_dir):
    """Counts of the drawn pairs of each user: four negatives for each positive, none bought."""
    s = Shop(spark, sf_dir)
    own = features.train_pairs(s.train, s.articles)
    bought = s.train.select("customer_id", "article_id").distinct().withColumn("b", F.lit(1))
    own = own.join(bought, ["customer_id", "article_id"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return own.groupBy("customer_id").agg(n(F.col("label") == 1).alias("positives"), n(F.col("label") == 0).alias("negatives"), n((F.col("label") == 0) & (F.col("b") == 1)).alias("clashes"))


@query("""WITH i AS (SELECT article_id, row_number() OVER (ORDER BY article_id) AS k FROM (SELECT DISTINCT article_id FROM articles) a),
    r AS (SELECT t.customer_id, i.k, row_number() OVER (PARTITION BY t.customer_id ORDER BY t_dat DESC, k DESC) AS back FROM train t JOIN i ON t.article_id = i.article_id)
    SELECT customer_id, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY back DESC) AS items FROM r WHERE back <= 50 GROUP BY customer_id""")
def sequences(spark, sf_dir):
    s = Shop(spark, sf_dir)
    own = features.sequences(s.train, features.dense_ids(s.articles, "article_id", "item_idx"))
    return own.select("customer_id", "n", F.array_join(F.filter("items", lambda x: x > 0), ",").alias("items"))


@query("SELECT article_id, count(*) AS n FROM train GROUP BY article_id ORDER BY n DESC, article_id LIMIT 12")
def popularity_global(spark, sf_dir):
    return candidates.popular(Shop(spark, sf_dir).train, 12)


@query("""SELECT article_id, count(*) AS n FROM train WHERE t_dat >= (SELECT max(t_dat) FROM train) - INTERVAL 7 DAY GROUP BY article_id ORDER BY n DESC, article_id LIMIT 12""")
def popularity_recent(spark, sf_dir):
    return candidates.popular(candidates.last_days(Shop(spark, sf_dir).train, 7), 12)


@query("SELECT customer_id, article_id, count(*) AS n FROM train GROUP BY customer_id, article_id")
def interaction_counts(spark, sf_dir):
    return candidates.interactions(Shop(spark, sf_dir).train)


REPURCHASE = """own AS (SELECT customer_id, article_id, count(*) AS n, max(t_dat) AS last FROM train WHERE customer_id IN (SELECT customer_id FROM val) GROUP BY 1, 2),
    spread AS (SELECT o.customer_id, s.article_id, max(o.n * CASE WHEN s.article_id = o.article_id THEN 1e0 ELSE 5e-1 END) AS score, max(o.last) AS last
        FROM own o JOIN articles a ON o.article_id = a.article_id JOIN articles s ON a.product_code = s.product_code GROUP BY 1, 2),
    repurchase AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, last DESC, article_id) AS place FROM spread) x WHERE place <= 50)"""
AGES = """ages AS (SELECT customer_id, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 20 THEN '10s' WHEN age < 30 THEN '20s' WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s' WHEN age < 60 THEN '50s' ELSE '60+' END AS age_group FROM customers),
    by_age AS (SELECT age_group, article_id, n, row_number() OVER (PARTITION BY age_group ORDER BY n DESC, article_id) AS place FROM (SELECT g.age_group, t.article_id, count(*) AS n FROM train t JOIN ages g ON t.customer_id = g.customer_id GROUP BY 1, 2) x),
    age_popular AS (SELECT g.customer_id, b.article_id, CAST(b.n AS DOUBLE) AS score, b.place FROM ages g JOIN by_age b ON g.age_group = b.age_group AND b.place <= 50 WHERE g.customer_id IN (SELECT customer_id FROM val))"""
RECENT = """top AS (SELECT article_id, count(*) AS n FROM train WHERE t_dat >= (SELECT max(t_dat) FROM train) - INTERVAL 14 DAY GROUP BY article_id ORDER BY n DESC, article_id LIMIT 50),
    recent AS (SELECT u.customer_id, t.article_id, CAST(t.n AS DOUBLE) AS score FROM (SELECT DISTINCT customer_id FROM val) u CROSS JOIN top t)"""
BLEND = f"""{REPURCHASE}, {AGES}, {RECENT}, every AS (SELECT customer_id, article_id, score FROM repurchase UNION ALL SELECT customer_id, article_id, score FROM age_popular UNION ALL SELECT customer_id, article_id, score FROM recent),
    best AS (SELECT customer_id, article_id, max(score) AS score FROM every GROUP BY 1, 2),
    blended AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS place FROM best) x WHERE place <= 100)"""


@query(f"WITH {REPURCHASE} SELECT customer_id, article_id, score, last, CAST(place AS BIGINT) AS place FROM repurchase")
def repurchase_candidates(spark, sf_dir):
    small_tasks(spark)
    s = Shop(spark, sf_dir)
    return rounded(candidates.repurchase(s.train, s.articles, s.val, 50))


@query(f"WITH {AGES} SELECT customer_id, article_id, score, CAST(place AS BIGINT) AS place FROM age_popular")
def age_candidates(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(candidates.age_popular(s.train, s.customers, s.val, 50))


@query(f"WITH {RECENT} SELECT * FROM recent")
def recency_candidates(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return candidates.recent_popular(s.train, s.val, 14, 50)


def _blend(s: Shop) -> DataFrame:
    small_tasks(s._of[0])
    return candidates.blend([candidates.repurchase(s.train, s.articles, s.val, 50), candidates.age_popular(s.train, s.customers, s.val, 50), candidates.recent_popular(s.train, s.val, 14, 50)], 100)


@query(f"WITH {BLEND} SELECT customer_id, article_id, score, CAST(place AS BIGINT) AS place FROM blended")
def blended_candidates(spark, sf_dir):
    return rounded(_blend(Shop(spark, sf_dir)))


@query(f"""WITH {BLEND}, hit AS (SELECT DISTINCT customer_id, article_id FROM val) SELECT b.customer_id, b.article_id, CAST(CASE WHEN h.article_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS label
    FROM blended b LEFT JOIN hit h ON b.customer_id = h.customer_id AND b.article_id = h.article_id""")
def candidate_labels(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(candidates.labelled(_blend(s).select("customer_id", "article_id"), s.val))


AGE_CODE = "CASE WHEN u.customer_id IS NULL THEN 0 WHEN age < 18 THEN 1 WHEN age < 25 THEN 2 WHEN age < 35 THEN 3 WHEN age < 45 THEN 4 WHEN age < 55 THEN 5 WHEN age < 65 THEN 6 ELSE 0 END"
CLUB_CODE = "CASE WHEN u.customer_id IS NULL OR club_member_status IS NULL THEN 0 WHEN club_member_status = 'ACTIVE' THEN 1 WHEN club_member_status = 'PRE-CREATE' THEN 2 WHEN club_member_status = 'LEFT CLUB' THEN 3 ELSE 4 END"
NEWS_CODE = "CASE WHEN u.customer_id IS NULL OR fashion_news_frequency IS NULL THEN 0 WHEN fashion_news_frequency = 'NONE' THEN 1 WHEN fashion_news_frequency = 'Regularly' THEN 2 ELSE 3 END"
ITEM_COLUMNS = ["product_type_name", "colour_group_name", "garment_group_name", "section_name", "index_name"]
FACT_SQL = """facts AS (SELECT a.article_id, (SELECT count(*) FROM (SELECT DISTINCT coalesce(l1_material, 'UNKNOWN') AS v FROM fk UNION SELECT 'UNKNOWN') x WHERE v < coalesce(f.l1_material, 'UNKNOWN')) AS l1_material_code,
    (SELECT count(*) FROM (SELECT DISTINCT l2_trendiness AS v FROM fk UNION SELECT 'UNKNOWN') x WHERE v < coalesce(f.l2_trendiness, 'UNKNOWN')) AS l2_trendiness_code, CAST(coalesce(f.l2_perceived_quality, 0) AS DOUBLE) AS l2_perceived_quality,
    CAST(coalesce(f.l3_visual_weight, 0) AS DOUBLE) AS l3_visual_weight, CASE WHEN f.l2_style_mood IS NULL THEN 0 ELSE 1 + length(f.l2_style_mood) - length(replace(f.l2_style_mood, ',', '')) END AS l2_style_mood_n,
    CASE WHEN f.l2_style_mood LIKE '%"Casual"%' THEN 1 ELSE 0 END AS "l2_style_mood_Casual", CASE WHEN f.l2_style_mood LIKE '%"Classic"%' THEN 1 ELSE 0 END AS "l2_style_mood_Classic", CASE WHEN f.l2_style_mood LIKE '%"Sporty"%' THEN 1 ELSE 0 END AS "l2_style_mood_Sporty"
    FROM articles a LEFT JOIN fk f ON a.article_id = f.article_id)"""
FACT_COLUMNS = ["l1_material_code", "l2_trendiness_code", "l2_perceived_quality", "l3_visual_weight", "l2_style_mood_n", "l2_style_mood_Casual", "l2_style_mood_Classic", "l2_style_mood_Sporty"]


def _facts(s: Shop) -> DataFrame:
    enums, lists = ["l1_material", "l2_trendiness"], ["l2_style_mood"]
    return attributes.encoded_facts(s.articles, s.fk, attributes.encoders(s.fk, enums, lists), enums, ["l2_perceived_quality", "l3_visual_weight"], lists, lists)


@query(f"WITH {FACT_SQL} SELECT * FROM facts")
def encoded_attributes(spark, sf_dir):
    return rounded(_facts(Shop(spark, sf_dir)))


@query(f"""WITH {BLEND}, {USER}, {FACT_SQL}, sold AS (SELECT article_id, count(*) AS n, avg(price) AS p FROM train GROUP BY article_id),
    pairs AS (SELECT customer_id, article_id, count(*) AS n, date_diff('day', max(t_dat), DATE '{TRAIN_END}') AS days FROM train GROUP BY 1, 2),
    kinds AS (SELECT t.customer_id, a.product_type_name, count(*) AS n FROM train t JOIN articles a ON t.article_id = a.article_id GROUP BY 1, 2),
    codes AS (SELECT article_id, product_type_name, {", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY {c} NULLS LAST) END AS {c}_code" for c in ITEM_COLUMNS)} FROM articles),
    x AS (SELECT b.customer_id, b.article_id, b.score, b.place, {", ".join(f"coalesce(u.{c}, 0) AS u_{c}" for c in ("n_purchases", "avg_price", "price_std", "n_types", "n_colours", "days_since_first", "days_since_last", "online_ratio"))},
        {AGE_CODE} AS u_age_code, {CLUB_CODE} AS u_club_code, {NEWS_CODE} AS u_news_code, coalesce(s.n, 0) AS i_n_sold, coalesce(s.p, 0) AS i_avg_price, {", ".join(f"c.{c}_code AS i_{c}_code" for c in ITEM_COLUMNS)},
        p.n AS pn, p.days AS pdays, k.n AS kn, {", ".join(f'f."{c}"' for c in FACT_COLUMNS)}
        FROM blended b LEFT JOIN user_stats u ON b.customer_id = u.customer_id LEFT JOIN sold s ON b.article_id = s.article_id LEFT JOIN customers cu ON b.customer_id = cu.customer_id
        LEFT JOIN codes c ON b.article_id = c.article_id LEFT JOIN pairs p ON b.customer_id = p.customer_id AND b.article_id = p.article_id
        LEFT JOIN kinds k ON b.customer_id = k.customer_id AND c.product_type_name = k.product_type_name LEFT JOIN facts f ON b.article_id = f.article_id)
    SELECT customer_id, article_id, round(score, 4) AS score, CAST(place - 1 AS BIGINT) AS rank, round(max(score) OVER (PARTITION BY customer_id) - score, 4) AS gap,
    u_n_purchases, round(u_avg_price + 1e-8, 4) AS u_avg_price, round(u_price_std + 1e-8, 4) AS u_price_std, u_n_types, u_n_colours, u_days_since_first, u_days_since_last, round(u_online_ratio + 1e-8, 4) AS u_online_ratio,
    CAST(u_age_code AS BIGINT) AS u_age_code, CAST(u_club_code AS BIGINT) AS u_club_code, CAST(u_news_code AS BIGINT) AS u_news_code, i_n_sold, round(i_avg_price + 1e-8, 4) AS i_avg_price, {", ".join(f"CAST(i_{c}_code AS BIGINT) AS i_{c}_code" for c in ITEM_COLUMNS)},
    CAST(u_age_code * 100 + i_section_name_code AS BIGINT) AS age_section, round(CASE WHEN i_avg_price > 0 THEN u_avg_price / (i_avg_price + 1e-8) ELSE 0 END + 1e-8, 4) AS price_ratio, CAST(u_days_since_last * i_n_sold AS BIGINT) AS recency_popularity,
    CASE WHEN pn > 0 THEN 1 ELSE 0 END AS has_pair, coalesce(pn, 0) AS pair_n, CAST(coalesce(pdays, 999) AS BIGINT) AS pair_days, CASE WHEN kn > 0 THEN 1 ELSE 0 END AS has_type, coalesce(kn, 0) AS type_n,
    round(CASE WHEN i_avg_price > 0 THEN u_avg_price / (i_avg_price + 1e-8) ELSE 0 END + 1e-8, 4) AS pair_price_ratio, {", ".join(f'round("{c}" + 1e-8, 4) AS "{c}"' if c in ("l2_perceived_quality", "l3_visual_weight") else f'"{c}"' for c in FACT_COLUMNS)} FROM x""")
def rerank_features(spark, sf_dir):
    s = Shop(spark, sf_dir)
    users = features.user_features(s.train, s.articles, s.customers, TRAIN_END)
    items = features.item_features(s.train, s.articles, ITEM_COLUMNS)
    own = candidates.rerank_features(_blend(s), users, items, s.train, s.articles, TRAIN_END, _facts(s))
    kept = [c for c in ("score", "gap") if c in own.columns]
    return rounded(own.withColumns({c: F.col(c) - 1e-8 for c in kept}), 4, 1e-8)


@query(f"""WITH {RECENT}, h AS (SELECT t.customer_id, e.embedding AS v FROM train t JOIN embeddings e ON t.article_id = e.vec_id), f AS (SELECT customer_id, unnest(v) AS x, unnest(range(64)) AS i FROM h),
    c AS (SELECT customer_id, i, sum(CAST(x AS DOUBLE)) AS x FROM f GROUP BY 1, 2), n AS (SELECT customer_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1), g AS (SELECT vec_id, unnest(embedding) AS y, unnest(range(64)) AS i FROM embeddings),
    d AS (SELECT r.customer_id, r.article_id, sum(c.x * g.y) AS xy, sqrt(sum(CAST(g.y AS DOUBLE) * g.y)) AS yy, max(n.n) AS xx FROM recent r JOIN c ON r.customer_id = c.customer_id JOIN g ON g.vec_id = r.article_id AND g.i = c.i JOIN n ON n.customer_id = r.customer_id GROUP BY 1, 2)
    SELECT r.customer_id, r.article_id, round(coalesce(xy / (xx * yy), 0), 4) + 0e0 AS cosine FROM recent r LEFT JOIN d ON r.customer_id = d.customer_id AND r.article_id = d.article_id""")
def rerank_cosine(spark, sf_dir):
    """Cosine of each recent candidate with its user's taste."""
    s = Shop(spark, sf_dir)
    users = features.user_features(s.train, s.articles, s.customers, TRAIN_END)
    items = features.item_features(s.train, s.articles, ["section_name"])
    own = candidates.rerank_features(candidates.recent_popular(s.train, s.val, 14, 50), users, items, s.train, s.articles, TRAIN_END, taste=analysis.centroids(s.train, s.vectors), vectors=s.vectors)
    return own.select("customer_id", "article_id", (F.round("cosine", 4) + 0.0).alias("cosine"))


POPULAR = "pred AS (SELECT article_id, row_number() OVER (ORDER BY n DESC, article_id) AS place FROM (SELECT article_id, count(*) AS n FROM train GROUP BY article_id) x)"
SCORES = f"""{POPULAR}, gt AS (SELECT DISTINCT customer_id, article_id FROM val), sz AS (SELECT customer_id, least(count(*), 12) AS most FROM gt GROUP BY customer_id),
    h AS (SELECT g.customer_id, p.place, row_number() OVER (PARTITION BY g.customer_id ORDER BY p.place) AS nth FROM gt g JOIN pred p ON g.article_id = p.article_id AND p.place <= 12),
    s AS (SELECT customer_id, sum(nth * 1e0 / place) AS ap, sum(1e0 / log2(place + 1)) AS dcg, min(place) AS f FROM h GROUP BY customer_id),
    ideal AS (SELECT n.k AS most, sum(1e0 / log2(i.k + 1)) AS v FROM range(1, 13) n(k) JOIN range(1, 13) i(k) ON i.k <= n.k GROUP BY n.k),
    each AS (SELECT sz.customer_id, coalesce(s.ap / sz.most, 0) AS ap, CASE WHEN s.f IS NULL THEN 0e0 ELSE 1e0 END AS hr, coalesce(s.dcg / i.v, 0) AS ndcg, coalesce(1e0 / s.f, 0) AS rr FROM sz LEFT JOIN s ON sz.customer_id = s.customer_id JOIN ideal i ON i.most = sz.most)"""
MEANS = "round(avg(ap), 6) AS map, round(avg(hr), 6) AS hr, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, count(*) AS n_users"


@query(f"WITH {SCORES} SELECT {MEANS} FROM each")
def popularity_metrics(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return metrics.evaluated(candidates.popular_for_all(s.train, s.val, 12), s.val)


@query(f"""WITH {SCORES}, c AS (SELECT customer_id, CASE WHEN count(*) >= 5 THEN 'active' ELSE 'sparse' END AS cohort FROM train GROUP BY customer_id) SELECT cohort, {MEANS} FROM each JOIN c ON each.customer_id = c.customer_id GROUP BY cohort""")
def cohort_metrics(spark, sf_dir):
    s = Shop(spark, sf_dir)
    cohorts = s.train.groupBy("customer_id").agg(F.when(F.count("*") >= 5, "active").otherwise("sparse").alias("cohort"))
    return metrics.evaluated(candidates.popular_for_all(s.train, s.val, 12), s.val, cohorts=cohorts)


@query(f"""WITH {BLEND}, hit AS (SELECT DISTINCT customer_id, article_id FROM val), l AS (SELECT b.score, CASE WHEN h.article_id IS NULL THEN 0 ELSE 1 END AS y FROM blended b LEFT JOIN hit h ON b.customer_id = h.customer_id AND b.article_id = h.article_id),
    r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM l)
    SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)), 6) AS auc, CAST(sum(y) AS BIGINT) AS n_positive, CAST(sum(1 - y) AS BIGINT) AS n_negative FROM r""")
def candidate_auc(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(metrics.auc(candidates.labelled(_blend(s), s.val)))


DECAY = "wt AS (SELECT t.*, exp(-ln(2) * date_diff('day', t_dat, (SELECT max(t_dat) FROM train)) / 90e0) AS w FROM train t)"
TYPES = f"{DECAY}, ty AS (SELECT w.customer_id, a.product_type_name AS value, sum(w.w) AS w FROM wt w JOIN articles a ON w.article_id = a.article_id GROUP BY 1, 2), dist AS (SELECT customer_id, value, w / sum(w) OVER (PARTITION BY customer_id) AS p FROM ty)"


def _types(s: Shop) -> DataFrame:
    return profiles.distributions(profiles.weighted(s.train).join(s.articles, "article_id"), "product_type_name")


@query(f"""WITH {DECAY} SELECT w.customer_id, count(*) AS n_purchases, count(DISTINCT w.article_id) AS n_articles, count(DISTINCT a.product_type_name) AS n_types, round(sum(price * w) / nullif(sum(w), 0), 4) AS avg_price,
    round(avg(CASE WHEN sales_channel_id = 2 THEN 1e0 ELSE 0e0 END), 4) AS online_ratio FROM wt w LEFT JOIN articles a ON w.article_id = a.article_id GROUP BY w.customer_id""")
def decayed_profiles(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(profiles.base_profiles(s.train, s.articles), 4)


@query(f"WITH {TYPES}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(p, 9) DESC, value) AS place FROM dist) SELECT customer_id, value, round(p, 6) AS p, CAST(place AS BIGINT) AS place FROM r WHERE place <= 10")
def top_categories(spark, sf_dir):
    return rounded(profiles.top_shares(_types(Shop(spark, sf_dir))))


@query(f"WITH {TYPES} SELECT customer_id, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS diversity FROM dist GROUP BY customer_id")
def category_diversity(spark, sf_dir):
    return rounded(profiles.diversity(_types(Shop(spark, sf_dir))))


@query(f"""WITH {DECAY}, p AS (SELECT customer_id, sum(price * w) / nullif(sum(w), 0) AS a FROM wt GROUP BY customer_id), r AS (SELECT customer_id, row_number() OVER (ORDER BY a, customer_id) AS k, count(*) OVER () AS n FROM p)
    SELECT customer_id, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil(5 * (k - 1) / CAST(n - 1 AS DOUBLE))) END AS BIGINT) AS quintile FROM r""")
def price_quintiles(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return profiles.price_quintiles(profiles.base_profiles(s.train, s.articles))


@query("""SELECT t_dat, customer_id, article_id, price, CAST(sales_channel_id AS BIGINT) AS sales_channel_id, place FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id, price, sales_channel_id) AS place FROM train) x WHERE place <= 20""")
def recent_items(spark, sf_dir):
    return rounded(profiles.recent_items(Shop(spark, sf_dir).train))


@query("""WITH x AS (SELECT t.customer_id, f.super_category AS scope, f.l3_color_harmony AS value FROM train t JOIN fk f ON t.article_id = f.article_id UNION ALL SELECT t.customer_id, 'shared', f.l3_color_harmony FROM train t JOIN fk f ON t.article_id = f.article_id),
    n AS (SELECT customer_id, scope, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT customer_id, scope, 'l3_color_harmony' AS attribute, value, round(n * 1e0 / sum(n) OVER (PARTITION BY customer_id, scope), 6) AS p FROM n""")
def style_profiles(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(profiles.style_profiles(s.train, s.fk, ["l3_color_harmony"]))


@query("SELECT t.customer_id, round(avg(l3_visual_weight), 6) AS mean_weight, round(stddev_pop(l3_visual_weight), 6) AS sd_weight FROM train t JOIN fk f ON t.article_id = f.article_id GROUP BY t.customer_id")
def visual_weights(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(profiles.visual_weight(s.train, s.fk))


@query("""WITH v AS (SELECT t.customer_id, e.value, count(*) AS n FROM train t JOIN fk f ON t.article_id = f.article_id, UNNEST(CAST(json(f.l2_style_mood) AS VARCHAR[])) AS e(value) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, value) AS k FROM v), s AS (SELECT customer_id, string_agg(value, ', ' ORDER BY k) AS text FROM r WHERE k <= 3 GROUP BY customer_id)
    SELECT c.customer_id, coalesce(s.text, 'Insufficient data') AS text FROM customers c LEFT JOIN s ON c.customer_id = s.customer_id""")
def sparse_profiles(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return profiles.sparse_profiles(s.customers, s.train, s.fk, "l2_style_mood")


MI = """cells AS (SELECT coalesce(f.l1_material, '_NONE_') AS a, CAST(t.sales_channel_id AS VARCHAR) AS b, count(*) AS n FROM train t JOIN fk f ON t.article_id = f.article_id GROUP BY 1, 2),
    m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total, a, b FROM cells)"""


@query(f"""WITH {MI}, r AS (SELECT sum(n * 1e0 / total * log2(n * CAST(total AS DOUBLE) / (CAST(na AS DOUBLE) * nb))) AS mi, -sum(n * 1e0 / total * log2(na * 1e0 / total)) AS h, max(total) AS n FROM m)
    SELECT round(mi, 6) AS mi, round(h, 6) AS entropy, CAST(n AS BIGINT) AS n, round(CASE WHEN h > 0 THEN mi / h ELSE 0 END, 6) AS nmi FROM r""")
def mutual_information(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.mutual_information(s.train.join(s.fk, "article_id"), "l1_material", "sales_channel_id"))


@query("""WITH cells AS (SELECT f.l1_material AS a, f.l2_trendiness AS b, count(*) AS n FROM train t JOIN fk f ON t.article_id = f.article_id WHERE f.l1_material IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT a, b, n, log2(n * CAST(sum(n) OVER () AS DOUBLE) / (CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * sum(n) OVER (PARTITION BY b))) AS pmi FROM cells)
    SELECT a, b, n, round(pmi, 6) AS pmi FROM m ORDER BY abs(pmi) DESC, a, b LIMIT 20""")
def pointwise_information(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.pointwise_information(s.train.join(s.fk, "article_id"), "l1_material", "l2_trendiness"))


MOODS = "(SELECT t.sales_channel_id, f.l1_material, f.l2_trendiness, f.super_category, list_sort(CAST(json(f.l2_style_mood) AS VARCHAR[])) AS moods FROM train t JOIN fk f ON t.article_id = f.article_id)"


@query(f"""WITH c0 AS (SELECT sales_channel_id, unnest(CASE WHEN moods IS NULL OR len(moods) = 0 THEN ['_NONE_'] ELSE moods END) AS a FROM {MOODS} x), cells AS (SELECT a, CAST(sales_channel_id AS VARCHAR) AS b, count(*) AS n FROM c0 GROUP BY 1, 2),
    m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total, a, b FROM cells), r AS (SELECT sum(n * 1e0 / total * log2(n * CAST(total AS DOUBLE) / (CAST(na AS DOUBLE) * nb))) AS mi, -sum(n * 1e0 / total * log2(na * 1e0 / total)) AS h, max(total) AS n FROM m)
    SELECT round(mi, 6) AS mi, round(h, 6) AS entropy, CAST(n AS BIGINT) AS n, round(CASE WHEN h > 0 THEN mi / h ELSE 0 END, 6) AS nmi FROM r""")
def multi_value_information(spark, sf_dir):
    """Mutual information of list members and the channel: a purchase counts once for each."""
    s = Shop(spark, sf_dir)
    return rounded(analysis.mutual_information(analysis.exploded(s.train.join(s.fk, "article_id"), ["l2_style_mood"]), "l2_style_mood", "sales_channel_id"))


@query(f"""WITH k AS (SELECT coalesce(l1_material, '_NONE_') AS a, CAST(sales_channel_id AS VARCHAR) AS b, CAST('0x' || substr(md5(concat_ws('||', coalesce(l2_trendiness, '_NONE_'), coalesce(super_category, '_NONE_'), coalesce(array_to_string(moods, '|'), '_NONE_'))), 1, 15) AS BIGINT) % 10 AS bin FROM {MOODS} x),
    cells AS (SELECT bin, a, b, count(*) AS n FROM k GROUP BY 1, 2, 3), m AS (SELECT bin, n, sum(n) OVER (PARTITION BY bin, a) AS na, sum(n) OVER (PARTITION BY bin, b) AS nb, sum(n) OVER (PARTITION BY bin) AS total FROM cells),
    r AS (SELECT bin, sum(n * 1e0 / total * log2(n * CAST(total AS DOUBLE) / (CAST(na AS DOUBLE) * nb))) AS mi, max(total) AS n FROM m GROUP BY bin HAVING max(total) >= 100)
    SELECT round(sum(mi * n) / sum(n), 6) AS conditional_mi, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_bins FROM r""")
def conditional_information(spark, sf_dir):
    """Information of material and channel within bins of three attributes, one of them a list."""
    s = Shop(spark, sf_dir)
    own = analysis.joined_values(s.train.join(s.fk, "article_id"), ["l2_style_mood"]).withColumn("l2_style_mood", F.when(F.col("l2_style_mood") != "", F.col("l2_style_mood")))
    return rounded(analysis.conditional_information(own, "l1_material", "sales_channel_id", ["l2_trendiness", "super_category", "l2_style_mood"]))


@query(f"WITH {TYPES}, e AS (SELECT customer_id, -sum(p * log2(p)) AS h FROM dist GROUP BY customer_id) SELECT round(avg(h), 6) AS mean_entropy, round(stddev_pop(h), 6) AS sd_entropy, count(*) AS n_users FROM e")
def entropy_summary(spark, sf_dir):
    return rounded(analysis.entropy_summary(_types(Shop(spark, sf_dir))))


JS = f"""{TYPES}, pr AS (SELECT customer_id AS a, customer_id + 1 AS b FROM (SELECT DISTINCT customer_id FROM dist) x WHERE customer_id + 1 IN (SELECT customer_id FROM dist)),
    al AS (SELECT pr.a, pr.b, d.value, d.p, 0e0 AS q FROM pr JOIN dist d ON d.customer_id = pr.a UNION ALL SELECT pr.a, pr.b, d.value, 0e0, d.p FROM pr JOIN dist d ON d.customer_id = pr.b),
    g AS (SELECT a, b, value, sum(p) AS p, sum(q) AS q FROM al GROUP BY 1, 2, 3),
    js AS (SELECT a, b, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 AS j FROM g GROUP BY 1, 2)"""


@query(f"WITH {JS} SELECT round(avg(sqrt(greatest(j, 0))), 6) AS mean_distance, count(*) AS n FROM js")
def js_distance(spark, sf_dir):
    """Mean distance of neighbours by id, a stand-in for drawn pairs that SQL can repeat."""
    dist = _types(Shop(spark, sf_dir))
    users = dist.select("customer_id").distinct()
    pairs = users.select(F.col("customer_id").alias("a"), (F.col("customer_id") + 1).alias("b")).join(users.withColumnRenamed("customer_id", "b"), "b", "left_semi").select("a", "b")
    return analysis.js_distance(dist, pairs).agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.count("*").alias("n"))


@query(f"""WITH {JS.replace(JS[JS.index("pr AS ("):JS.index("al AS (")], "hu AS (SELECT DISTINCT customer_id, CAST('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM dist), pr AS (SELECT * FROM (SELECT customer_id AS a, lead(customer_id) OVER (PARTITION BY h % 64 ORDER BY h, customer_id) AS b FROM hu) x WHERE b IS NOT NULL), ")}
    SELECT round(avg(sqrt(greatest(j, 0))), 6) AS mean_distance, count(*) AS n FROM js""")
def sampled_js_distance(spark, sf_dir):
    dist = _types(Shop(spark, sf_dir))
    pairs = analysis.user_pairs(dist.select("customer_id").distinct())
    return analysis.js_distance(dist, pairs).agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT t.customer_id, a.product_type_name AS v, date_diff('day', DATE '1970-01-01', t_dat) AS d FROM train t JOIN articles a ON t.article_id = a.article_id),
    m AS (SELECT customer_id, quantile_cont(d, 0.5) AS mid FROM r GROUP BY customer_id),
    n AS (SELECT r.customer_id, v, sum(CASE WHEN d > mid THEN 0e0 ELSE 1e0 END) AS x, sum(CASE WHEN d > mid THEN 1e0 ELSE 0e0 END) AS y FROM r JOIN m ON r.customer_id = m.customer_id GROUP BY 1, 2)
    SELECT customer_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine FROM n GROUP BY customer_id HAVING sum(x * x) > 0 AND sum(y * y) > 0""")
def half_stability(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.half_stability(s.train.join(s.articles, "article_id"), "product_type_name"))


SOLD = "s AS (SELECT article_id, count(*) AS c FROM txn GROUP BY article_id)"
BOUGHT = "u AS (SELECT customer_id, count(*) AS n, avg(price) AS p FROM txn GROUP BY customer_id)"


def _sold(s: Shop) -> DataFrame:
    return s.txn.groupBy("article_id").agg(F.count("*").alias("c"))


def _bought(s: Shop) -> DataFrame:
    return s.txn.groupBy("customer_id").agg(F.count("*").alias("n"), F.avg("price").alias("p"))


@query(f"""WITH {SOLD}, r AS (SELECT c, row_number() OVER (ORDER BY c, article_id) AS i, count(*) OVER () AS n FROM s)
    SELECT round((2e0 * sum(CAST(i AS DOUBLE) * c)) / (max(n) * CAST(sum(c) AS DOUBLE)) - (max(n) + 1e0) / max(n), 6) AS gini FROM r""")
def gini(spark, sf_dir):
    return rounded(analysis.gini(_sold(Shop(spark, sf_dir)), "c"))


@query(f"""WITH {SOLD}, r AS (SELECT article_id, c, row_number() OVER (ORDER BY c DESC, article_id) AS place, sum(c) OVER (ORDER BY c DESC, article_id ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER () AS total FROM s)
    SELECT article_id, c AS n, place, round(CAST(upto AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM r""")
def pareto(spark, sf_dir):
    return rounded(analysis.pareto(_sold(Shop(spark, sf_dir)), "article_id", "c"))


@query(f"WITH {BOUGHT} SELECT DISTINCT n, round(cume_dist() OVER (ORDER BY n), 6) AS share FROM u")
def ecdf(spark, sf_dir):
    return rounded(analysis.ecdf(_bought(Shop(spark, sf_dir)), "n"))


@query(f"""WITH {BOUGHT}, r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2e0 AS rn, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rp FROM u)
    SELECT round(corr(rn, rp), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    return rounded(analysis.spearman(_bought(Shop(spark, sf_dir)), "n", "p"))


FLAT = "e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)"


@query(f"""WITH {FLAT}, h AS (SELECT t.customer_id, e.i, sum(CAST(e.x AS DOUBLE)) AS s, sum(CAST(e.x AS DOUBLE) * e.x) AS q, count(*) AS n FROM train t JOIN e ON t.article_id = e.vec_id GROUP BY 1, 2)
    SELECT customer_id, max(n) AS n, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS coherence FROM h GROUP BY customer_id HAVING max(n) >= 2""")
def purchase_coherence(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.coherence(s.train, s.vectors))


RETRIEVED = """h AS (SELECT t.customer_id, e.embedding AS v FROM train t JOIN embeddings e ON t.article_id = e.vec_id), f AS (SELECT customer_id, unnest(v) AS x, unnest(range(64)) AS i FROM h),
    c AS (SELECT customer_id, i, sum(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM f GROUP BY 1, 2), m AS (SELECT customer_id, sqrt(sum(x * x)) + 1e-12 AS m FROM c GROUP BY 1),
    q AS (SELECT c.customer_id, list(c.x / m.m ORDER BY i) AS v, max(c.n) AS n FROM c JOIN m ON c.customer_id = m.customer_id GROUP BY 1),
    ip AS (SELECT q.customer_id, e.vec_id AS article_id, round(list_inner_product(q.v, CAST(e.embedding AS DOUBLE[])), 9) AS s FROM q CROSS JOIN embeddings e),
    top AS (SELECT customer_id, article_id, place FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY s DESC, article_id) AS place FROM ip) x WHERE place <= 12)"""
RANKED = """gt AS (SELECT DISTINCT customer_id, article_id FROM val), sz AS (SELECT customer_id, least(count(*), 12) AS most FROM gt GROUP BY customer_id),
    hh AS (SELECT g.customer_id, p.place, row_number() OVER (PARTITION BY g.customer_id ORDER BY p.place) AS nth FROM gt g JOIN top p ON g.customer_id = p.customer_id AND g.article_id = p.article_id),
    ss AS (SELECT customer_id, sum(nth * 1e0 / place) AS ap, sum(1e0 / log2(place + 1)) AS dcg, min(place) AS f FROM hh GROUP BY customer_id),
    ideal AS (SELECT n.k AS most, sum(1e0 / log2(i.k + 1)) AS v FROM range(1, 13) n(k) JOIN range(1, 13) i(k) ON i.k <= n.k GROUP BY n.k),
    each AS (SELECT sz.customer_id, coalesce(ss.ap / sz.most, 0) AS ap, CASE WHEN ss.f IS NULL THEN 0e0 ELSE 1e0 END AS hr, coalesce(ss.dcg / i.v, 0) AS ndcg, coalesce(1e0 / ss.f, 0) AS rr FROM sz LEFT JOIN ss ON sz.customer_id = ss.customer_id JOIN ideal i ON i.most = sz.most)"""


def _retrieval(s: Shop) -> DataFrame:
    return analysis.retrieved_of(s.val, s.train, s.vectors, 12)


@query(f"""WITH {RETRIEVED}, {RANKED}, b AS (SELECT customer_id, CASE WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' WHEN n < 50 THEN '20-49' ELSE '50+' END AS cohort FROM q)
    SELECT cohort, {MEANS} FROM each JOIN b ON each.customer_id = b.customer_id GROUP BY cohort""")
def content_retrieval(spark, sf_dir):
    """Hit rate, NDCG and reciprocal rank by activity bracket; history isn't left out."""
    s = Shop(spark, sf_dir)
    n = analysis.activity(s.train, s.vectors)
    return metrics.evaluated(_retrieval(s), s.val, cohorts=n.select("customer_id", analysis.bracket(F.col("n")).alias("cohort")))


@query(f"""WITH {RETRIEVED}, sold AS (SELECT article_id, count(*) AS n FROM train GROUP BY article_id), tr AS (SELECT DISTINCT customer_id, article_id FROM val),
    l AS (SELECT CASE WHEN s.n IS NULL THEN 'cold' WHEN s.n <= 10 THEN '1-10' WHEN s.n <= 100 THEN '11-100' WHEN s.n <= 1000 THEN '101-1000' ELSE '1001+' END AS band, CASE WHEN t.article_id IS NULL THEN 0e0 ELSE 1e0 END AS hit
        FROM tr LEFT JOIN sold s ON tr.article_id = s.article_id LEFT JOIN top t ON tr.customer_id = t.customer_id AND tr.article_id = t.article_id)
    SELECT band, round(avg(hit), 6) AS hit_rate, count(*) AS n FROM l GROUP BY band""")
def retrieval_by_popularity(spark, sf_dir):
    """Share of validation purchases found among the twelve retrieved, by item popularity."""
    s = Shop(spark, sf_dir)
    top = _retrieval(s)
    sold = s.train.groupBy("article_id").agg(F.count("*").alias("n"))
    band = F.when(F.col("n").isNull(), "cold").when(F.col("n") <= 10, "1-10").when(F.col("n") <= 100, "11-100").when(F.col("n") <= 1000, "101-1000").otherwise("1001+")
    truth = s.val.select("customer_id", "article_id").distinct().join(sold, "article_id", "left").withColumn("band", band)
    hit = truth.join(top.select("customer_id", "article_id", F.lit(1.0).alias("hit")), ["customer_id", "article_id"], "left")
    return hit.groupBy("band").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"), F.count("*").alias("n"))


@query(f"""WITH {FLAT}, p AS (SELECT a.vec_id, a.i, b.i AS j, CAST(a.x AS DOUBLE) AS x, CAST(b.x AS DOUBLE) AS y FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < 32 AND b.i >= 32),
    xx AS (SELECT a.i, b.i AS j, sum(CAST(a.x AS DOUBLE) * b.x) - sum(CAST(a.x AS DOUBLE)) * sum(CAST(b.x AS DOUBLE)) / count(*) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < 32 AND b.i < 32 GROUP BY 1, 2),
    yy AS (SELECT a.i, b.i AS j, sum(CAST(a.x AS DOUBLE) * b.x) - sum(CAST(a.x AS DOUBLE)) * sum(CAST(b.x AS DOUBLE)) / count(*) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i >= 32 AND b.i >= 32 GROUP BY 1, 2),
    xy AS (SELECT i, j, sum(x * y) - sum(x) * sum(y) / count(*) AS c FROM p GROUP BY 1, 2)
    SELECT round((SELECT sum(c * c) FROM xy) / sqrt((SELECT sum(c * c) FROM xx) * (SELECT sum(c * c) FROM yy)), 6) AS cka""")
def linear_cka(spark, sf_dir):
    """CKA between the two halves of the vectors."""
    v = Shop(spark, sf_dir).vectors.select(F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))
    return rounded(analysis.linear_cka(v, "x", "y"))


@query("""WITH ip AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s FROM embeddings a CROSS JOIN embeddings b),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM ip), n AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, s FROM r WHERE k <= 21 AND a <> b AND s >= 0.3)
    SELECT n.a, n.b, round(n.s, 6) AS score FROM n JOIN articles x ON n.a = x.article_id JOIN articles y ON n.b = y.article_id WHERE x.garment_group_name <> y.garment_group_name ORDER BY n.s DESC, n.a, n.b LIMIT 500""")
def cross_category_neighbours(spark, sf_dir):
    s = Shop(spark, sf_dir)
    groups = s.articles.select("article_id", F.col("garment_group_name").alias("group"))
    return rounded(analysis.near_items(s.vectors, groups, least=0.3))


@query(f"""WITH u AS (SELECT customer_id FROM train GROUP BY customer_id), {POPULAR} SELECT u.customer_id, p.article_id, CAST(p.place AS BIGINT) AS place FROM u CROSS JOIN pred p WHERE p.place <= 12""")
def popularity_predictions(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(candidates.popular_for_all(s.train, s.train, 12))


@query("""SELECT customer_id, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY article_id) AS items FROM (SELECT DISTINCT customer_id, article_id FROM val) x GROUP BY customer_id""")
def ground_truth(spark, sf_dir):
    own = Shop(spark, sf_dir).val.groupBy("customer_id").agg(F.array_sort(F.collect_set("article_id")).alias("items"))
    return own.select("customer_id", F.array_join("items", ",").alias("items"))


@query(f"""WITH p AS (SELECT customer_id, article_id, count(*) AS n, date_diff('day', max(t_dat), DATE '{TRAIN_END}') AS days FROM train GROUP BY 1, 2) SELECT customer_id, article_id, n, CAST(days AS BIGINT) AS days FROM p""")
def interaction_lookup(spark, sf_dir):
    ref = F.lit(TRAIN_END).cast("date")
    return Shop(spark, sf_dir).train.groupBy("customer_id", "article_id").agg(F.count("*").alias("n"), F.datediff(ref, F.max("t_dat")).cast("long").alias("days"))


@query("""WITH n AS (SELECT DISTINCT customer_id, article_id FROM train), du AS (SELECT customer_id, count(*) AS d FROM n GROUP BY 1), di AS (SELECT article_id, count(*) AS d FROM n GROUP BY 1)
    SELECT n.customer_id, n.article_id, round(1e0 / sqrt(CAST(du.d AS DOUBLE) * di.d), 6) AS weight FROM n JOIN du ON n.customer_id = du.customer_id JOIN di ON n.article_id = di.article_id""")
def bipartite_weights(spark, sf_dir):
    from ..operators import ml

    return rounded(ml.normalized_edges(Shop(spark, sf_dir).train))


@query("""SELECT a.article_id, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 64 END AS size, round(coalesce(CAST(e.embedding[1] AS DOUBLE), 0), 6) AS first FROM articles a LEFT JOIN embeddings e ON a.article_id = e.vec_id""")
def aligned_vectors(spark, sf_dir):
    """Vector of every article; zeros where none matches."""
    s = Shop(spark, sf_dir)
    own = s.articles.select("article_id").join(s.vectors, "article_id", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 64)
    filled = own.select("article_id", F.coalesce("v", zeros).alias("v"), F.when(F.col("v").isNull(), 0).otherwise(F.size("v")).alias("size"))
    return filled.select("article_id", "size", F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query("""SELECT article_id, l2_style_mood IS NULL AS is_null, coalesce(len(CAST(json(l2_style_mood) AS VARCHAR[])), 0) AS n FROM fk""")
def list_lengths(spark, sf_dir):
    own = Shop(spark, sf_dir).fk
    return own.select("article_id", F.col("l2_style_mood").isNull().alias("is_null"), F.size(C.json_list(F.col("l2_style_mood"))).cast("long").alias("n"))
