"""Queries of profiles, separability, losses and reports, with their checks in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analysis, attributes, candidates, features, metrics, ml, profiles, quality, segments
from .retail import TYPES, Shop, _types, query, rounded

FACTS = ["super_category", "l2_style_mood", "l2_perceived_quality", "l2_trendiness", "l3_visual_weight"]


@query(f"""WITH r AS (SELECT t.customer_id, t.article_id, t.t_dat, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id, price, sales_channel_id) AS place FROM train t)
    SELECT r.customer_id, r.place, r.article_id, r.t_dat, a.product_type_name, {", ".join("f." + c for c in FACTS)} FROM r LEFT JOIN articles a ON r.article_id = a.article_id LEFT JOIN fk f ON r.article_id = f.article_id WHERE place <= 20""")
def recent_facts(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(profiles.recent_with_facts(s.train, s.articles, s.fk, FACTS))


@query("""WITH r AS (SELECT t.customer_id, t.article_id, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id, price, sales_channel_id) AS place FROM train t)
    SELECT r.customer_id, string_agg(coalesce(f.l2_trendiness, '-'), ',' ORDER BY place) AS trends, count(*) AS n FROM r LEFT JOIN fk f ON r.article_id = f.article_id WHERE place <= 5 GROUP BY 1""")
def recent_lists(spark, sf_dir):
    s = Shop(spark, sf_dir)
    own = profiles.recent_lists(profiles.recent_with_facts(s.train, s.articles, s.fk, FACTS, 5), ["article_id", "l2_trendiness"])
    trends = F.array_join(F.transform("items", lambda x: F.coalesce(x["l2_trendiness"], F.lit("-"))), ",")
    return own.select("customer_id", trends.alias("trends"), F.size("items").cast("long").alias("n"))


HARMONIES, ROLES, LINEAGES = ["Monochromatic", "Analogous", "Neutral"], ["Basic", "Statement", "Accent"], ["Grunge", "Minimal", "Punk", "Streetwear"]


@query(f"""WITH o AS (SELECT t.customer_id, x.* EXCLUDE (article_id) FROM train t LEFT JOIN fx x ON t.article_id = x.article_id),
    s AS (SELECT customer_id, {", ".join(f"sum(CASE WHEN l3_color_harmony = '{v}' THEN 1e0 ELSE 0 END) AS h{k}" for k, v in enumerate(HARMONIES))}, {", ".join(f"sum(CASE WHEN l3_coordination_role = '{v}' THEN 1e0 ELSE 0 END) AS r{k}" for k, v in enumerate(ROLES))},
        avg(l3_visual_weight) AS w, {", ".join(f"""sum(CASE WHEN l3_style_lineage LIKE '%"{v}"%' THEN 1e0 ELSE 0 END) AS l{k}""" for k, v in enumerate(LINEAGES))} FROM o GROUP BY customer_id)
    SELECT customer_id, {", ".join(f"round(CASE WHEN h0 + h1 + h2 > 0 THEN h{k} / (h0 + h1 + h2) ELSE 0 END, 6) AS d{k}" for k in range(3))}, {", ".join(f"round(CASE WHEN r0 + r1 + r2 > 0 THEN r{k} / (r0 + r1 + r2) ELSE 0 END, 6) AS d{3 + k}" for k in range(3))},
    round(coalesce(w / 5, 0.5), 6) AS d6, {", ".join(f"l{k} AS d{7 + k}" for k in range(4))} FROM s""")
def theory_vectors(spark, sf_dir):
    """All dimensions: harmonies and roles as shares, mean weight, lineages as plain counts."""
    s = Shop(spark, sf_dir)
    own = segments.attribute_vectors(s.train, s.fx, {"l3_color_harmony": HARMONIES, "l3_coordination_role": ROLES}, {}, ["l3_visual_weight"], {"l3_style_lineage": LINEAGES})
    return rounded(own.select("customer_id", *[F.col("vector")[k].alias(f"d{k}") for k in range(11)]))


@query("""WITH u AS (SELECT t.*, a.product_type_name AS v, quantile_cont(t_dat - DATE '1970-01-01', 0.5) OVER (PARTITION BY customer_id) AS m FROM train t JOIN articles a ON t.article_id = a.article_id),
    n AS (SELECT customer_id, v, sum(CASE WHEN t_dat - DATE '1970-01-01' > m THEN 0e0 ELSE 1e0 END) AS x, sum(CASE WHEN t_dat - DATE '1970-01-01' > m THEN 1e0 ELSE 0e0 END) AS y FROM u GROUP BY 1, 2),
    s AS (SELECT customer_id, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM n GROUP BY 1) SELECT round(avg(xy / sqrt(xx * yy)), 6) AS stability, count(*) AS n_users FROM s WHERE xx > 0 AND yy > 0""")
def stability_summary(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.stability_summary(analysis.half_stability(s.train.join(s.articles, "article_id"), "product_type_name")))


PAIRS = """hu AS (SELECT DISTINCT customer_id, CAST('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM dist),
    pr AS (SELECT * FROM (SELECT customer_id AS a, lead(customer_id) OVER (PARTITION BY h % 64 ORDER BY h, customer_id) AS b FROM hu) x WHERE b IS NOT NULL)"""


@query(f"""WITH {TYPES}, {PAIRS}, v AS (SELECT pr.a, pr.b, d.value FROM pr JOIN dist d ON d.customer_id = pr.a UNION SELECT pr.a, pr.b, d.value FROM pr JOIN dist d ON d.customer_id = pr.b),
    j AS (SELECT v.a, v.b, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM v LEFT JOIN dist x ON x.customer_id = v.a AND x.value = v.value LEFT JOIN dist y ON y.customer_id = v.b AND y.value = v.value),
    k AS (SELECT a, b, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM j GROUP BY 1, 2),
    e AS (SELECT customer_id, -sum(p * log2(p)) AS h FROM dist GROUP BY customer_id), m AS (SELECT avg(d) AS d FROM k), n AS (SELECT avg(h) AS h FROM e) SELECT round(d, 6) AS mean_distance, round(h, 6) AS mean_entropy, round(d / h, 6) AS value_index FROM m CROSS JOIN n""")
def value_index(spark, sf_dir):
    """Distances of drawn pairs of users over how varied each user is."""
    dist = _types(Shop(spark, sf_dir))
    pairs = analysis.user_pairs(dist.select("customer_id").distinct())
    return rounded(analysis.value_index(analysis.js_distance(dist, pairs), dist))


@query("""WITH o AS (SELECT t.customer_id, CAST(e.embedding AS DOUBLE[]) AS v FROM train t JOIN embeddings e ON t.article_id = e.vec_id), f AS (SELECT customer_id, unnest(v) AS x, unnest(range(64)) AS i FROM o),
    s AS (SELECT customer_id, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM f GROUP BY 1, 2), c AS (SELECT customer_id, max(n) AS n, (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) AS c FROM s GROUP BY 1 HAVING max(n) >= 2)
    SELECT CASE WHEN n < 5 THEN '2-4' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' WHEN n < 50 THEN '20-49' ELSE '50+' END AS bracket, round(avg(c), 6) AS mean_coherence, round(stddev_pop(c), 6) AS sd_coherence, count(*) AS n_users FROM c GROUP BY 1""")
def coherence_by_bracket(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.coherence_by_bracket(analysis.coherence(s.train, s.vectors)))


@query()
def cka_matrix(spark, sf_dir):
    """All pairs of three parts of the vectors."""
    v = Shop(spark, sf_dir).vectors.select(F.slice("v", 1, 16).alias("x"), F.slice("v", 17, 16).alias("y"), F.slice("v", 33, 32).alias("z"))
    return rounded(analysis.cka_matrix(v, ["x", "y", "z"]))


@query()
def separation(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(analysis.separation(s.train, s.val, s.vectors))


@query("""WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings), f AS (SELECT unnest(a) AS x, unnest(b) AS y FROM e),
    n AS (SELECT sum(x * x + y * y) AS s, sum((x - y) * (x - y)) / count(*) AS al FROM f), d AS (SELECT avg(list_inner_product(a, b) / ((sqrt(list_inner_product(a, a)) + 1e-8) * (sqrt(list_inner_product(b, b)) + 1e-8))) AS dv, count(*) AS n FROM e)
    SELECT round(0.01 * n.s / (2 * d.n), 6) AS l2, round(al, 6) AS align, round(dv, 6) AS diversity FROM n CROSS JOIN d""")
def expert_losses(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = F.col("embedding"), F.reverse("embedding")
    return rounded(v.agg(ml.l2_penalty(a, b, 0.01).alias("l2"), ml.align_loss(a, b).alias("align"), ml.diversity_loss(a, b).alias("diversity")))


@query("""SELECT vec_id, CAST(130 AS BIGINT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[1] AS DOUBLE), 6) AS last_reason, round(0.25e0, 6) AS fact_gate, round(CAST(label AS DOUBLE), 6) AS reason_gate FROM embeddings""")
def expert_block(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumns({"b": F.reverse("embedding"), "g": F.lit(0.25)})
    own = ml.expert_block(v, "embedding", "b", "g", "label")
    x = F.col("experts")
    return rounded(own.select("vec_id", F.size(x).cast("long").alias("n"), x[0].alias("first"), x[127].alias("last_reason"), x[128].alias("fact_gate"), x[129].alias("reason_gate")))


@query("""WITH i AS (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS item_idx FROM (SELECT DISTINCT article_id FROM articles WHERE article_id % 3 <> 0) a), u AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS user_idx FROM (SELECT DISTINCT customer_id FROM customers) c),
    c AS (SELECT t.customer_id, i.item_idx, count(*) AS n, t.article_id FROM train t JOIN i ON t.article_id = i.article_id GROUP BY 1, 2, 4), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, article_id) AS p FROM c),
    l AS (SELECT customer_id, list(item_idx ORDER BY p) AS items, list(n ORDER BY p) AS scores FROM r WHERE p <= 5 GROUP BY 1)
    SELECT u.user_idx, array_to_string(list_resize(coalesce(l.items, []), 5, 0), ',') AS items, CAST(coalesce(list_sum(l.scores), 0) AS DOUBLE) AS total FROM u LEFT JOIN l ON u.customer_id = l.customer_id""")
def candidate_arrays(spark, sf_dir):
    s = Shop(spark, sf_dir)
    users, items = features.dense_ids(s.customers, "customer_id", "user_idx"), features.dense_ids(s.articles.where("article_id % 3 <> 0"), "article_id", "item_idx")
    scored = candidates.interactions(s.train).withColumnRenamed("n", "score").withColumn("score", F.col("score").cast("double"))
    own = candidates.candidate_arrays(scored, users, items, 5)
    return own.select("user_idx", F.array_join("items", ",").alias("items"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("""WITH w AS (SELECT article_id, CASE WHEN trim(coalesce(l1_material, '')) = '' THEN 0 ELSE len(string_split(trim(l1_material), ' ')) END AS n FROM fk)
    SELECT 'coverage' AS part, 'l1_material' AS what, round(avg(CASE WHEN l1_material IS NULL THEN 0e0 ELSE 1e0 END), 6) AS value FROM fk UNION ALL SELECT 'coverage', 'l2_trendiness', 1e0 UNION ALL SELECT 'coverage', 'mean', round((avg(CASE WHEN l1_material IS NULL THEN 0e0 ELSE 1e0 END) + 1) / 2, 6) FROM fk
    UNION ALL SELECT 'domain', 'Error:sole_x_season', CAST(count(*) AS DOUBLE) FROM fx WHERE super_category = 'Footwear' AND l1_sole_type = 'Foam' AND l2_season_fit = 'Winter'
    UNION ALL SELECT 'tokens', 'mean', round(avg(floor(n * 1.3)), 6) FROM w UNION ALL SELECT 'tokens', 'most', CAST(max(floor(n * 1.3)) AS DOUBLE) FROM w""")
def factual_report(spark, sf_dir):
    """Coverage, one domain rule and token estimates in one table."""
    s = Shop(spark, sf_dir)
    domain = attributes.validated(s.fx, [], [r for r in attributes.domain_rules() if r.name == "sole_x_season"])
    own = quality.report({
        "coverage": quality.coverage(s.fk, ["l1_material", "l2_trendiness"]).toDF("what", "value"),
        "domain": attributes.validation_summary(domain).select("what", F.col("n").alias("value")),
        "tokens": quality.as_measures(quality.token_budget(s.fk, "l1_material").select("mean", "most")),
    })
    return rounded(own)


@query("""SELECT article_id, lower(trim(l2_trendiness)) AS low, lpad(CAST(article_id AS VARCHAR), 10, '0') AS padded, l1_material LIKE 'PROMO%' AS starts, l1_material LIKE '%BRUSHED%' AS has, replace(l1_material, ' ', '_') AS joined, upper(left(l2_trendiness, 1)) || lower(substr(l2_trendiness, 2)) AS title,
    round(CASE WHEN l1_material IS NULL THEN 0 ELSE l3_visual_weight / 3e0 END, 6) AS finite, round((100e0 * l3_visual_weight * 2 + 50 * 8) / 1e6 * 0.5, 9) AS cost, CAST(round(l3_visual_weight / 3e0, 3) AS DOUBLE) AS weight FROM fk""")
def text_functions(spark, sf_dir):
    """Strings, non-finite numbers, request costs and JSON weights of every article."""
    own = Shop(spark, sf_dir).fk
    odd = F.when(F.col("l1_material").isNull(), F.lit(float("nan"))).otherwise(F.col("l3_visual_weight") / 3)
    weights = C.json_weights(F.to_json(F.create_map(F.lit("w"), F.round(F.col("l3_visual_weight") / 3, 3))))
    return own.select("article_id", F.lower(F.trim("l2_trendiness")).alias("low"), F.lpad(F.col("article_id").cast("string"), 10, "0").alias("padded"), F.col("l1_material").startswith("PROMO").alias("starts"), F.col("l1_material").contains("BRUSHED").alias("has"), F.replace("l1_material", F.lit(" "), F.lit("_")).alias("joined"), F.initcap("l2_trendiness").alias("title"),
        F.round(C.finite(odd), 6).alias("finite"), F.round(attributes.batch_cost(100.0 * F.col("l3_visual_weight"), F.lit(50.0), 2.0, 8.0), 9).alias("cost"), weights["w"].alias("weight"))


@query("""WITH s AS (SELECT customer_id, count(*) AS n, avg(price) AS p FROM train GROUP BY customer_id), b AS (SELECT CASE WHEN n < 20 THEN 'a' WHEN n < 40 THEN 'b' ELSE 'c' END AS bin, p FROM s) SELECT bin, CAST(0 AS BIGINT) AS pos, round(var_pop(p), 4) AS variance FROM b GROUP BY bin""")
def variance_by_activity(spark, sf_dir):
    """Variance of each dimension of user vectors by bin of purchases."""
    own = Shop(spark, sf_dir).train.groupBy("customer_id").agg(F.count("*").alias("n"), F.array(F.avg("price")).alias("v"))
    binned = own.withColumn("bin", F.when(F.col("n") < 20, "a").when(F.col("n") < 40, "b").otherwise("c"))
    return rounded(segments.dimension_variance(binned, "bin", "v"), 4)


@query()
def retrieval_by_part(spark, sf_dir):
    """Hit rate of content retrieval for each of several vector variants, one row each."""
    s = Shop(spark, sf_dir)
    out = None
    for name, low, n in (("whole", 1, 64), ("first", 1, 32), ("second", 33, 32)):
        v = s.vectors.select("article_id", F.slice("v", low, n).alias("v"))
        one = metrics.evaluated(analysis.retrieved_of(s.val, s.train, v, 12), s.val).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)
