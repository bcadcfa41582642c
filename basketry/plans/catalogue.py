"""Queries of segments, attributes, quality, sources, learned operators and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, attributes, candidates, features, ml, profiles, quality, segments
from ..operators.ordering import settled
from ..sources import tables
from .retail import TYPES, Shop, query, rounded
from .sql import TRAIN_END, VAL_END

TRENDS = ["Classic", "Current", "Emerging", "Dated"]
MOODS = ["Casual", "Classic", "Sporty"]


def _weights(s: Shop):
    """(customer_id, weights): map of type shares."""
    dist = profiles.top_shares(profiles.distributions(profiles.weighted(s.train).join(s.articles, "article_id"), "product_type_name"))
    return dist.groupBy("customer_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "p")))).alias("weights"))


TOP = f"{TYPES}, rk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(p, 9) DESC, value) AS place FROM dist), top AS (SELECT customer_id, value, p FROM rk WHERE place <= 10)"


@query(f"WITH {TOP} SELECT value AS key, count(*) AS n FROM top GROUP BY value ORDER BY n DESC, key LIMIT 50")
def frequent_keys(spark, sf_dir):
    return segments.frequent_keys(_weights(Shop(spark, sf_dir)), "weights", 50)


@query(f"""WITH {TOP}, b AS (SELECT 'Brand#' || CAST(k AS VARCHAR) AS value, k FROM range(1, 26) r(k)), u AS (SELECT DISTINCT customer_id FROM top)
    SELECT u.customer_id, CAST(b.k - 1 AS BIGINT) AS pos, round(coalesce(t.p, 0), 6) AS x FROM u CROSS JOIN b LEFT JOIN top t ON t.customer_id = u.customer_id AND t.value = b.value""")
def taste_vectors(spark, sf_dir):
    own = segments.weight_vectors(_weights(Shop(spark, sf_dir)), "weights", [f"Brand#{k}" for k in range(1, 26)])
    return rounded(own.select("customer_id", F.posexplode("vector").alias("pos", "x")))


@query("""WITH o AS (SELECT t.customer_id, f.l2_trendiness AS tr, f.l2_perceived_quality AS q, f.l2_style_mood AS m FROM train t LEFT JOIN fk f ON t.article_id = f.article_id),
    s AS (SELECT customer_id, sum(CASE WHEN tr = 'Classic' THEN 1e0 ELSE 0 END) AS t0, sum(CASE WHEN tr IS NOT NULL THEN 1e0 ELSE 0 END) AS t, avg(q) AS q,
        sum(CASE WHEN m LIKE '%Casual%' THEN 1e0 ELSE 0 END) AS m0, sum(CASE WHEN m LIKE '%Classic%' THEN 1e0 ELSE 0 END) AS m1, sum(CASE WHEN m LIKE '%Sporty%' THEN 1e0 ELSE 0 END) AS m2 FROM o GROUP BY customer_id)
    SELECT customer_id, round(CASE WHEN t > 0 THEN t0 / t ELSE 0 END, 6) AS classic, round(CASE WHEN m0 + m1 + m2 > 0 THEN m0 / (m0 + m1 + m2) ELSE 0 END, 6) AS casual, round(coalesce(q / 5, 0.5), 6) AS quality FROM s""")
def attribute_vectors(spark, sf_dir):
    s = Shop(spark, sf_dir)
    own = segments.attribute_vectors(s.train, s.fk, {"l2_trendiness": TRENDS}, {"l2_style_mood": MOODS}, ["l2_perceived_quality"])
    return rounded(own.select("customer_id", F.col("vector")[0].alias("classic"), F.col("vector")[4].alias("casual"), F.col("vector")[7].alias("quality")))


LABELS = "lb AS (SELECT customer_id, CAST(count(*) % 5 AS INT) AS a, CAST(count(DISTINCT article_id) % 5 AS INT) AS b, avg(price) AS p, count(*) AS n FROM train GROUP BY customer_id)"


def _labels(s: Shop):
    return s.train.groupBy("customer_id").agg((F.count("*") % 5).cast("int").alias("a"), (F.count_distinct("article_id") % 5).cast("int").alias("b"), F.avg("price").alias("p"), F.count("*").alias("n"))


@query(f"WITH {LABELS} SELECT CAST(a AS BIGINT) AS a, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(n), 4) AS mean_n FROM lb GROUP BY a")
def segment_statistics(spark, sf_dir):
    return rounded(segments.statistics(_labels(Shop(spark, sf_dir)), "a", ["p", "n"]), 4)


@query(f"""WITH {TOP}, {LABELS}, c AS (SELECT l.a, t.value AS key, count(*) AS n FROM top t JOIN lb l ON t.customer_id = l.customer_id GROUP BY 1, 2)
    SELECT CAST(a AS BIGINT) AS a, key, n, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, key) AS place FROM c) x WHERE place <= 3""")
def segment_keys(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(segments.top_keys(_weights(s).join(_labels(s), "customer_id"), "a", "weights"))


@query(f"""WITH {TOP}, {LABELS}, w AS (SELECT l.a, t.value AS key, sum(t.p) AS w FROM top t JOIN lb l ON t.customer_id = l.customer_id GROUP BY 1, 2), sh AS (SELECT a, key, w / sum(w) OVER (PARTITION BY a) AS s FROM w),
    po AS (SELECT key, sum(w) / (SELECT sum(w) FROM w) AS p FROM w GROUP BY key), g AS (SELECT u.a, po.key, coalesce(sh.s, 0) / po.p AS ratio FROM (SELECT DISTINCT a FROM w) u CROSS JOIN po LEFT JOIN sh ON sh.a = u.a AND sh.key = po.key WHERE po.p >= 0.01),
    sd AS (SELECT *, CASE WHEN ratio > 1 THEN 'over' ELSE 'under' END AS side FROM g WHERE ratio <> 1)
    SELECT CAST(a AS BIGINT) AS a, key, round(ratio, 6) AS ratio, side, place FROM (SELECT *, row_number() OVER (PARTITION BY a, side ORDER BY round(CASE WHEN side = 'over' THEN -ratio ELSE ratio END, 9), key) AS place FROM sd) x WHERE place <= 3""")
def discriminative_keys(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return rounded(segments.discriminative_keys(_weights(s).join(_labels(s), "customer_id"), "a", "weights"))


@query(f"""WITH {LABELS}, n AS (SELECT a, count(*) AS n FROM lb GROUP BY a), p AS (SELECT n * 1e0 / sum(n) OVER () AS p FROM n), h AS (SELECT -sum(p * ln(p)) AS h, count(*) AS k FROM p)
    SELECT k, round(exp(h), 6) AS effective_k, round(CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END, 6) AS evenness FROM h""")
def effective_k(spark, sf_dir):
    return rounded(segments.effective_k(_labels(Shop(spark, sf_dir)), "a"))


@query(f"""WITH {LABELS}, n AS (SELECT a, b, count(*) AS n FROM lb GROUP BY a, b), s AS (SELECT sum(n * (n - 1) / 2e0) AS ij, sum(n) * (sum(n) - 1) / 2e0 AS t FROM n),
    x AS (SELECT sum(n * (n - 1) / 2e0) AS v FROM (SELECT sum(n) AS n FROM n GROUP BY a) q), y AS (SELECT sum(n * (n - 1) / 2e0) AS v FROM (SELECT sum(n) AS n FROM n GROUP BY b) q)
    SELECT round((ij - x.v * y.v / t) / ((x.v + y.v) / 2 - x.v * y.v / t), 6) AS ari FROM s, x, y""")
def adjusted_rand(spark, sf_dir):
    return rounded(segments.adjusted_rand(_labels(Shop(spark, sf_dir)), "a", "b"))


@query(f"""WITH {LABELS}, l AS (SELECT customer_id, 'a' AS k, a AS v FROM lb UNION ALL SELECT customer_id, 'b', b FROM lb UNION ALL SELECT customer_id, 'c', CAST(customer_id % 3 AS INT) FROM lb),
    n AS (SELECT x.k AS a, y.k AS b, x.v AS va, y.v AS vb, count(*) AS n FROM l x JOIN l y ON x.customer_id = y.customer_id AND x.k <= y.k GROUP BY 1, 2, 3, 4),
    s AS (SELECT a, b, sum(n * (n - 1) / 2e0) AS ij, sum(n) * (sum(n) - 1) / 2e0 AS t FROM n GROUP BY 1, 2),
    ra AS (SELECT a, b, sum(m * (m - 1) / 2e0) AS v FROM (SELECT a, b, va, sum(n) AS m FROM n GROUP BY 1, 2, 3) q GROUP BY 1, 2), rb AS (SELECT a, b, sum(m * (m - 1) / 2e0) AS v FROM (SELECT a, b, vb, sum(n) AS m FROM n GROUP BY 1, 2, 3) q GROUP BY 1, 2)
    SELECT s.a, s.b, round((ij - ra.v * rb.v / t) / ((ra.v + rb.v) / 2 - ra.v * rb.v / t), 6) AS ari FROM s JOIN ra ON s.a = ra.a AND s.b = ra.b JOIN rb ON s.a = rb.a AND s.b = rb.b""")
def label_agreement(spark, sf_dir):
    own = _labels(Shop(spark, sf_dir)).withColumn("c", (F.col("customer_id") % 3).cast("int"))
    return rounded(segments.label_agreement(own, ["a", "b", "c"]))


@query(f"WITH {LABELS} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM lb GROUP BY a, b")
def transition_shares(spark, sf_dir):
    return rounded(segments.transition_shares(_labels(Shop(spark, sf_dir)), "a", "b"))


@query(f"""WITH {LABELS}, n AS (SELECT a, b, count(*) AS n FROM lb GROUP BY a, b), p AS (SELECT n * 1e0 / sum(n) OVER () AS j, n * 1e0 / sum(n) OVER (PARTITION BY a) AS c FROM n) SELECT round(-sum(j * log2(c)), 6) AS conditional_entropy FROM p""")
def conditional_entropy(spark, sf_dir):
    return rounded(segments.conditional_entropy(_labels(Shop(spark, sf_dir)), "a", "b"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings) SELECT CAST(label AS BIGINT) AS label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY label, pos")
def label_means(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(segments.label_means(rows, "label", "embedding"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings) SELECT CAST(label AS BIGINT) AS label, pos, round(var_pop(CAST(x AS DOUBLE)), 6) AS variance FROM e GROUP BY label, pos")
def dimension_variance(spark, sf_dir):
    return rounded(segments.dimension_variance(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "embedding"))


@query("""SELECT th AS threshold, count(*) AS n, round(avg(n), 4) AS mean, round(avg(n) - 1, 4) AS excess, CAST(max(n) - 1 AS DOUBLE) AS most FROM (SELECT customer_id, CAST(count(*) AS DOUBLE) AS n FROM train GROUP BY 1) x, (VALUES (10e0), (20e0), (40e0)) v(th) WHERE n >= th GROUP BY th""")
def excess_similarity(spark, sf_dir):
    own = Shop(spark, sf_dir).train.groupBy("customer_id").agg(F.count("*").cast("double").alias("n"))
    return rounded(segments.excess_similarity(own, "n", [10, 20, 40], 1.0), 4)


# attributes

GROUPS = {"G0": "Apparel", "G1": "Footwear", "G2": "Mixed"}
PRODUCTS = {"Brand#1": "Accessories", "Brand#2": "Footwear"}


@query("""SELECT article_id, coalesce(CASE garment_group_name WHEN 'G0' THEN 'Apparel' WHEN 'G1' THEN 'Footwear' END, CASE product_type_name WHEN 'Brand#1' THEN 'Accessories' WHEN 'Brand#2' THEN 'Footwear' END, 'Apparel') AS category FROM articles""")
def category_routing(spark, sf_dir):
    own = Shop(spark, sf_dir).articles
    return own.select("article_id", attributes.routed(F.col("garment_group_name"), F.col("product_type_name"), GROUPS, PRODUCTS).alias("category"))


@query("""SELECT article_id, CASE super_category WHEN 'Apparel' THEN coalesce(l1_material, 'UNKNOWN') WHEN 'Footwear' THEN l2_trendiness ELSE 'UNKNOWN' END AS slot4 FROM fk""")
def slot_unification(spark, sf_dir):
    own = attributes.slotted(Shop(spark, sf_dir).fk, {"slot4": {"Apparel": "l1_material", "Footwear": "l2_trendiness"}})
    return own.select("article_id", "slot4")


@query("""SELECT article_id, CASE WHEN l1_material IS NULL THEN NULL WHEN l1_material LIKE 'ECONOMY%' THEN 'Warm' ELSE 'Neutral-Cool' END AS tone FROM fk""")
def tone_lookup(spark, sf_dir):
    own = Shop(spark, sf_dir).fk
    return own.select("article_id", attributes.looked_up(F.split_part("l1_material", F.lit(" "), F.lit(1)), {"ECONOMY": "Warm"}, "Neutral-Cool").alias("tone"))


@query("""WITH r AS (SELECT article_id, l3_visual_weight AS v, CASE l2_trendiness WHEN 'Classic' THEN 1 WHEN 'Current' THEN 2 END AS l1, CASE l2_trendiness WHEN 'Classic' THEN 3 WHEN 'Current' THEN 4 END AS h1,
        CASE l3_color_harmony WHEN 'Neutral' THEN 4 WHEN 'Analogous' THEN 2 END AS l2, CASE l3_color_harmony WHEN 'Neutral' THEN 5 WHEN 'Analogous' THEN 3 END AS h2 FROM fk),
    g AS (SELECT *, greatest(l1, l2) AS lo, least(h1, h2) AS hi FROM r), f AS (SELECT article_id, v, CASE WHEN lo > hi THEN coalesce(l1, l2) ELSE lo END AS lo, CASE WHEN lo > hi THEN coalesce(h1, h2) ELSE hi END AS hi FROM g)
    SELECT article_id, CAST(CASE WHEN lo IS NULL THEN v ELSE least(greatest(v, lo), hi) END AS BIGINT) AS weight FROM f""")
def weight_clamp(spark, sf_dir):
    own = Shop(spark, sf_dir).fk
    ranges = [(F.col("l2_trendiness"), {"Classic": (1, 3), "Current": (2, 4)}), (F.col("l3_color_harmony"), {"Neutral": (4, 5), "Analogous": (2, 3)})]
    return own.select("article_id", attributes.clamped(F.col("l3_visual_weight"), ranges).cast("long").alias("weight"))


@query("""WITH s AS (SELECT product_code, article_id, length(colour_group_name) + CASE WHEN article_id % 3 = 0 THEN 10000 ELSE 0 END AS sc FROM articles)
    SELECT product_code, article_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY sc DESC, article_id) AS k FROM s) x WHERE k = 1""")
def representatives(spark, sf_dir):
    return attributes.representatives(Shop(spark, sf_dir).articles, "colour_group_name", F.col("article_id") % 3 == 0)


@query("""WITH o AS (SELECT f.*, a.product_code, row_number() OVER (PARTITION BY a.product_code ORDER BY f.article_id) AS k FROM fk f JOIN articles a ON f.article_id = a.article_id)
    SELECT a.article_id, a.colour_group_name, o.super_category, o.l2_trendiness, a.article_id = o.article_id AS is_representative FROM articles a JOIN o ON a.product_code = o.product_code AND o.k = 1""")
def propagated_attributes(spark, sf_dir):
    s = Shop(spark, sf_dir)
    return attributes.propagated(s.articles, s.fk).select("article_id", "colour_group_name", "super_category", "l2_trendiness", "is_representative")


@query("""SELECT article_id, concat_ws('. ', CASE WHEN l1_material IS NOT NULL THEN '[Product] material: ' || l1_material END, '[Perceptual] ' || concat_ws('; ', 'trend: ' || l2_trendiness, 'quality: ' || CAST(l2_perceived_quality AS VARCHAR)), '[Theory] weight: ' || CAST(l3_visual_weight AS VARCHAR)) AS text FROM fk""")
def composed_texts(spark, sf_dir):
    parts = {"Product": {"material": F.col("l1_material")}, "Perceptual": {"trend": F.col("l2_trendiness"), "quality": F.col("l2_perceived_quality")}, "Theory": {"weight": F.col("l3_visual_weight")}}
    return Shop(spark, sf_dir).fk.select("article_id", attributes.composed_text(parts).alias("text"))


LAYERS = {"L1": {"Product": ["l1_material"]}, "L2": {"Perceptual": ["l2_trendiness"]}, "L3": {"Theory": ["l3_color_harmony"]}}


@query("""WITH p AS (SELECT article_id, '[Product] l1_material: ' || l1_material AS a, '[Perceptual] l2_trendiness: ' || l2_trendiness AS b, '[Theory] l3_color_harmony: ' || l3_color_harmony AS c FROM fk)
    SELECT article_id, 'L1' AS layers, concat_ws('. ', a) AS text FROM p UNION ALL SELECT article_id, 'L2', concat_ws('. ', b) FROM p UNION ALL SELECT article_id, 'L3', concat_ws('. ', c) FROM p UNION ALL SELECT article_id, 'L1+L2', concat_ws('. ', a, b) FROM p
    UNION ALL SELECT article_id, 'L1+L3', concat_ws('. ', a, c) FROM p UNION ALL SELECT article_id, 'L2+L3', concat_ws('. ', b, c) FROM p UNION ALL SELECT article_id, 'L1+L2+L3', concat_ws('. ', a, b, c) FROM p""")
def layer_texts(spark, sf_dir):
    """Texts of all seven layer combinations."""
    own = Shop(spark, sf_dir).fk
    combos = ["L1", "L2", "L3", "L1+L2", "L1+L3", "L2+L3", "L1+L2+L3"]
    text = lambda combo: attributes.composed_text({s: {c: F.col(c) for c in cs} for layer in combo.split("+") for s, cs in LAYERS[layer].items()})
    return own.select("article_id", F.explode(F.array(*[F.struct(F.lit(c).alias("layers"), text(c).alias("text")) for c in combos])).alias("x")).select("article_id", "x.*")


FIELDS = [attributes.Field("l1_material", "enum", ("PROMO",)), attributes.Field("l2_trendiness", "enum", tuple(TRENDS[:3])), attributes.Field("l3_visual_weight", "int", low=1, high=4), attributes.Field("l2_style_mood", "list", ("Casual", "Classic"), most=1)]
RULES = [attributes.Rule("dated_premium", "Error", "l2_trendiness = 'Dated' and l2_perceived_quality = 5"), attributes.Rule("heavy_neutral", "Warning", "l3_visual_weight = 5 and l3_color_harmony = 'Neutral'")]


@query("""WITH p AS (SELECT CASE WHEN l1_material IS NULL THEN 'l1_material:missing' WHEN l1_material <> 'PROMO' THEN 'l1_material:value' END AS w FROM fk UNION ALL SELECT CASE WHEN l2_trendiness = 'Dated' THEN 'l2_trendiness:value' END FROM fk
    UNION ALL SELECT CASE WHEN l3_visual_weight > 4 THEN 'l3_visual_weight:range' END FROM fk UNION ALL SELECT CASE WHEN l2_style_mood IS NULL THEN 'l2_style_mood:missing' END FROM fk
    UNION ALL SELECT CASE WHEN l2_style_mood LIKE '%,%' THEN 'l2_style_mood:length' END FROM fk UNION ALL SELECT CASE WHEN l2_style_mood LIKE '%Sporty%' THEN 'l2_style_mood:value' END FROM fk
    UNION ALL SELECT CASE WHEN l2_trendiness = 'Dated' AND l2_perceived_quality = 5 THEN 'Error:dated_premium' END FROM fk UNION ALL SELECT CASE WHEN l3_visual_weight = 5 AND l3_color_harmony = 'Neutral' THEN 'Warning:heavy_neutral' END FROM fk)
    SELECT w AS what, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM fk), 6) AS share FROM p WHERE w IS NOT NULL GROUP BY w""")
def validation_report(spark, sf_dir):
    return rounded(attributes.validation_summary(attributes.validated(Shop(spark, sf_dir).fk, FIELDS, RULES)))


@query("""SELECT CAST(article_id AS VARCHAR) AS custom_id, l2_trendiness AS trend FROM fk WHERE article_id % 5 <> 0""")
def response_parsing(spark, sf_dir):
    """Facts written as response lines and read again; lines with an error are skipped."""
    own = Shop(spark, sf_dir).fk
    inner = F.to_json(F.struct(F.col("l2_trendiness").alias("trend")))
    body = F.struct(F.struct(F.array(F.struct(F.array(F.struct(inner.alias("text"))).alias("content"))).alias("output")).alias("body"))
    lines = own.select(F.lit(1).alias("file_no"), F.to_json(F.struct(F.col("article_id").cast("string").alias("custom_id"), F.when(F.col("article_id") % 5 == 0, "failed").alias("error"), body.alias("response"))).alias("line"))
    return tables.parsed_responses(lines, "trend string").where("ok").select("custom_id", "parsed.trend")


@query("""SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'new' ELSE l2_trendiness END AS trend FROM fk""")
def cache_upsert(spark, sf_dir):
    own = Shop(spark, sf_dir).fk.select("article_id", F.col("l2_trendiness").alias("trend"))
    return tables.upserted(own, own.where("article_id % 2 = 0").withColumn("trend", F.lit("new")), "article_id")


@query("SELECT article_id, 'images/' || substr(lpad(CAST(article_id AS VARCHAR), 10, '0'), 1, 3) || '/' || lpad(CAST(article_id AS VARCHAR), 10, '0') || '.jpg' AS path FROM articles")
def image_paths(spark, sf_dir):
    return tables.image_paths(Shop(spark, sf_dir).articles)


@query(f"SELECT customer_id, article_id, t_dat, price, CAST(sales_channel_id AS BIGINT) AS sales_channel_id, CASE WHEN t_dat <= DATE '{TRAIN_END}' THEN 'train' WHEN t_dat <= DATE '{VAL_END}' THEN 'val' ELSE 'test' END AS split FROM txn")
def date_split(spark, sf_dir):
    return rounded(tables.split_by_date(Shop(spark, sf_dir).txn, TRAIN_END, VAL_END))


@query("""SELECT customer_id, coalesce(club_member_status, 'UNKNOWN') AS club_member_status, CAST(0 AS DOUBLE) AS "Active" FROM customers""")
def customer_cleaning(spark, sf_dir):
    raw = Shop(spark, sf_dir).customers.withColumn("Active", F.lit(None).cast("double"))
    return tables.cleaned_customers(raw).select("customer_id", "club_member_status", "Active")


# quality

@query("""WITH x AS (SELECT avg(CASE WHEN l1_material IS NULL THEN 0e0 ELSE 1e0 END) AS a, avg(CASE WHEN l2_style_mood IS NULL THEN 0e0 ELSE 1e0 END) AS b FROM fk)
    SELECT 'l1_material' AS field, round(a, 6) AS share FROM x UNION ALL SELECT 'l2_style_mood', round(b, 6) FROM x UNION ALL SELECT 'absent', 0 FROM x UNION ALL SELECT 'mean', round((a + b) / 3, 6) FROM x""")
def field_coverage(spark, sf_dir):
    return rounded(quality.coverage(Shop(spark, sf_dir).fk, ["l1_material", "l2_style_mood", "absent"]))


@query("""WITH n AS (SELECT CAST(floor(len(regexp_split_to_array(trim(text), '\\s+')) * 1.3) AS BIGINT) AS n FROM documents)
    SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most, CAST(sum(CASE WHEN n > 512 THEN 1 ELSE 0 END) AS BIGINT) AS over, round(avg(CASE WHEN n > 512 THEN 1e0 ELSE 0e0 END), 6) AS share_over FROM n""")
def token_budget(spark, sf_dir):
    return rounded(quality.token_budget(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text"))


ENUMS = """v AS (SELECT 'l2_trendiness' AS "column", l2_trendiness AS value FROM fk UNION ALL SELECT 'l2_style_mood', e.value FROM fk, UNNEST(CAST(json(l2_style_mood) AS VARCHAR[])) AS e(value)),
    n AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY "column") AS share FROM n)"""


@query(f"""WITH {ENUMS} SELECT "column", value, n, round(share, 6) AS share FROM s""")
def enum_distribution(spark, sf_dir):
    return rounded(quality.enum_distribution(Shop(spark, sf_dir).fk, ["l2_trendiness"], ["l2_style_mood"]))


@query(f"""WITH {ENUMS} SELECT "column", count(*) AS n_unique, round(-sum(share * log2(share)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(share * log2(share)) / log2(count(*)) ELSE 0 END, 6) AS evenness, round(max(share), 6) AS top_share FROM s GROUP BY 1""")
def enum_summary(spark, sf_dir):
    return rounded(quality.enum_summary(quality.enum_distribution(Shop(spark, sf_dir).fk, ["l2_trendiness"], ["l2_style_mood"])))


GENERIC_SQL = "(lower(trim(t)) LIKE 'unknown%' OR lower(trim(t)) LIKE 'n/a%' OR lower(trim(t)) LIKE 'not available%' OR lower(trim(t)) LIKE 'no data%' OR lower(trim(t)) LIKE 'insufficient%')"


@query(f"""WITH x AS (SELECT article_id, coalesce(l1_material, '') AS a, CASE WHEN article_id % 10 = 0 THEN 'Unknown so far' WHEN article_id % 10 = 1 THEN ' n/a' ELSE l2_trendiness END AS b, CASE WHEN article_id % 4 = 0 THEN repeat('word ', 30) ELSE 'Insufficiently' END AS c FROM fk),
    y AS (SELECT avg(CASE WHEN trim(a) <> '' AND NOT {GENERIC_SQL.replace("(t)", "(a)")} THEN 1e0 ELSE 0e0 END) AS a, avg(CASE WHEN trim(b) <> '' AND NOT {GENERIC_SQL.replace("(t)", "(b)")} THEN 1e0 ELSE 0e0 END) AS b, avg(CASE WHEN trim(c) <> '' AND NOT {GENERIC_SQL.replace("(t)", "(c)")} THEN 1e0 ELSE 0e0 END) AS c,
        sum(CASE WHEN {GENERIC_SQL.replace("(t)", "(a)")} OR {GENERIC_SQL.replace("(t)", "(b)")} OR {GENERIC_SQL.replace("(t)", "(c)")} THEN 1e0 ELSE 0e0 END) AS g, sum(CASE WHEN length(a) + length(b) + length(c) < 100 THEN 1e0 ELSE 0e0 END) AS s FROM x)
    SELECT 'a' AS what, round(a, 6) AS value FROM y UNION ALL SELECT 'b', round(b, 6) FROM y UNION ALL SELECT 'c', round(c, 6) FROM y UNION ALL SELECT 'overall', round((a + b + c) / 3, 6) FROM y UNION ALL SELECT 'n_generic', g FROM y UNION ALL SELECT 'n_short', s FROM y""")
def completeness(spark, sf_dir):
    own = Shop(spark, sf_dir).fk
    odd = F.when(F.col("article_id") % 10 == 0, "Unknown so far").when(F.col("article_id") % 10 == 1, " n/a").otherwise(F.col("l2_trendiness"))
    own = own.select(F.col("l1_material").alias("a"), odd.alias("b"), F.when(F.col("article_id") % 4 == 0, F.repeat(F.lit("word "), F.lit(30))).otherwise("Insufficiently").alias("c"))
    return rounded(quality.completeness(own, ["a", "b", "c"]))


@query("""SELECT 'l1_material' AS field, round(count(DISTINCT l1_material) * 1e0 / count(l1_material), 6) AS ratio FROM fk UNION ALL SELECT 'l2_trendiness', round(count(DISTINCT l2_trendiness) * 1e0 / count(l2_trendiness), 6) FROM fk""")
def unique_ratios(spark, sf_dir):
    return rounded(quality.unique_ratios(Shop(spark, sf_dir).fk, ["l1_material", "l2_trendiness"]))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS BIGINT) AS n_trigrams FROM w""")
def word_trigrams(spark, sf_dir):
    return rounded(quality.word_trigrams(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text").select("doc_id", "n_trigrams"))


DOMAIN_SQL = {
    "Error:coordination_x_visual_weight": "l3_coordination_role = 'Basic' AND l3_visual_weight > 3 OR l3_coordination_role = 'Statement' AND l3_visual_weight < 3",
    "Error:silhouette_x_visual_weight": "super_category = 'Apparel' AND (l3_silhouette = 'I-line' AND l3_visual_weight > 3 OR l3_silhouette = 'O-line' AND l3_visual_weight < 3)",
    "Error:fit_x_visual_weight": "super_category = 'Apparel' AND (l1_fit IN ('Slim', 'Skinny') AND l3_visual_weight > 3 OR l1_fit IN ('Oversized', 'Loose', 'Boxy') AND l3_visual_weight < 3)",
    "Error:sleeve_x_season": "super_category = 'Apparel' AND l1_sleeve_type = 'Sleeveless' AND l2_season_fit = 'Winter'",
    "Error:neckline_x_sleeve": "super_category = 'Apparel' AND l1_neckline = 'Strapless' AND (l1_sleeve_type IS NULL OR l1_sleeve_type NOT IN ('Sleeveless', 'N/A'))",
    "Error:sole_x_season": "super_category = 'Footwear' AND l1_sole_type = 'Foam' AND l2_season_fit = 'Winter'",
    "Error:function_x_form_factor": "super_category = 'Accessories' AND l1_primary_function = 'Storage' AND l1_form_factor IN ('Mini', 'Compact')",
    "Error:wearing_x_size_scale": "super_category = 'Accessories' AND l1_wearing_method IN ('Wrist', 'Finger') AND (l1_size_scale IS NULL OR l1_size_scale NOT IN ('Petite', 'Small'))",
    "Warning:mood_x_occasion": """l2_style_mood LIKE '%"Bohemian"%' AND (l2_occasion LIKE '%"Work"%' OR l2_occasion LIKE '%"Formal"%')""",
    "Warning:heel_x_occasion": """super_category = 'Footwear' AND l1_heel_type = 'Stiletto' AND l2_occasion LIKE '%"Outdoor"%'""",
    "Warning:coordination_x_harmony": "l3_coordination_role = 'Basic' AND l3_color_harmony NOT IN ('Monochromatic', 'Neutral', 'Earth-tone') OR l3_coordination_role = 'Accent' AND l3_color_harmony = 'Monochromatic'",
    "Warning:lineage_x_mood": " OR ".join(f"""l3_style_lineage LIKE '%"{a}"%' AND l2_style_mood LIKE '%"{b}"%'""" for a, b in attributes.CONTRADICTIONS),
}


@query("WITH o AS (SELECT article_id, super_category, replace(l2_style_mood, 'Sporty', 'Bohemian') AS l2_style_mood, * EXCLUDE (article_id, super_category, l2_style_mood) FROM fx), b AS (" + " UNION ALL ".join(f"SELECT article_id, '{k}' AS broken FROM o WHERE {v}" for k, v in DOMAIN_SQL.items()) + ") SELECT article_id, broken FROM b")
def domain_rules(spark, sf_dir):
    """Broken rules of articles with synthetic attributes."""
    own = Shop(spark, sf_dir).fx.withColumn("l2_style_mood", F.replace("l2_style_mood", F.lit("Sporty"), F.lit("Bohemian")))
    return attributes.validated(own, [], attributes.domain_rules()).select("article_id", F.explode("broken").alias("broken"))


@query()
def discriminability(spark, sf_dir):
    return rounded(quality.discriminability(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


@query("""WITH x AS (SELECT avg(CASE WHEN l1_material IS NULL THEN 0e0 ELSE 1e0 END) AS v FROM fk)
    SELECT 'l1_material' AS name, '>=' AS op, 0.9e0 AS threshold, round(v, 6) AS value, CASE WHEN v >= 0.9 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM x UNION ALL SELECT 'other', '<=', 0.1e0, NULL, 'SKIP' FROM x""")
def go_no_go(spark, sf_dir):
    measures = quality.coverage(Shop(spark, sf_dir).fk, ["l1_material"]).where("field <> 'mean'").toDF("name", "value")
    return rounded(quality.verdicts(measures, [("l1_material", ">=", 0.9), ("other", "<=", 0.1)]))


@query("""WITH x AS (SELECT least(greatest(CAST(l2_perceived_quality AS DOUBLE), 1), 5) AS q, least(greatest(CAST(l3_visual_weight AS DOUBLE), 1), 5) AS w FROM fk) SELECT round(avg(q), 6) AS l2_perceived_quality, round(avg(w), 6) AS l3_visual_weight,
    round(avg(CASE WHEN (q + w) / 2 >= 3.5 THEN 1e0 ELSE 0e0 END), 6) AS pass_rate, count(*) AS n FROM x""")
def judge_summary(spark, sf_dir):
    return rounded(quality.judge_summary(Shop(spark, sf_dir).fk, ["l2_perceived_quality", "l3_visual_weight"]))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def event_properties(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


# learned operators and graphs

@query()
def als_recommendations(spark, sf_dir):
    return ml.als_recommendations(Shop(spark, sf_dir).train, rank=8)


@query()
def vector_clusters(spark, sf_dir):
    return ml.kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", 10).select("vec_id", "label", "cluster")


@query()
def cluster_selection(spark, sf_dir):
    return ml.silhouettes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", [5, 10])


@query()
def whitened_vectors(spark, sf_dir):
    return ml.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").select("vec_id", "components")


@query("""WITH f AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 7 <> 0), m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY 1, 2),
    e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 7 = 0), d AS (SELECT e.vec_id, m.label, sum((e.x - m.x) * (e.x - m.x)) AS d FROM e JOIN m ON e.i = m.i GROUP BY 1, 2)
    SELECT vec_id, arg_min(label, d) AS label FROM d GROUP BY vec_id UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0""")
def outlier_assignment(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")))
    return ml.nearest_centroid(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", "label").select("vec_id", "label")


@query()
def topic_words(spark, sf_dir):
    return rounded(ml.topic_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "text"))


def _boosted(spark, sf_dir):
    from .retail import _blend

    s = Shop(spark, sf_dir)
    users = features.user_features(s.train, s.articles, s.customers, TRAIN_END)
    items = features.item_features(s.train, s.articles, ["section_name"])
    rows = candidates.rerank_features(_blend(s), users, items, s.train, s.articles, TRAIN_END)
    rows = settled(candidates.hash_split(candidates.labelled(rows, s.val), "customer_id"))
    return rows, ml.boosted(rows, ["score", "rank", "gap", "u_n_purchases", "i_n_sold", "price_ratio", "pair_n", "pair_days", "type_n"], "label", trees=12, patience=5)


@query()
def boosted_reranking(spark, sf_dir):
    """Held-out candidates placed by a boosted model's score, as of its best round."""
    from pyspark.sql import Window as W

    rows, model = _boosted(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("customer_id").orderBy(F.desc("model_score"), "article_id"))
    scored = model.scores(rows.where("part = 'held_out'"))
    return scored.withColumn("place", place).where("place <= 12").select("customer_id", "article_id", "place")


@query()
def boosted_rounds(spark, sf_dir):
    """The re-ranker's AUC after each round, the round it stops at, and the gain of each feature."""
    _, model = _boosted(spark, sf_dir)
    rounds = model.rounds.select(F.lit("auc").alias("what"), F.col("round").cast("string").alias("name"), F.col("auc").alias("value"))
    best = model.rounds.where(F.col("round") == model.best).select(F.lit("best"), F.col("round").cast("string"), "auc")
    return rounded(rounds.unionByName(best.toDF("what", "name", "value")).unionByName(model.importance.select(F.lit("gain").alias("what"), F.col("feature").alias("name"), F.col("gain").alias("value"))))


@query("""WITH n AS (SELECT DISTINCT customer_id, article_id FROM train), du AS (SELECT customer_id, count(*) AS d FROM n GROUP BY 1), di AS (SELECT article_id, count(*) AS d FROM n GROUP BY 1),
    e AS (SELECT vec_id AS article_id, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings),
    u AS (SELECT n.customer_id, e.pos, sum(e.x / sqrt(CAST(du.d AS DOUBLE) * di.d)) AS x FROM n JOIN du ON n.customer_id = du.customer_id JOIN di ON n.article_id = di.article_id JOIN e ON n.article_id = e.article_id GROUP BY 1, 2)
    SELECT customer_id, pos, round(x / 2, 6) + 0e0 AS x FROM u""")
def graph_propagation(spark, sf_dir):
    """User vectors after one layer that starts from item vectors alone."""
    s = Shop(spark, sf_dir)
    items = s.vectors.select("article_id", F.posexplode("v").alias("pos", "x")).select("article_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))
    nobody = items.where("false")
    own, _ = ml.propagated(ml.normalized_edges(s.train), nobody, items, layers=1)
    return rounded(own)


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z, CAST(embedding[2] AS DOUBLE) AS o, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings)
    SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(ln(1 + exp(-abs(z - o))) + greatest(o - z, 0)), 6) AS bpr FROM p""")
def losses(spark, sf_dir):
    z, o, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.when(F.col("label") < 5, 1).otherwise(0)
    return rounded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.avg(ml.binary_cross_entropy(z, y)).alias("bce"), F.avg(ml.pairwise_loss(z, o)).alias("bpr")))


# events as a stream, run over all that is there

@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, sf_dir):
    """The stream's plan over the table as a batch: the same windows and sums."""
    from ..streaming import events

    own = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(events.hourly(own), 4).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    from ..streaming import events

    own = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(own).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT CAST(label AS BIGINT) AS label, CAST(least(count(*), 20) AS BIGINT) AS n FROM embeddings GROUP BY label")
def stratified_sample(spark, sf_dir):
    """Size of each label's part of a sample of twenty each."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return rounded(candidates.stratified(rows, "label", "vec_id", 20).groupBy("label").agg(F.count("*").alias("n")))


@query("""WITH p AS (SELECT DISTINCT least(x.article_id, y.article_id) AS a, greatest(x.article_id, y.article_id) AS b FROM val x JOIN val y ON x.customer_id = y.customer_id AND x.article_id < y.article_id)
    SELECT least(i.product_type_name, j.product_type_name) AS type_a, greatest(i.product_type_name, j.product_type_name) AS type_b, count(*) AS n FROM p JOIN articles i ON p.a = i.article_id JOIN articles j ON p.b = j.article_id GROUP BY 1, 2 ORDER BY n DESC, type_a, type_b LIMIT 10""")
def pair_types(spark, sf_dir):
    s = Shop(spark, sf_dir)
    x, y = s.val.select("customer_id", F.col("article_id").alias("a")), s.val.select("customer_id", F.col("article_id").alias("b"))
    pairs = x.join(y, "customer_id").where("a < b").select("a", "b").distinct()
    return analysis.pair_types(pairs, s.articles.select("article_id", "product_type_name"))


@query("""WITH a AS (SELECT customer_id, count(*) AS n FROM train GROUP BY customer_id) SELECT profile_source, count(*) AS n FROM (SELECT CASE WHEN n >= 5 THEN 'model' ELSE 'template' END AS profile_source FROM a) x GROUP BY 1""")
def merged_profiles(spark, sf_dir):
    """Number of profiles by the source of their text: active users have their own."""
    s = Shop(spark, sf_dir)
    base = profiles.base_profiles(s.train, s.articles)
    active = profiles.profile_texts(base.where("n_purchases >= 5"))
    own = profiles.merged_profiles(base, active, profiles.sparse_profiles(base, s.train, s.fk, "l2_style_mood"))
    return own.groupBy("profile_source").agg(F.count("*").alias("n"))
