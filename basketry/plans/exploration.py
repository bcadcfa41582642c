"""Exploration of transactions, articles and customers: one SQL plan for each report."""

from __future__ import annotations

from .sql import TRAIN_END, VAL_END, Dialect, Plan

PLANS: dict[str, Plan] = {}


def plan(f: Plan) -> Plan:
    PLANS[f.__name__] = f
    return f


@plan
def raw_validation(d: Dialect) -> str:
    return """SELECT 'transactions' AS name, count(*) AS n_rows, min(t_dat) AS first_day, max(t_dat) AS last_day FROM txn
        UNION ALL SELECT 'articles', count(*), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM articles
        UNION ALL SELECT 'customers', count(*), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM customers"""


@plan
def split_assignment(d: Dialect) -> str:
    return f"""SELECT CASE WHEN t_dat <= DATE '{TRAIN_END}' THEN 'Train' WHEN t_dat <= DATE '{VAL_END}' THEN 'Val' ELSE 'Test' END AS split,
        count(*) AS n, count(DISTINCT customer_id) AS users, count(DISTINCT article_id) AS items, min(t_dat) AS first_day, max(t_dat) AS last_day
        FROM txn GROUP BY 1"""


@plan
def split_statistics(d: Dialect) -> str:
    return """SELECT (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM val) AS n_val, (SELECT count(*) FROM test) AS n_test,
        (SELECT count(DISTINCT customer_id) FROM val v WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.customer_id = v.customer_id)) AS cold_users,
        (SELECT count(DISTINCT article_id) FROM val v WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.article_id = v.article_id)) AS cold_items,
        (SELECT count(DISTINCT customer_id) FROM val WHERE customer_id IN (SELECT customer_id FROM train)) AS common_users,
        (SELECT count(DISTINCT article_id) FROM val WHERE article_id IN (SELECT article_id FROM train)) AS common_items"""


@plan
def activity_groups(d: Dialect) -> str:
    active, sparse = 30, 12  # least numbers of purchases; users below the second are left out
    return f"""SELECT customer_id, count(*) AS n, CASE WHEN count(*) >= {active} THEN 'active' ELSE 'sparse' END AS activity FROM train GROUP BY customer_id HAVING count(*) >= {sparse}"""


@plan
def null_counts(d: Dialect) -> str:
    return """SELECT CAST(sum(CASE WHEN age IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS age_nulls,
        CAST(sum(CASE WHEN club_member_status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS club_nulls,
        CAST(sum(CASE WHEN fashion_news_frequency IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS news_nulls, count(*) AS n FROM customers"""


@plan
def price_summary(d: Dialect) -> str:
    return "SELECT min(price) AS least, max(price) AS most, round(avg(price), 4) AS mean, median(price) AS middle FROM txn"


@plan
def sparsity(d: Dialect) -> str:
    return """WITH p AS (SELECT DISTINCT customer_id, article_id FROM txn),
        n AS (SELECT count(*) AS pairs, count(DISTINCT customer_id) AS users, count(DISTINCT article_id) AS items FROM p)
        SELECT pairs, users, items, round(1e0 - pairs / (CAST(users AS DOUBLE) * items), 8) AS sparsity FROM n"""


@plan
def item_lifecycle(d: Dialect) -> str:
    return f"""WITH life AS (SELECT article_id, {d.days("min(t_dat)", "max(t_dat)")} AS days, count(*) AS n FROM txn GROUP BY article_id)
        SELECT count(*) AS items, round(avg(days), 6) AS mean_days, round(avg(CASE WHEN days <= 30 THEN 1e0 ELSE 0e0 END), 6) AS upto_30,
        round(avg(CASE WHEN days >= 365 THEN 1e0 ELSE 0e0 END), 6) AS from_365, round(avg(CASE WHEN days = 0 THEN 1e0 ELSE 0e0 END), 6) AS one_day FROM life"""


@plan
def monthly_new_items(d: Dialect) -> str:
    return """WITH f AS (SELECT article_id, min(t_dat) AS first_day FROM txn GROUP BY article_id)
        SELECT CAST(date_trunc('month', first_day) AS DATE) AS month, count(*) AS new_items FROM f GROUP BY 1"""


@plan
def behaviour_by_age(d: Dialect) -> str:
    return """WITH a AS (SELECT customer_id, CASE WHEN age < 20 THEN '10s' WHEN age < 30 THEN '20s' WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s'
        WHEN age < 60 THEN '50s' ELSE '60+' END AS age_group FROM customers WHERE age IS NOT NULL)
        SELECT a.age_group, count(*) AS n, count(DISTINCT t.customer_id) AS users, round(count(*) * 1e0 / count(DISTINCT t.customer_id), 6) AS per_user, round(avg(price), 4) AS mean_price
        FROM txn t JOIN a ON t.customer_id = a.customer_id GROUP BY a.age_group"""


@plan
def behaviour_by_club(d: Dialect) -> str:
    return """SELECT coalesce(c.club_member_status, 'NULL') AS club, count(*) AS n, count(DISTINCT t.customer_id) AS users, round(count(*) * 1e0 / count(DISTINCT t.customer_id), 6) AS per_user,
        round(avg(price), 4) AS mean_price FROM txn t JOIN customers c ON t.customer_id = c.customer_id GROUP BY 1"""


@plan
def daily_sales(d: Dialect) -> str:
    return "SELECT t_dat, count(*) AS n, count(DISTINCT customer_id) AS users, round(sum(price), 2) AS revenue FROM txn GROUP BY t_dat"


@plan
def weekday_means(d: Dialect) -> str:
    return f"""WITH day AS (SELECT t_dat, count(*) AS n FROM txn GROUP BY t_dat)
        SELECT {d.isodow("t_dat")} AS weekday, round(avg(n), 6) AS mean_n FROM day GROUP BY 1"""


@plan
def rolling_means(d: Dialect) -> str:
    over = lambda a, b: f"(ORDER BY t_dat ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
    return f"""WITH day AS (SELECT t_dat, count(*) AS n FROM txn GROUP BY t_dat)
        SELECT t_dat, n, CASE WHEN count(n) OVER {over(3, 3)} = 7 THEN round(avg(n) OVER {over(3, 3)}, 6) END AS mean_7,
        CASE WHEN count(n) OVER {over(15, 14)} = 30 THEN round(avg(n) OVER {over(15, 14)}, 6) END AS mean_30 FROM day"""


@plan
def monthly_sales(d: Dialect) -> str:
    return "SELECT CAST(date_trunc('month', t_dat) AS DATE) AS month, count(*) AS n, round(avg(price), 4) AS mean_price FROM txn GROUP BY 1"


@plan
def channel_volume(d: Dialect) -> str:
    return "SELECT sales_channel_id, count(*) AS n, round(avg(price), 4) AS mean_price, round(count(*) * 1e0 / (SELECT count(*) FROM txn), 6) AS share FROM txn GROUP BY sales_channel_id"


@plan
def monthly_by_channel(d: Dialect) -> str:
    return """SELECT CAST(date_trunc('month', t_dat) AS DATE) AS month, count(*) FILTER (WHERE sales_channel_id = 1) AS channel_1,
        count(*) FILTER (WHERE sales_channel_id = 2) AS channel_2 FROM txn GROUP BY 1"""


@plan
def top_types(d: Dialect) -> str:
    return """SELECT a.product_type_name, count(*) AS n FROM txn t JOIN articles a ON t.article_id = a.article_id GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""


@plan
def monthly_top_types(d: Dialect) -> str:
    return """WITH top AS (SELECT a.product_type_name AS type, count(*) AS n FROM txn t JOIN articles a ON t.article_id = a.article_id GROUP BY 1 ORDER BY n DESC, type LIMIT 5)
        SELECT CAST(date_trunc('month', t.t_dat) AS DATE) AS month, a.product_type_name AS type, count(*) AS n FROM txn t JOIN articles a ON t.article_id = a.article_id
        WHERE a.product_type_name IN (SELECT type FROM top) GROUP BY 1, 2"""


@plan
def sales_by_index(d: Dialect) -> str:
    return "SELECT coalesce(a.index_name, 'UNKNOWN') AS index_name, count(*) AS n, count(DISTINCT t.article_id) AS items FROM txn t JOIN articles a ON t.article_id = a.article_id GROUP BY 1"


@plan
def top_combinations(d: Dialect) -> str:
    return """SELECT a.product_type_name || ' + ' || a.colour_group_name AS combo, count(*) AS n FROM txn t JOIN articles a ON t.article_id = a.article_id
        GROUP BY 1 ORDER BY n DESC, combo LIMIT 10"""


@plan
def basket_sizes(d: Dialect) -> str:
    return """WITH b AS (SELECT customer_id, t_dat, count(*) AS n FROM txn GROUP BY customer_id, t_dat)
        SELECT count(*) AS baskets, round(avg(n), 6) AS mean_n, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS single, round(avg(CASE WHEN n > 1 THEN 1e0 ELSE 0e0 END), 6) AS several, max(n) AS most FROM b"""


@plan
def co_purchases(d: Dialect) -> str:
    return """WITH multi AS (SELECT customer_id, t_dat FROM txn GROUP BY customer_id, t_dat HAVING count(*) > 1),
        b AS (SELECT DISTINCT t.customer_id, t.t_dat, a.product_type_name AS type FROM txn t JOIN multi m ON t.customer_id = m.customer_id AND t.t_dat = m.t_dat
            JOIN articles a ON t.article_id = a.article_id)
        SELECT x.type AS type_a, y.type AS type_b, count(*) AS n FROM b x JOIN b y ON x.customer_id = y.customer_id AND x.t_dat = y.t_dat AND x.type < y.type GROUP BY 1, 2"""


@plan
def repeat_purchases(d: Dialect) -> str:
    return """WITH p AS (SELECT customer_id, article_id, count(*) AS n FROM txn GROUP BY 1, 2)
        SELECT count(*) AS pairs, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS once, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS again FROM p"""


@plan
def types_per_user(d: Dialect) -> str:
    return "SELECT t.customer_id, count(DISTINCT a.product_type_name) AS n_types FROM txn t JOIN articles a ON t.article_id = a.article_id GROUP BY t.customer_id"


@plan
def user_recency(d: Dialect) -> str:
    return f"SELECT customer_id, {d.days('max(t_dat)', f'DATE {chr(39)}{TRAIN_END}{chr(39)}')} AS days_since FROM train GROUP BY customer_id"


@plan
def dashboard(d: Dialect) -> str:
    parts = ("train", "val", "test")
    users = ", ".join(f"{p}_u AS (SELECT DISTINCT customer_id AS k FROM {p})" for p in parts)
    items = ", ".join(f"{p}_i AS (SELECT DISTINCT article_id AS k FROM {p})" for p in parts)
    count = lambda what, name: f"(SELECT count(*) FROM {what}) AS {name}"
    counts = [count(f"{p}_u", f"{p}_users") for p in parts] + [count(f"{p}_i", f"{p}_items") for p in parts]
    for p in parts[1:]:
        new = lambda of: f"{p}_{of} x WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM train_{of} t WHERE t.k = x.k)"  # noqa: B023, E731
        counts += [count(f"train_u WHERE k IN (SELECT k FROM {p}_u)", f"train_{p}_users"), count(new("u"), f"{p}_new_users"), count(new("i"), f"{p}_new_items")]
    return f"WITH {users}, {items} SELECT {', '.join(counts)}"


@plan
def cardinality_profile(d: Dialect) -> str:
    columns = ("product_code", "product_type_name", "colour_group_name", "garment_group_name", "section_name", "index_name")
    long = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v FROM articles" for c in columns)
    return f"""WITH l AS ({long}), n AS (SELECT name, v, count(*) AS c FROM l WHERE v IS NOT NULL GROUP BY name, v),
        r AS (SELECT name, v, c, row_number() OVER (PARTITION BY name ORDER BY c DESC, v) AS k FROM n)
        SELECT s.name, s.n_unique, s.n_null, r.v AS top_value, round(r.c * 1e0 / s.n, 6) AS top_share
        FROM (SELECT name, count(DISTINCT v) AS n_unique, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, count(*) AS n FROM l GROUP BY name) s
        JOIN r ON r.name = s.name AND r.k = 1"""


@plan
def variants_per_product(d: Dialect) -> str:
    return """WITH s AS (SELECT product_code, count(*) AS n FROM articles GROUP BY product_code)
        SELECT count(*) AS products, round(avg(n), 6) AS mean_n, max(n) AS most, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS one,
        round(avg(CASE WHEN n = 2 THEN 1e0 ELSE 0e0 END), 6) AS two, round(avg(CASE WHEN n >= 3 THEN 1e0 ELSE 0e0 END), 6) AS more FROM s"""


@plan
def product_consistency(d: Dialect) -> str:
    return """WITH s AS (SELECT product_code, count(DISTINCT index_name) AS n_index, count(DISTINCT product_type_name) AS n_type FROM articles GROUP BY product_code)
        SELECT count(*) AS products, CAST(sum(CASE WHEN n_index <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_index, CAST(sum(CASE WHEN n_index = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_index,
        CAST(sum(CASE WHEN n_type <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_type FROM s"""


@plan
def crosstab_shares(d: Dialect) -> str:
    return """WITH n AS (SELECT garment_group_name, coalesce(index_name, 'UNKNOWN') AS index_name, count(*) AS c FROM articles GROUP BY 1, 2)
        SELECT garment_group_name, index_name, c, round(c * 1e0 / sum(c) OVER (PARTITION BY garment_group_name), 6) AS share FROM n"""


@plan
def coverage_cube(d: Dialect) -> str:
    return """WITH a AS (SELECT CASE WHEN f.article_id IS NULL THEN 'missing' ELSE 'present' END AS facts, CASE WHEN a.index_name IS NULL THEN 'missing' ELSE 'present' END AS idx
        FROM articles a LEFT JOIN fk f ON a.article_id = f.article_id)
        SELECT coalesce(facts, 'all') AS facts, coalesce(idx, 'all') AS idx, count(*) AS n FROM a GROUP BY CUBE (facts, idx)"""


@plan
def missing_types(d: Dialect) -> str:
    return """WITH m AS (SELECT a.product_type_name AS type FROM articles a LEFT JOIN fk f ON a.article_id = f.article_id WHERE f.article_id IS NULL), n AS (SELECT type, count(*) AS n FROM m GROUP BY type)
        SELECT type, n, round(n * 1e0 / (SELECT count(*) FROM m), 6) AS share FROM n ORDER BY n DESC, type LIMIT 10"""


@plan
def co_occurrence(d: Dialect) -> str:
    return """WITH u AS (SELECT DISTINCT t.customer_id, a.section_name AS s FROM txn t JOIN articles a ON t.article_id = a.article_id),
        n AS (SELECT s, count(*) AS c FROM u GROUP BY s),
        p AS (SELECT x.s AS a, y.s AS b, count(*) AS c FROM u x JOIN u y ON x.customer_id = y.customer_id GROUP BY 1, 2)
        SELECT p.a, p.b, p.c AS n, round(p.c / sqrt(CAST(i.c AS DOUBLE) * j.c), 6) AS cosine FROM p JOIN n i ON p.a = i.s JOIN n j ON p.b = j.s"""


@plan
def purchase_quantiles(d: Dialect) -> str:
    q = ", ".join(f"{d.percentile('n', p)} AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    return f"WITH u AS (SELECT customer_id, count(*) AS n FROM txn GROUP BY customer_id) SELECT {q}, round(avg(n), 6) AS mean_n FROM u"


@plan
def user_segments(d: Dialect) -> str:
    return """WITH u AS (SELECT customer_id, count(*) AS n FROM txn GROUP BY customer_id),
        g AS (SELECT CASE WHEN n < 5 THEN 'Light' WHEN n < 28 THEN 'Moderate' ELSE 'Heavy' END AS segment, n FROM u)
        SELECT segment, count(*) AS users, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS user_share, round(CAST(sum(n) AS DOUBLE) / CAST(sum(sum(n)) OVER () AS DOUBLE), 6) AS txn_share FROM g GROUP BY segment"""


@plan
def club_segments(d: Dialect) -> str:
    return """SELECT CASE WHEN club_member_status = 'ACTIVE' AND fashion_news_frequency = 'Regularly' THEN 'engaged' WHEN club_member_status = 'ACTIVE' THEN 'member'
        ELSE 'other' END AS segment, count(*) AS n, round(avg(age), 6) AS mean_age FROM customers GROUP BY 1"""


@plan
def item_coverage(d: Dialect) -> str:
    return """WITH s AS (SELECT article_id, count(*) AS c FROM txn GROUP BY article_id)
        SELECT CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS once, CAST(sum(CASE WHEN c < 10 THEN 1 ELSE 0 END) AS BIGINT) AS few, CAST(sum(CASE WHEN c >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS many, count(*) AS items FROM s"""


@plan
def lifespan_by_type(d: Dialect) -> str:
    return f"""WITH life AS (SELECT article_id, {d.days("min(t_dat)", "max(t_dat)")} AS days FROM txn GROUP BY article_id)
        SELECT a.product_type_name, round(avg(l.days), 6) AS mean_days, count(*) AS n FROM articles a LEFT JOIN life l ON a.article_id = l.article_id
        GROUP BY 1 HAVING count(*) >= 10 ORDER BY mean_days DESC NULLS LAST, 1 LIMIT 15"""


@plan
def text_statistics(d: Dialect) -> str:
    words = "length(trim(text)) - length(replace(trim(text), ' ', '')) + 1"
    return f"""SELECT count(*) AS n, round(avg(CASE WHEN text IS NULL THEN 1e0 ELSE 0e0 END), 6) AS nulls, round(avg(CASE WHEN length(text) < 20 THEN 1e0 ELSE 0e0 END), 6) AS short,
        round(avg(CASE WHEN length(text) > 100 THEN 1e0 ELSE 0e0 END), 6) AS long, {d.percentile("length(text)", 0.5)} AS median_chars, {d.percentile(words, 0.5)} AS median_words FROM documents"""


@plan
def text_length_by_source(d: Dialect) -> str:
    return "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY source HAVING count(*) >= 40 ORDER BY mean_chars DESC, source LIMIT 15"


@plan
def keyword_hits(d: Dialect) -> str:
    words = ("license", "token", "the", "que")
    hits = ", ".join(f"CAST(sum(CASE WHEN lower(text) LIKE '%{w}%' THEN 1 ELSE 0 END) AS BIGINT) AS n_{w}" for w in words)
    return f"SELECT {hits}, count(*) AS n FROM documents"


@plan
def top_item_per_type(d: Dialect) -> str:
    return """WITH c AS (SELECT a.product_type_name AS type, t.article_id, count(*) AS n FROM txn t JOIN articles a ON t.article_id = a.article_id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, article_id) AS k FROM c) SELECT type, article_id, n FROM r WHERE k = 1"""


@plan
def binned_behaviour(d: Dialect) -> str:
    return """WITH u AS (SELECT customer_id, count(*) AS n, avg(price) AS p FROM txn GROUP BY customer_id),
        b AS (SELECT CASE WHEN n < 20 THEN '1-19' WHEN n < 40 THEN '20-39' WHEN n < 60 THEN '40-59' ELSE '60+' END AS bin, p FROM u)
        SELECT bin, count(*) AS n, round(avg(p), 4) AS mean_price, round(stddev_samp(p), 4) AS sd FROM b GROUP BY bin HAVING count(*) >= 5"""
