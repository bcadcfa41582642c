"""Steps that had to stay small on large tables: what they send, and that nothing is lost by it."""

import numpy as np
from pyspark.sql import functions as F

from basketry.operators import analysis, candidates, factors, ml, nearest, ordering, segmentation


def frame(spark, m, id="id"):
    return spark.createDataFrame([(k, row) for k, row in enumerate(m.tolist())], f"{id} long, v array<double>")


def test_distances_are_taken_where_blocks_are_met(spark):
    m = np.random.default_rng(1).normal(size=(120, 5)).astype(np.float32).astype(float)
    m[100:] = m[:20]
    near = nearest.nearest(frame(spark, m), "id", "v", 4, 16)
    assert "Join" not in near._jdf.queryExecution().toString()  # no vector travels to its pairs
    d = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(d, np.inf)
    want = {(a, int(b)): d[a, b] for a in range(120) for b in np.lexsort((np.arange(120), d[a]))[:4]}
    got = {(r.a, r.b): r.distance for r in near.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_blocks_travel_in_single_precision_only_if_exact(spark):
    m = np.random.default_rng(2).normal(size=(30, 3))
    kind = lambda x: nearest.packed(frame(spark, x), "id", "v", 16).schema["m"].dataType.elementType.typeName()
    assert (kind(m), kind(m.astype(np.float32).astype(float))) == ("double", "float")


def test_what_a_query_may_not_have_is_left_out_in_the_search(spark):
    rng = np.random.default_rng(3)
    m, q = rng.normal(size=(90, 4)), rng.normal(size=(12, 4))
    skip = [sorted(rng.choice(90, k * 7, replace=False).tolist()) for k in range(12)]
    asked = spark.createDataFrame([(k, row, skip[k]) for k, row in enumerate(q.tolist())], "u long, v array<double>, skip array<long>")
    top, _ = nearest.searched(asked, nearest.packed(frame(spark, m), "id", "v", 8), 15, "u", "v", skip="skip")
    s = np.round(q @ m.T, 9)
    want = {(u, p + 1, int(i)) for u in range(12) for p, i in enumerate([i for i in np.lexsort((np.arange(90), -s[u])) if i not in skip[u]][:15])}
    assert {(r.user, r.place, r.id) for r in top.collect()} == want


def test_als_searches_blocks_in_place_of_all_pairs(spark):
    rows = [(u, int(i)) for u in range(30) for i in np.random.default_rng(u).choice(40, 1 + u % 9, replace=False)]
    txn = spark.createDataFrame(rows, "customer_id long, article_id long")
    top = ml.als_recommendations(txn, k=5, rank=4)
    plan = top._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" not in plan
    got = top.collect()
    assert len(got) == 30 * 5 and not {(r.customer_id, r.article_id) for r in got} & set(rows)
    assert [c for c, _ in top.dtypes] == ["customer_id", "article_id", "score", "place"]


def test_recommended_are_the_best_never_bought(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(9, 3)), rng.normal(size=(25, 3))
    bought = [(a, int(b)) for a in range(9) for b in rng.choice(25, 1 + 2 * a, replace=False)]
    named = lambda m: frame(spark, m).withColumnRenamed("v", "f")
    top = factors.recommended(spark.createDataFrame(bought, "customer_id long, article_id long"), named(u), named(v), k=6)
    s = np.round(u @ v.T, 9)
    want = {(a, p + 1, int(b)) for a in range(9) for p, b in enumerate([b for b in np.lexsort((np.arange(25), -s[a])) if (a, b) not in bought][:6])}
    assert {(r.customer_id, r.place, r.article_id) for r in top.collect()} == want


def test_settled_tables_go_with_their_scratch(spark):
    import pytest

    with ordering.scratch(spark) as keep:
        gone = ordering.settled(spark.range(3).select(F.col("id")))
        stays = keep(ordering.settled(spark.range(4).select(F.col("id"))))
        assert gone.count() == 3
    assert stays.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(gone._settled_path).count()


def test_pairs_meet_vectors_in_slices(spark, monkeypatch):
    from basketry.operators import analysis

    vectors = frame(spark, np.arange(40, dtype=float).reshape(20, 2), "article_id")
    users = spark.createDataFrame([(1, [1.0, 0.0])], "customer_id long, centroid array<double>")
    pairs = spark.createDataFrame([(u, a) for u in (1, 2) for a in [*range(25), None]], "customer_id long, article_id long")
    want = sorted(map(str, analysis.with_both(pairs, users, vectors, pairs, "left").collect()))
    monkeypatch.setattr(analysis, "VECTOR_BYTES", 200)
    cut = analysis.with_both(pairs, users, vectors, pairs, "left")
    assert sorted(map(str, cut.collect())) == want and len(want) == 52
    assert "Union" in cut._jdf.queryExecution().toString()


def test_centroids_take_one_row_of_sums_a_user(spark):
    from basketry.operators import analysis

    vectors = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 4.0]), (3, None)], "article_id long, v array<double>")
    history = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3)], "customer_id long, article_id long")
    own = analysis.centroids(history, vectors)
    assert "Generate" not in own._jdf.queryExecution().toString()
    rows = own.collect()
    assert [(r.customer_id, r.n, [round(x, 6) for x in r.centroid]) for r in rows] == [(1, 3, [0.6, 0.8])]


def test_topic_words_count_only_pairs_that_can_be_frequent(spark, monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(4)
    names = [f"w{k:02d}" for k in range(40)]
    docs = [(k, f"t{k % 3}", " ".join(names[min(39, int(x))] for x in rng.exponential(6, 30))) for k in range(60)]
    df = spark.createDataFrame([*docs, (99, None, "w00 w01 w00 w01"), (98, "t0", None), (97, "t1", "w")], "id long, topic string, text string")
    stored = []
    monkeypatch.setattr(ml, "settled", lambda rows: stored.append(ordering.settled(rows)) or stored[-1])
    got = {(r.topic, r.place): r.term for r in ml.topic_words(df, "topic", "text", 5, words=12).collect()}
    n = Counter()
    for r in df.collect():
        w = [x for x in (r.text or "").split() if len(x) > 1]
        n.update((r.topic, t) for t in [*w, *map(" ".join, zip(w, w[1:], strict=False))])
    total, topics = Counter(), Counter(t for _, t in n)
    for (_, t), c in n.items():
        total[t] += c
    top = sorted((t for t in total if topics[t] >= 2), key=lambda t: (-total[t], t))[:12]
    weight = lambda k, t: n[k, t] * (np.log(5 / (1 + topics[t])) + 1)
    want = {(k, p + 1): t for k in (None, "t0", "t1", "t2") for p, t in enumerate(sorted((t for t in top if n[k, t]), key=lambda t: (-round(weight(k, t), 9), t))[:5])}
    assert got == want
    words = {t for t in total if " " not in t}
    first = set(sorted((t for t in words if topics[t] >= 2), key=lambda t: (-total[t], t))[:12])
    pairs = [r.term for r in stored[-1].where("term like '% %'").collect()]
    assert pairs and all(p.split()[0] in first for p in pairs) and len(set(pairs)) < len(total) - len(words)


def test_purchases_are_dealt_by_user_once(spark):
    from basketry.operators import profiles
    from test_texts import shop

    facts, txn, articles = shop(spark)
    deals = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(customer_id")
    own = profiles.tastes(txn.withColumn("t_dat", F.col("t_dat").cast("date")), articles.join(facts, "article_id", "full"), ["product_type_name", "l3_color_harmony"])
    assert deals(own) == 1
    got, w = {r.customer_id: r for r in own.collect()}, [1.0, 2 ** (-1 / 90), 2 ** (-2 / 90)]
    p = (w[0] + w[2]) / sum(w)
    h = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
    assert abs(got[7].product_type_name["Dress"] - p) < 1e-9 and got[7].l3_color_harmony == {"Neon": 1.0} and abs(got[7].diversity - h) < 1e-9
    assert abs(got[7].avg_price - 1) < 1e-12 and abs(got[7].online_ratio - 2 / 3) < 1e-12
    assert got[8].product_type_name is None and got[8].diversity is None and got[8].online_ratio == 0
    standing = spark.createDataFrame([(7, 0.918, 4)], "customer_id long, diversity double, quintile int")
    assert deals(profiles.request_messages(txn, articles, facts, standing, {}, 2)) <= 2


def test_numbers_of_clusters_are_chosen_on_all_rows(spark):
    n = 50_400  # above this, silhouettes were taken on some 50,000 rows
    own = ordering.settled(spark.range(n).toDF("customer_id").select("customer_id", F.array((F.xxhash64("customer_id") % 1000 / 7.0).alias("x"), (F.col("customer_id") % 3 * 90.0)).alias("v")))
    found, scores = segmentation.clustered(own, "v", [3])
    assert found.count() == n and scores.first().silhouette == ml.silhouettes(own, "v", [3]).first().silhouette


def test_search_ends_where_no_wanted_article_can_be_among_the_best(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(300, 6)) + 4 * rng.integers(0, 5, 300)[:, None]
    m[200:220] = m[:20]
    bought = [(u, int(i)) for u in range(400) for i in rng.choice(300, 3)] + [(90, 1), (91, 999)]
    later = [(u, int(i)) for u in range(400) for i in rng.choice(330, 4)] + [(k, int(i)) for k in range(10) for i in rng.choice(300, 60)] + [(91, 5), (92, 5)]
    pairs = lambda x: spark.createDataFrame(x, "customer_id long, article_id long")
    v = frame(spark, m, "article_id")
    every = analysis.retrieved(analysis.centroids(pairs(bought), v), v, 12, block=16)
    some = analysis.retrieved_of(pairs(later), pairs(bought), v, 12, block=16)
    hits = lambda top: {(r.customer_id, r.article_id, r.place) for r in top.collect()} & {(u, i, p) for u, i in later for p in range(1, 13)}
    assert hits(some) == hits(every) and len(hits(every)) > 10
    assert {tuple(r) for r in some.collect()} <= {tuple(r) for r in every.collect()}  # no list is cut, no block is met twice
    assert some.select("customer_id").distinct().count() < 300  # those left are no more than may have a hit
    n = {r.customer_id: r.n for r in analysis.centroids(pairs(bought), v).collect()}
    assert {r.customer_id: r.n for r in analysis.activity(pairs(bought), v).collect()} == n


def test_a_customer_is_dealt_once_and_products_meet_few_siblings(spark):
    rng = np.random.default_rng(12)
    rows = [(int(rng.integers(0, 30)), int(a), int(d)) for a, d in zip(rng.integers(0, 400, 300), rng.integers(0, 6, 300), strict=True)]
    txn = spark.createDataFrame(rows, "customer_id long, article_id long, d int").selectExpr("customer_id", "article_id", "date_add(DATE '2000-01-01', d) AS t_dat")
    articles = spark.range(400).selectExpr("id AS article_id", "CASE WHEN id % 7 = 6 THEN NULL ELSE CONCAT('p', id % 7) END AS product_code")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = candidates.repurchase(txn, articles, txn, 9)
    dealt = plan(top)
    own, last = {}, {}
    for u, a, d in rows:
        if a % 7 < 6:
            own[u, a] = own.get((u, a), 0) + 1
            last[u, a] = max(last.get((u, a), 0), d)
    best = {}
    for (u, a), n in own.items():
        for b in range(a % 7, 400, 7):
            x, y = best.get((u, b), (0, 0))
            best[u, b] = max(x, n if a == b else n / 2), max(y, last[u, a])
    want = {(u, p + 1, a) for u in {u for u, _ in best} for p, a in enumerate(sorted((a for v, a in best if v == u), key=lambda a: (-best[u, a][0], -best[u, a][1], a))[:9])}
    assert {(r.customer_id, r.place, r.article_id) for r in top.collect()} == want
    assert dealt.count("Exchange hashpartitioning") == 1  # siblings are few and broadcast, what is left is dealt by customer
    sources = [spark.range(20).selectExpr(f"id % {m} AS customer_id", "id AS article_id", "1e0 AS score") for m in (3, 4)]
    assert plan(candidates.blend(sources, 2)).count("Exchange hashpartitioning") == 1
