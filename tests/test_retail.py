"""Hand-computed cases of the retail operators."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators import analysis, attributes, candidates, features, metrics, ml, profiles, quality, segments
from basketry.sources import tables
from basketry.streaming import events

DAY = dt.date(2020, 6, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def txn(spark):
    rows = [("u1", "a1", 0, 1.0, 2), ("u1", "a1", 5, 3.0, 1), ("u1", "a2", 9, 2.0, 2), ("u2", "a2", 9, 4.0, 1), ("u3", "zz", 9, 4.0, 1)]
    return spark.createDataFrame([(u, a, day(d), p, c) for u, a, d, p, c in rows], "customer_id string, article_id string, t_dat date, price double, sales_channel_id int")


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([("a1", "T1", "p1", "c"), ("a2", "T2", "p1", "d"), ("a3", "T2", None, None)], "article_id string, product_type_name string, product_code string, colour_group_name string")


def test_user_statistics_drop_unknown_articles(txn, articles):
    out = {r.customer_id: r for r in features.user_statistics(txn, articles, str(day(10))).collect()}
    assert set(out) == {"u1", "u2"}
    assert (out["u1"].n_purchases, out["u1"].avg_price, out["u1"].n_types, out["u1"].days_since_first, out["u1"].days_since_last) == (3, 2.0, 2, 10, 1)
    assert out["u1"].price_std == 1.0 and out["u2"].price_std == 0.0 and abs(out["u1"].online_ratio - 2 / 3) < 1e-12


def test_age_bins_and_codes(spark):
    df = spark.createDataFrame([(None,), (17,), (18,), (64,), (65,), (150,)], "age int")
    assert [r[0] for r in df.select(C.binned(F.col("age"), features.AGE_EDGES)).collect()] == [0, 1, 2, 6, 7, 0]
    assert [r[0] for r in spark.createDataFrame([(None,), ("A",), ("B",), ("?",)], "x string").select(C.encoded(F.col("x"), ["-", "A", "B"], 4)).collect()] == [0, 1, 2, 4]


def test_dense_ids_follow_the_order(spark):
    df = spark.createDataFrame([(f"{k:04d}",) for k in range(500)] * 2, "k string").repartition(7)
    assert [(r.k, r.i) for r in features.dense_ids(df, "k", "i").orderBy("i").collect()] == [(f"{k:04d}", k) for k in range(500)]


def test_sequences_are_padded_left_and_cut_right(txn, articles):
    ids = features.dense_ids(articles, "article_id", "item_idx")
    out = {r.customer_id: (r.n, r["items"]) for r in features.sequences(txn, ids, 2).collect()}
    assert out == {"u1": (2, [1, 2]), "u2": (1, [0, 2])}


def test_train_pairs_avoid_purchases(spark):
    txn = spark.createDataFrame([(u, u * 3 + k) for u in range(10) for k in range(3)], "customer_id long, article_id long")
    items = spark.createDataFrame([(k,) for k in range(60)], "article_id long")
    rows = features.train_pairs(txn, items).collect()
    bought = {(r.customer_id, r.article_id) for r in rows if r.label == 1}
    assert len(bought) == 30 and sum(r.label == 0 for r in rows) == 120
    assert not bought & {(r.customer_id, r.article_id) for r in rows if r.label == 0}


def test_train_pairs_of_heavy_customers_are_whole(spark):
    """Customers who bought two thirds of the catalogue, all but one article, or all of it."""
    most = {1: 6000, 2: 8999, 3: 9000, 4: 2}
    txn = spark.createDataFrame([(u, (k * 7) % 9000) for u, n in most.items() for k in range(n) if u != 1 or k % 20 == 0 or k < 5000], "customer_id long, article_id long")
    items = spark.createDataFrame([(k,) for k in range(9000)], "article_id long")
    out = features.train_pairs(txn, items)
    bought = txn.distinct().groupBy("customer_id").count()
    got = {r.customer_id: r.n for r in out.where("label = 0").groupBy("customer_id").agg(F.count("*").alias("n")).collect()}
    assert got == {r.customer_id: 4 * r["count"] for r in bought.collect() if r.customer_id != 3}
    assert out.where("label = 0").join(txn, ["customer_id", "article_id"], "left_semi").count() == 0
    spread = out.where("label = 0 and customer_id = 1").select("article_id").distinct().count()
    assert spread > 0.9 * (9000 - bought.where("customer_id = 1").first()["count"])


def test_discriminability_takes_the_samples_500(spark):
    from basketry.plans import registry

    assert registry.queries()["discriminability"](spark, "/root/testdata/sf0.01").first().n_pairs == 500 * 499 // 2


def test_recent_window_counts_both_ends(txn):
    assert candidates.last_days(txn, 4).count() == 4 and candidates.last_days(txn, 3).count() == 3


def test_repurchase_and_siblings(txn, articles):
    out = {(r.customer_id, r.article_id): r.score for r in candidates.repurchase(txn, articles, txn, 10).collect()}
    assert out == {("u1", "a1"): 2.0, ("u1", "a2"): 1.0, ("u2", "a2"): 1.0, ("u2", "a1"): 0.5}


def test_blend_takes_the_best_and_leaves_a_single_source(spark):
    a = spark.createDataFrame([("u", "x", 1.0), ("u", "y", 5.0)], "customer_id string, article_id string, score double")
    b = spark.createDataFrame([("u", "x", 3.0), ("u", "z", 4.0)], "customer_id string, article_id string, score double")
    assert candidates.blend([a], 1) is a
    assert [(r.article_id, r.score) for r in candidates.blend([a, b], 2).orderBy("place").collect()] == [("y", 5.0), ("z", 4.0)]


def test_ranking_metrics_by_hand(spark):
    pred = spark.createDataFrame([("u", i, k + 1) for k, i in enumerate("axby")] + [("v", "q", 1)], "customer_id string, article_id string, place int")
    truth = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), ("w", "c")], "customer_id string, article_id string")
    out = {r.customer_id: r for r in metrics.per_user(pred, truth).collect()}
    assert set(out) == {"u", "w"} and abs(out["u"].ap - (1 + 2 / 3) / 2) < 1e-12
    assert abs(out["u"].ndcg - (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))) < 1e-12
    assert (out["u"].hr, out["u"].rr, out["w"].ap, out["w"].ndcg) == (1.0, 1.0, 0.0, 0.0)
    assert abs(metrics.evaluated(pred, truth).first()["map"] - (1 + 2 / 3) / 4) < 1e-6


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, label int")
    assert metrics.auc(rows).first().auc == 3.5 / 4


def test_distribution_diversity_and_json(spark):
    rows = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 1.0), ("u", None, 9.0), ("u", "None", 9.0), ("v", "a", 2.0)], "customer_id string, x string, w double")
    dist = profiles.distributions(rows, "x")
    assert {(r.customer_id, r.value): r.p for r in dist.collect()} == {("u", "a"): 0.75, ("u", "b"): 0.25, ("v", "a"): 1.0}
    d = {r.customer_id: r.diversity for r in profiles.diversity(dist).collect()}
    assert abs(d["u"] + 0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)) < 1e-12 and d["v"] == 0.0
    j = {r.customer_id: json.loads(r.t) for r in profiles.as_json(profiles.top_shares(dist), "t").collect()}
    assert j == {"u": {"a": 0.75, "b": 0.25}, "v": {"a": 1.0}}


@pytest.mark.parametrize("n,want", [(1, [1]), (5, [1, 2, 3, 4, 5]), (7, [1, 1, 2, 3, 4, 5, 5])])
def test_quintiles(spark, n, want):
    df = spark.createDataFrame([(f"u{k}", float(k)) for k in range(n)] + [("x", None)], "customer_id string, avg_price double")
    out = {r.customer_id: r.quintile for r in profiles.price_quintiles(df).collect()}
    assert [out[f"u{k}"] for k in range(n)] == want and out["x"] is None


def test_decay_halves(spark):
    df = spark.createDataFrame([(day(0), day(90))], "a date, b date")
    assert abs(df.select(C.decay(F.col("a"), F.col("b"))).first()[0] - 0.5) < 1e-12


def test_json_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), ("bad",), ("",), (None,), ('[null,"c"]',)], "x string")
    assert [r[0] for r in df.select(C.json_list(F.col("x"))).collect()] == [["a", "b"], [], [], [], ["c"]]
    assert [r[0] for r in df.select(C.json_list(F.col("x"), "raw")).collect()][1] == ["bad"]


def test_mutual_information_closed_forms(spark):
    same = spark.createDataFrame([("A", 0)] * 3 + [("B", 1)] * 3, "a string, b int")
    row = analysis.mutual_information(same, "a", "b").first()
    assert abs(row.nmi - 1) < 1e-12 and abs(row.mi - 1) < 1e-12
    assert analysis.mutual_information(same.withColumn("a", F.lit("x")), "a", "b").first().nmi == 0.0


def test_js_distance_of_equal_and_disjoint(spark):
    dist = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("c", "y", 1.0)], "customer_id string, value string, p double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    out = {(r.a, r.b): r.distance for r in analysis.js_distance(dist, pairs).collect()}
    assert out["a", "b"] == 0.0 and abs(out["a", "c"] - math.sqrt(math.log(2))) < 1e-12


def test_coherence_matches_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "article_id long, v array<double>")
    h = spark.createDataFrame([("u", 1), ("u", 1), ("u", 3), ("w", 2)], "customer_id string, article_id long")
    out = analysis.coherence(h, v).collect()
    assert len(out) == 1 and abs(out[0].coherence - (1.0 + 0.6 + 0.6) / 3) < 1e-12


def test_retrieval_in_blocks_is_exact(spark):
    v = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(50)], "article_id long, v array<double>")
    q = spark.createDataFrame([(7, [math.cos(7), math.sin(7)])], "customer_id long, centroid array<double>")
    want = sorted(range(50), key=lambda k: (-round(math.cos(k - 7), 9), k))[:5]
    for block in (4096, 9):
        assert [r.article_id for r in analysis.retrieved(q, v, 5, block=block).orderBy("place").collect()] == want


def test_rand_index_and_effective_k(spark):
    df = spark.createDataFrame([(k % 3, (k % 3) * 7, -1) for k in range(30)], "a int, b int, c int")
    assert segments.adjusted_rand(df, "a", "b").first().ari == 1.0
    row = segments.effective_k(df, "a").first()
    assert abs(row.effective_k - 3) < 1e-9 and abs(row.evenness - 1) < 1e-12


def test_discriminative_keys_include_absent_ones(spark):
    df = spark.createDataFrame([(0, {"x": 1.0}), (1, {"y": 1.0})], "s int, w map<string,double>")
    out = {(r.s, r.key): (r.ratio, r.side) for r in segments.discriminative_keys(df, "s", "w").collect()}
    assert out == {(0, "x"): (2.0, "over"), (0, "y"): (0.0, "under"), (1, "y"): (2.0, "over"), (1, "x"): (0.0, "under")}


def test_clamp_and_routing(spark):
    df = spark.createDataFrame([(5, "a", "p"), (5, "a", "q"), (0, "z", "z"), (None, "a", "p")], "v int, k string, l string")
    ranges = [(F.col("k"), {"a": (1, 3)}), (F.col("l"), {"p": (2, 2), "q": (4, 5)})]
    assert [r[0] for r in df.select(attributes.clamped(F.col("v"), ranges)).collect()] == [2, 3, 0, None]
    out = df.select(attributes.routed(F.col("k"), F.col("l"), {"a": "Mixed"}, {"p": "Footwear"}))
    assert [r[0] for r in out.collect()] == ["Footwear", "Apparel", "Apparel", "Footwear"]


def test_validation_finds_each_kind(spark):
    df = spark.createDataFrame([(1, "x", 9, '["a","b"]'), (2, None, 1, '["a"]')], "article_id int, e string, n int, l string")
    fields = [attributes.Field("e", "enum", ("y",)), attributes.Field("n", "int"), attributes.Field("l", "list", ("a",), most=1)]
    out = {r.article_id: (r.problems, r.broken) for r in attributes.validated(df, fields, [attributes.Rule("r", "Error", "n > 5")]).collect()}
    assert out == {1: (["e:value", "n:range", "l:length", "l:value"], ["Error:r"]), 2: (["e:missing"], [])}


def test_coverage_and_verdicts(spark):
    df = spark.createDataFrame([("x", float("nan")), ("", 1.0)], "a string, b double")
    out = {r.field: r.share for r in quality.coverage(df, ["a", "b", "none"]).collect()}
    assert out == {"a": 0.5, "b": 0.5, "none": 0.0, "mean": pytest.approx(1 / 3)}


def test_graph_weights(spark):
    txn = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "a")], "customer_id string, article_id string")
    out = {(r.customer_id, r.article_id): r.weight for r in ml.normalized_edges(txn).collect()}
    assert out == {("u", "a"): pytest.approx(0.5), ("u", "b"): pytest.approx(2**-0.5), ("v", "a"): pytest.approx(2**-0.5)}


def test_csv_keeps_zeros_and_fills(spark, tmp_path):
    (tmp_path / "t.csv").write_text("t_dat,customer_id,article_id,price,sales_channel_id\n2020-01-02,007,0108,1.5,2\n2020-01-01,008,0109,2.5,1\n")
    (tmp_path / "c.csv").write_text("customer_id,FN,Active,club_member_status,fashion_news_frequency,age,postal_code\n1,,,,NONE,,x\n2,1.0,1.0,ACTIVE,NONE,30,y\n")
    txn = tables.by_day(tables.read_csv(spark, str(tmp_path / "t.csv"), tables.TRANSACTIONS))
    txn.write.parquet(str(tmp_path / "txn"))
    assert [r.article_id for r in spark.read.parquet(str(tmp_path / "txn")).orderBy("t_dat").collect()] == ["0109", "0108"]
    rows = tables.cleaned_customers(tables.read_csv(spark, str(tmp_path / "c.csv"), tables.CUSTOMERS)).orderBy("customer_id").collect()
    assert [(r.Active, r.club_member_status) for r in rows] == [(0.0, "UNKNOWN"), (1.0, "ACTIVE")]


def test_chunks_respect_bytes_and_lines(spark):
    lines = spark.createDataFrame([(k, "x" * (k % 40)) for k in range(300)], "id long, line string")
    out = sorted(tables.chunked(lines, "id", "line", 100, 5).collect())
    groups = {}
    for r in out:
        groups.setdefault(r.chunk, []).append(len(r.line) + 1)
    assert len(out) == 300 and all(sum(g) <= 100 and len(g) <= 5 for g in groups.values())
    assert [r.chunk for r in out] == sorted(r.chunk for r in out) and sorted(groups) == list(range(len(groups)))
    # greedy: the first line of the next chunk would not have fitted
    assert all(sum(groups[k]) + groups[k + 1][0] > 100 or len(groups[k]) == 5 for k in range(len(groups) - 1))


def test_responses_later_file_wins(spark):
    line = lambda k, text, error=None: json.dumps({"custom_id": k, "error": error, "response": {"body": {"output": [{"content": [{"text": text}]}]}}})
    df = spark.createDataFrame([(1, line("a", '{"x": 1}')), (2, line("a", '{"x": 2}')), (1, line("b", "no json")), (1, line("c", "{}", "failed"))], "file_no int, line string")
    out = {r.custom_id: (r.parsed.x if r.ok else None, r.ok) for r in tables.parsed_responses(df, "x int").collect()}
    assert out == {"a": (2, True), "b": (None, False)}


def test_upsert_and_store(spark, tmp_path):
    old = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "k int, v array<string>")
    new = spark.createDataFrame([(2, ["c"]), (3, None)], "k int, v array<string>")
    tables.write_store({"t": tables.upserted(old, new, "k")}, str(tmp_path))
    assert {r.k: r.v for r in tables.read_store(spark, str(tmp_path), ["t"])["t"].collect()} == {1: '["a"]', 2: '["c"]', 3: None}


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(folder)
    got = events.drained(events.hourly(events.read_events(spark, folder)), "hours", str(tmp_path / "ck")).collect()
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert key(got) == key(events.hourly(batch).collect()) and got
    once = events.drained(events.distinct_events(events.read_events(spark, folder)), "once", str(tmp_path / "ck2"), "append")
    assert once.count() == batch.select("event_id").distinct().count()


def test_entry_stands_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "basketry", tmp_path / "basketry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_separation_draws_what_was_never_bought(spark):
    v = spark.createDataFrame([(k, [float(k < 20), float(k >= 20)]) for k in range(60)], "article_id long, v array<double>")
    history = spark.createDataFrame([(u, k) for u in range(5) for k in range(u, u + 8)], "customer_id long, article_id long")
    truth = spark.createDataFrame([(u, 15 + k) for u in range(5) for k in range(3)], "customer_id long, article_id long")
    r = analysis.separation(history, truth, v, negatives=10).first()
    assert r.n_positive == 15 and 0 < r.n_negative <= 50 and r.auc > 0.7 and abs(r.mean_positive - 1) < 1e-9 and r.mean_negative < 0.8
    again = analysis.separation(history, truth, v, negatives=10).first()
    assert r == again


def test_gini_spearman_and_places_over_many_ranges(spark):
    import random as rnd

    rng = rnd.Random(3)
    rows = [(k, rng.randrange(1, 9), float(rng.randrange(5))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, n long, p double").repartition(7)
    c = sorted(n for _, n, _ in rows)
    want = 2 * sum((i + 1) * x for i, x in enumerate(c)) / (len(c) * sum(c)) - (len(c) + 1) / len(c)
    assert abs(analysis.gini(df, "n").first().gini - want) < 1e-12
    assert abs(analysis.spearman(df, "n", "n").first().rho - 1) < 1e-12
    got = [(r.id, r.place, r.share) for r in analysis.pareto(df, "id", "n").orderBy("place").collect()]
    order, upto = sorted(rows, key=lambda x: (-x[1], x[0])), 0
    for (k, n, _), (i, place, share), at in zip(order, got, range(1, 301), strict=True):
        upto += n
        assert (k, at) == (i, place) and abs(share - upto / sum(c)) < 1e-12


def test_csv_json_and_resumed_results(spark, tmp_path):
    df = spark.createDataFrame([("007", [1, 2], 1.5), ("008", None, None)], "id string, items array<int>, x double")
    tables.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c", "id string, items string, x double").collect()))[0] == ("007", "[1,2]", 1.5)
    tables.write_json(df, f"{tmp_path}/j")
    assert sorted(tables.read_json(spark, f"{tmp_path}/j", df.schema).collect()) == sorted(df.collect())
    rows = spark.range(40).withColumnRenamed("id", "k")
    done = []

    def work(part):
        done.extend(r.k for r in part.collect())
        return part.withColumn("twice", F.col("k") * 2)

    rows.where("k < 10").withColumn("twice", F.col("k") * 2).write.parquet(f"{tmp_path}/r")  # a run that was broken off
    out = tables.processed(rows, work, "k", f"{tmp_path}/r", 4)
    assert sorted(map(tuple, out.collect())) == [(k, 2 * k) for k in range(40)] and sorted(done) == list(range(10, 40))


def test_loose_operators(spark):
    assert candidates.steps(105, 10) == 10
    df = spark.range(100)
    a = [r.id for r in candidates.sampled(df, 7, "id").collect()]
    assert a == [r.id for r in candidates.sampled(df.repartition(5), 7, "id").collect()] and len(set(a)) == 7
    raw = spark.createDataFrame([("1", None), ("2", "x")], "article_id string, detail_desc string")
    assert [r.detail_desc for r in tables.cleaned_articles(raw).orderBy("article_id").collect()] == ["", "x"]
    files = spark.createDataFrame([("a.jpg", bytearray(b"abc"))], "path string, content binary")
    assert tables.encoded_images(files).first().content == "YWJj"
    from basketry.operators import attributes, profiles

    means = spark.createDataFrame([(None,), (1.5,), (3.0,), (4.25,)], "m double")
    assert [r[0] for r in means.select(profiles.quality_words(F.col("m"))).collect()] == ["Insufficient data", "budget (1.5)", "mid-range (3.0)", "premium (4.3)"]
    facts = spark.createDataFrame([(1, '["b","a"]', "x", 3), (2, None, None, None)], "article_id long, m string, e string, o int")
    known = attributes.encoders(facts, ["e"], ["m"])
    assert known == {"e": ["UNKNOWN", "x"], "m": ["a", "b"]}
    rows = attributes.encoded_facts(spark.createDataFrame([(1,), (2,), (3,)], "article_id long"), facts, known, ["e"], ["o"], ["m"], ["m"]).orderBy("article_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3.0, 2, 1, 1), (2, 0, 0.0, 0, 0, 0), (3, 0, 0.0, 0, 0, 0)]
    pair = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    assert abs(pair.select(C.cosine(F.col("a"), F.col("b"))).first()[0] - 24 / 25) < 1e-6


def test_candidate_queries_ask_for_small_tasks(spark):
    from basketry.plans import registry

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for name in ("repurchase_candidates", "blended_candidates", "candidate_auc"):
        spark.conf.set(key, "64m")
        registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "8m"
    spark.conf.unset(key)
