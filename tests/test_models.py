"""Exact search, factorisation, density clusters, packing and forward passes against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import density, factors, ml, nearest, networks, packing
from basketry.operators.ordering import settled
from basketry.sources import tables


def vectors(n, width=6, groups=8, seed=0, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))


def frame(spark, m, id="id"):
    return spark.createDataFrame([(k, row) for k, row in enumerate(m.tolist())], f"{id} long, v array<double>")


# search


def test_search_is_exact_and_skips_blocks(spark):
    m, q = vectors(700, seed=1), vectors(60, seed=2)
    q[0], q[1] = 0, m[5]  # equal scores everywhere; a row itself
    m[600:] = m[0]  # copies
    items = frame(spark, m).unionByName(spark.createDataFrame([(None, [0.0] * 6), (999, None)], "id long, v array<double>"))
    asked = frame(spark, q, "u").withColumn("k", F.when(F.col("u") == 3, 40).otherwise(5))
    top, visited = nearest.searched(asked, nearest.packed(items, "id", "v", 16), 5, "u", "v", own_k="k")
    got = Counter()
    rows = {(r.user, r.place): (r.id, r.score) for r in top.collect()}
    s = np.round(q @ m.T, 9)
    for u in range(60):
        k = 40 if u == 3 else 5
        order = np.lexsort((np.arange(700), -s[u]))[:k]
        assert [rows.pop((u, p + 1)) for p in range(k)] == [(int(i), float(s[u, i])) for i in order]
    assert not rows and not got
    seen = [(r.visited, r.n_blocks) for r in visited.collect()]
    assert all(v <= n >= -(-700 // 16) for v, n in seen)
    assert np.mean([v for v, _ in seen]) < 0.5 * seen[0][1]


def test_search_in_many_small_packs_and_pieces(spark, monkeypatch):
    m, q = vectors(300, seed=5), vectors(90, seed=6)
    m[200:210] = m[7] * 1000  # far beyond single precision's digits of the others
    monkeypatch.setattr(nearest, "PACK_BYTES", 2_000)
    monkeypatch.setattr(nearest, "CELLS", 64)
    blocks = nearest.packed(frame(spark, m), "id", "v", 16)
    assert all(len(range(100)[part]) <= 64 for part in nearest.Bounds(blocks).slices(100))
    top, _ = nearest.searched(frame(spark, q, "u"), blocks, 20, "u", "v")
    got, s = {}, np.round(q @ m.T, 9)
    for r in top.collect():
        got[r.user, r.place] = r.id
    assert got == {(u, p + 1): int(i) for u in range(90) for p, i in enumerate(np.lexsort((np.arange(300), -s[u]))[:20])}


def test_no_block_is_met_beyond_its_bound(spark):
    m, q = vectors(400, seed=3), vectors(20, seed=4)
    blocks = nearest.packed(frame(spark, m), "id", "v", 20)
    bounds = nearest.Bounds(blocks)
    order, bound = bounds.order(q)
    by_block = {r.block: np.array(r.m).reshape(-1, 6) for r in blocks.collect()}
    assert sum(len(x) for x in by_block.values()) == 400 and max(len(x) for x in by_block.values()) <= 20
    for i in range(20):
        for b, most in zip(order[i], bound[i], strict=True):
            assert (by_block[int(bounds.block[b])] @ q[i]).max() <= most
    state = spark.createDataFrame([(k, row, 5, float(np.sort(q[k] @ m.T)[-5]), 0) for k, row in enumerate(q.tolist())], "user long, q array<double>, k int, bar double, done int")
    for r in nearest.visits(state, bounds, 10**6).collect():
        at = list(bounds.block[order[r.user]]).index(r.block)
        assert bound[r.user][at] >= r.bar


def test_search_of_nothing(spark):
    none = frame(spark, np.zeros((0, 3)))
    some = frame(spark, vectors(5, 3), "u")
    top, visited = nearest.searched(some, nearest.packed(none, "id", "v"), 3, "u", "v")
    assert top.count() == 0 and visited.count() == 5
    top, visited = nearest.searched(none.toDF("u", "v"), nearest.packed(frame(spark, vectors(5, 3)), "id", "v"), 3, "u", "v")
    assert top.count() == 0 and visited.count() == 0


# factorisation


@pytest.fixture(scope="module")
def tastes(spark):
    """Users of four tastes, who mostly buy items of their own; some items are popular with all."""
    rng = random.Random(4)
    rows, late = set(), set()
    for u in range(160):
        own = [i for i in range(100) if i % 4 == u % 4]
        picks = rng.sample(own, 12) + rng.sample(range(100), 2)
        rows |= {(u, i) for i in picks[:8] + picks[12:]}
        late |= {(u, i) for i in picks[8:12]}
    late -= rows
    make = lambda x: spark.createDataFrame(sorted(x), "customer_id long, article_id long")
    return make(rows), make(late)


def test_factors_rank_held_out_purchases_above_popularity(spark, tastes):
    bought, late = tastes
    users, items = factors.trained(bought, width=6, epochs=8, rate=0.3, penalty=0.002, parts=2)
    users, items = users.cache(), items.cache()
    auc = factors.pairwise_auc(late, bought, users, items).first()
    n = bought.groupBy("article_id").count()
    popular = n.select(F.col("article_id").alias("id"), F.array(F.col("count").cast("double")).alias("f"))
    ones = users.select("id", F.array(F.lit(1.0)).alias("f"))
    base = factors.pairwise_auc(late, bought, ones, popular).first()
    assert auc.n == base.n > 1000 and auc.auc > 0.85 > base.auc + 0.2
    again = factors.trained(bought.repartition(7), width=6, epochs=8, rate=0.3, penalty=0.002, parts=2)
    for one, other in zip((users, items), again, strict=True):
        assert {r.id: tuple(r.f) for r in one.collect()} == {r.id: tuple(r.f) for r in other.collect()}
    recs = factors.recommended(bought, users, items, 5)
    known = {(r.customer_id, r.article_id) for r in bought.collect()}
    got = [(r.customer_id, r.article_id, r.place) for r in recs.collect()]
    assert len(got) == 160 * 5 and not {g[:2] for g in got} & known
    assert np.mean([i % 4 == u % 4 for u, i, _ in got]) > 0.8


def test_factors_with_one_part_empty_or_repeats(spark):
    own = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (None, 5), (3, None)], "customer_id long, article_id long")
    users, items = factors.trained(own, width=3, epochs=2, parts=4)
    assert {r.id for r in users.collect()} == {1, 2} and {r.id for r in items.collect()} == {5, 6}
    users, items = factors.trained(own.where("false"), width=3, epochs=1)
    assert users.count() == 0 and items.count() == 0


# density


def clusters_by_hand(m, least, samples, neighbours, cuts):
    n = len(m)
    d = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), 9)
    near = {a: sorted((d[a, b], b) for b in range(n) if b != a)[: max(neighbours, samples - 1)] for a in range(n)}
    core = {a: near[a][samples - 2][0] for a in range(n)}
    edges = sorted({(max(x, core[a], core[b]), min(a, b), max(a, b)) for a in near for x, b in near[a]})
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    tree = []
    for w, a, b in edges:
        if find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
            tree.append((w, a, b))
    at = sorted({-(-len(tree) * k // cuts) - 1 for k in range(1, cuts + 1)})
    levels = sorted({tree[k][0] for k in at})
    groups = []
    for cut in levels:
        up[:] = range(n)
        for w, a, b in tree:
            if w <= cut:
                x, y = sorted((find(a), find(b)))
                up[y] = x
        own = {}
        for x in range(n):
            own.setdefault(find(x), set()).add(x)
        groups.append({k: v for k, v in own.items() if len(v) >= least})
    top = len(levels) - 1

    def best(level, root, born, mass):
        """(mass, clusters) of what the cluster that was born at ``born`` holds, as of this level."""
        inside = [(r, v) for r, v in groups[level - 1].items() if v <= groups[level][root]] if level else []
        if len(inside) == 1:
            gain = len(inside[0][1]) * (1 / levels[level - 1] - 1 / levels[level])
            return best(level - 1, inside[0][0], born, mass + gain)
        below = [best(level - 1, r, (level - 1, r), 0.0) for r, _ in inside]
        total = sum(x for x, _ in below)
        if mass >= total and not (born[0] == top and len(groups[top]) == 1):
            return mass, [born]
        return total, [c for _, cs in below for c in cs]

    chosen = [c for r in groups[top] for c in best(top, r, (top, r), 0.0)[1]]
    labels = np.full(n, -1)
    for level, root in chosen:
        labels[list(groups[level][root])] = root
    return labels, tree


def test_density_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([vectors(380, 3, 5, 1, 0.08), vectors(60, 3, 1, 10, 0.02), rng.uniform(-3, 3, (60, 3))])
    want, tree = clusters_by_hand(m, 12, 4, 10, 8)
    rows = frame(spark, m)
    near = nearest.nearest(rows, "id", "v", 10, 256)
    got = settled(density.forest(settled(density.reach_edges(near, 4))))
    assert sorted((r.w, r.a, r.b) for r in got.collect()) == sorted(tree)
    found = density.clusters(got, density.cut_distances(got, 8), 12)
    labels = dict.fromkeys(range(len(m)), -1) | {r.id: r.label for r in found.collect()}
    assert [labels[k] for k in range(len(m))] == want.tolist() and len(set(want.tolist())) >= 4


def test_components_and_clusters_of_little(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (7, 7)], "u long, v long")
    assert sorted(map(tuple, density.joined_stars(edges).collect())) == [(4, 3), (5, 3), (9, 8)]
    few = frame(spark, vectors(3, 2))
    assert {r.label for r in density.density_clusters(few, "id", "v").collect()} == {-1}
    assert density.density_clusters(few.where("false"), "id", "v").count() == 0


# packing


@pytest.mark.parametrize(("n", "most_bytes", "most_lines", "block"), [(1, 10, 5, 8), (200, 100, 7, 8), (500, 60, 1000, 32), (333, 10**9, 10, 16), (400, 1, 3, 64), (257, 120, 1, 16), (64, 10**9, 64, 64)])
def test_chunks_equal_a_loop(spark, n, most_bytes, most_lines, block):
    rng = random.Random(n)
    sizes = [rng.choice([1, 5, 20, 70]) for _ in range(n)]
    want, chunk, used, lines = [], 0, 0, 0
    for size in sizes:
        if lines and (used + size > most_bytes or lines >= most_lines):
            chunk, used, lines = chunk + 1, 0, 0
        used, lines = used + size, lines + 1
        want.append(chunk)
    own = spark.createDataFrame([(3 * k, s) for k, s in enumerate(sizes)], "id long, size int").repartition(5)
    got = {r.id: (r.place, r.chunk) for r in packing.numbered(own, "id", "size", most_bytes, most_lines, block if most_lines <= block else most_lines).collect()}
    assert got == {3 * k: (k, c) for k, c in enumerate(want)}


def test_no_lines_and_text_ids(spark):
    own = spark.createDataFrame([("b", "22"), ("a", "1"), ("c", "333")], "custom_id string, line string")
    assert tables.chunked(own.where("false"), "custom_id", "line", 5, 5).count() == 0
    assert {(r.custom_id, r.line, r.chunk) for r in tables.chunked(own, "custom_id", "line", 5, 5).collect()} == {("a", "1", 0), ("b", "22", 0), ("c", "333", 1)}


def test_failed_keys_take_the_template(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    found = spark.createDataFrame([(1, "own"), (9, "not asked")], "id long, text string")
    templates = spark.createDataFrame([(1, "t1"), (2, "t2"), (4, "t4")], "id long, text string")
    got = tables.with_fallback(ids, found, templates, "id").select("id", "text", "profile_source").collect()
    assert sorted(map(tuple, got)) == [(1, "own", "model"), (2, "t2", "template_fallback")]


# boosting


def test_rounds_importance_and_scores_of_boosted_trees(spark):
    rng = random.Random(2)
    rows = []
    for k in range(900):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((k, a, b, c, int(a + 0.3 * b + rng.gauss(0, 0.25) > 0.7), "held_out" if k % 3 == 0 else "train"))
    own = spark.createDataFrame(rows, "id long, a double, b double, c double, label int, part string")
    model = ml.boosted(own, ["a", "b", "c"], "label", trees=12, depth=2, patience=3)
    votes = ml._votes(model.assembler.transform(own.where("part = 'held_out'")), model.trees, model.weights).select("label", "_votes").collect()
    aucs = []
    for k in range(1, 13):
        s = [(round(sum(r._votes[:k]), 9), r.label) for r in votes]
        pos, neg = [x for x, y in s if y], [x for x, y in s if not y]
        aucs.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
    got = [r.auc for r in model.rounds.orderBy("round").collect()]
    assert got == pytest.approx(aucs) and model.best == ml.stop_round(aucs, 3)
    gain = {r.feature: r.gain for r in model.importance.collect()}
    assert gain["a"] > gain["b"] > gain["c"] >= 0
    scored = model.scores(own.where("part = 'held_out'")).orderBy("id").select("model_score", "label").collect()
    pos, neg = [r.model_score for r in scored if r.label], [r.model_score for r in scored if not r.label]
    assert sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)) == pytest.approx(aucs[model.best - 1], abs=1e-6)


def test_when_training_stops():
    assert ml.stop_round([0.5, 0.6, 0.6, 0.55, 0.9], 2) == 2 and ml.stop_round([0.5, 0.6, 0.6, 0.7], 2) == 4 and ml.stop_round([0.5], 50) == 1


# forward passes


def test_gates_add_up_and_edges_of_attention(spark):
    one = spark.createDataFrame([([1.0, -2.0], [0.5, 3.0], [[1.0, 0.0], None], None), ([0.0, 0.0], [0.0, 0.0], [], [2.0])], "f array<double>, r array<double>, h array<array<double>>, n array<double>")
    own = networks.weighted(one, {"w": [[1.0, 0.5], [-1.0, 2.0]], "b": [0.1, -0.2], "w1": [[0.1] * 8], "b1": [0.0]})
    a, b = networks.cross_gate(F.col("f"), F.col("r"), F.col("w"), F.col("b"))
    got = own.select(a.alias("ga"), b.alias("gb"), networks.gated(F.col("f"), F.col("r"), (a, b)).alias("g"), networks.attended(F.col("f"), F.col("h"), [(F.col("w1"), F.col("b1"))]).alias("p"), networks.gated(F.col("f"), F.col("n"), (a, b)).alias("none")).collect()
    l = np.array([[1, 0.5], [-1, 2]]) @ np.array([0.5, -6.0]) + [0.1, -0.2]
    e = np.exp(l) / np.exp(l).sum()
    assert (got[0].ga, got[0].gb) == pytest.approx(tuple(e)) and got[0].g == pytest.approx((e[0] * np.array([1, -2.0]) + e[1] * np.array([0.5, 3])).tolist())
    z = 0.1 * (1 - 2 + 1 + 0 + 0 - 2 + 1 + 0)
    assert got[0].p == pytest.approx([1 / (1 + np.exp(-z)), 0.0]) and got[1].p == [0.0, 0.0] and got[0].none is None
    with pytest.raises(ValueError, match="weights"):
        networks.weighted(one, {"w": np.zeros((3000, 3000)).tolist()})


def test_outputs_of_null_vectors_and_versions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, -1.0])], "id long, v array<double>")
    own = networks.expert_outputs(rows, "id", "v", [([[1.0, 1.0], [1.0, -1.0]], [0.0, 0.0]), ([[1.0, 0.0], [0.0, 1.0]], [0.5, 0.0])], [1.0, 1.0], [0.0, 0.0], "a")
    got = {r.id: r.output for r in own.collect()}
    assert got[2] is None and got[1] == pytest.approx([1, -1], abs=1e-5) and got[3] == pytest.approx([-1, 1], abs=1e-5)
    store = networks.restored(own, own.where("id = 1").withColumn("version", F.lit("b")), "id")
    store = networks.restored(store, own.where("id = 3").withColumn("output", F.array(F.lit(9.0))), "id")
    assert sorted((r.id, r.version, len(r.output or [])) for r in store.collect()) == [(1, "a", 2), (1, "b", 2), (2, "a", 0), (3, "a", 1)]
