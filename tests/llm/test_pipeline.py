"""Stages of the pipeline against what they may and must drop."""

import random

import pytest

import corpus_pipeline
from basketry.llm import decontam, neardup

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        if name.startswith("language"):
            assert docs.count() >= 0.98 * before
        if name.startswith("simhash"):
            assert docs.count() == docs.select("text").distinct().count() < before
        if name.startswith("benchmark"):
            assert decontam.found(docs, bench).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
    ordered = sorted((r.start, r.n_tokens) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(ordered, ordered[1:], strict=False))


def survivors(rows):
    """Least id of each group that pairs of five-word similarity 0.8 or more connect, by all pairs."""
    sets = {}
    for k, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    own = {k: k for k in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    return {k for k in own if own[k] == k}


@pytest.mark.parametrize("common", [5, 10**9])
def test_near_dedup_stage_against_all_pairs(spark, monkeypatch, common):
    """Copies with more and more changed words, on both sides of 0.8, under a shared license."""
    monkeypatch.setattr(neardup, "COMMON_TEXTS", common)
    rng = random.Random(11)
    texts, word = [None, "", " \n", "one two", "One  two"], lambda: f"w{rng.randrange(5000)}"
    for _ in range(12):
        base = [word() for _ in range(rng.choice([9, 40, 150, 400]))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" this line is the same license in very many of the texts" if rng.random() < 0.5 else ""))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got) == sorted(survivors(rows)) and 40 < len(got) < 110


@pytest.mark.parametrize("few", [0.25, 0.0])
def test_dense_group_around_the_bound(spark, monkeypatch, few):
    """Copies of one text, of which many pairs are just above or below 0.8: centres leave some apart."""
    monkeypatch.setattr(neardup, "FEW_MEETINGS", few)
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == survivors(rows) and 1 < len(got) < 60


def test_near_dedup_stage_on_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == survivors(rows)


def test_one_pair_of_each_two_components_is_verified_first(spark):
    from basketry.llm import neardup

    cross = spark.createDataFrame([(1, 5, 1, 5), (2, 5, 1, 5), (2, 6, 1, 5), (6, 1, 5, 1), (1, 9, 1, 9)], "a long, b long, ra long, rb long")
    first = neardup.firsts(cross)
    assert sorted(map(tuple, first.collect())) == [(1, 5), (1, 9)]
    # 1 and 5 turned out to be linked: their other pairs need no verification, and 9 is apart from 1
    roots = spark.createDataFrame([(5, 1)], "node long, root long")
    more = cross.unionByName(spark.createDataFrame([(6, 9, 5, 9)], cross.schema))
    assert [tuple(r) for r in neardup.still_apart(more, first, roots).collect()] == [(6, 9, 1, 9)]


def test_waves_of_pairs_change_no_cluster(spark, monkeypatch):
    from basketry.llm import neardup, simhash

    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[:j] + ["x" if j < 40 else "y"] + words[j + 1 :]) for j in range(41)] + [" ".join(f"{w}{g}" for w in words) for g in "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    monkeypatch.setattr(neardup, "FEW_PAIRS", 0)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == want
