"""Queries against their contracts: held-out rows, components, very long texts, the pipeline's edges."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import common, decontam, langid, linededup, mixing, neardup, pii, qda, quality_rules, registry, simhash, tokencounts, tokenfile
from basketry.llm.encoder import public_file

SF = "/root/testdata/sf0.01"


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def with_tables(spark, at, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_languages_of_held_out_rows_are_right_and_never_read(spark, sample, tmp_path):
    got = {r.doc_id: r for r in registry.op1_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in sample.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r.held_out == (crc(d) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    held = [d for d in got if got[d].held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.99 * len(held)
    # other labels, sources and ids in held-out rows change no prediction
    lost = sample.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    again = {r.doc_id: r for r in registry.op1_language_id(spark, with_tables(spark, tmp_path, documents=lost)).collect()}
    assert {d: (r.lang_pred, r.score) for d, r in again.items()} == {d: (r.lang_pred, r.score) for d, r in got.items()}


def test_quality_scores_of_held_out_rows(spark, sample, tmp_path):
    got = {r.doc_id: r for r in registry.op10_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert got.keys() == {r.doc_id for r in sample.select("doc_id").collect()}
    assert all(r.held_out == (crc(d) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    held = [(got[d].score, y) for d, y in truth.items() if got[d].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) >= 0.97
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    at = with_tables(spark, tmp_path, documents=sample, labels=turned)
    again = {r.doc_id: r.score for r in registry.op10_quality_classifier(spark, at).collect()}
    assert all(abs(again[d] - r.score) < 1e-12 for d, r in got.items())


def test_components_against_all_pairs(spark, sample):
    rows = {r.doc_id: r.text for r in sample.select("doc_id", "text").collect()}
    prints = {d: simhash.fingerprint(t) for d, t in rows.items()}
    own = {d: d for d in rows}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = np.array(sorted(prints))
    values = np.array([prints[d] for d in ids.tolist()], np.uint64)
    for k, d in enumerate(ids.tolist()):
        for other in ids[k + 1 :][np.bitwise_count(values[k + 1 :] ^ values[k]) <= 4].tolist():
            a, b = sorted((find(d), find(other)))
            own[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op8_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in rows} and len({c for _, c in got.values()}) < len(rows)


def test_bitmaps_never_turn_a_near_pair_away():
    rng = random.Random(1)
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 5, 40, 400, 3000]))]
        other = [x if rng.random() < 0.9 else rng.getrandbits(64) for x in base]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        differ = int(np.bitwise_count((neardup.bitmap(a) ^ neardup.bitmap(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_very_long_texts(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice("model data train river stone green window garden".split()) + str(rng.randrange(500)) for _ in range(12)).capitalize() + "."
    long = "\n".join(line() for _ in range(25_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long + "\nend", "en", "b"), (3, "x" * 2_000_000, "en", "a"), (4, "short text of a few words", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in simhash.deduplicated(df).collect()} == {1, 3, 4}
    assert {r.doc_id: r.component_id for r in simhash.component_ids(df).collect()}[2] == 1
    kept = {r.doc_id: r.n_kept for r in linededup.by_document(df).collect()}
    assert 24_000 < kept[1] <= 25_000 and kept[2] == 1
    sizes = {r.id: r.size for r in mixing.mixed(df).collect()}
    assert sizes == {1: 300_000, 2: 300_001, 3: 1, 4: 6}
    words = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.judged(df.select("doc_id", "text")).collect()}
    assert words[1] == (300_000, len(long) - 300_000 + 1) and words[3] == (1, 2_000_000)
    model = langid.fitted(df, F.lit(True))
    assert langid.identified(df, model).count() == 4 and qda.with_statistics(df).count() == 4
    assert pii.with_spans(df.select("doc_id", "text")).where("size(pii_base) > 0").count() == 0
    import public_tokenizers as P

    counts = {}
    for r in tokencounts.by_section(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n_chars
    assert counts == {1: len(long), 2: len(long) + 4, 3: 2_000_000, 4: 25}
    path = common.new_path(spark, "tokens")
    out = tokenfile.summaries(tokenfile.written(df, path, public_file("word_bpe_49k.json")), path).collect()
    assert len(out) == 4 and all(r.n_tokens > 6 for r in out)
    bench = spark.createDataFrame([(9, "what is the plan for the day after the long storm? it is to mend the roof of the old barn")], "item_id long, text string")
    assert decontam.found(df.union(spark.createDataFrame([(5, long + " what is the plan for the day after the long storm? it is to mend the roof of the old barn", "en", "a")], df.schema)), bench).collect()[0].doc_id == 5


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", None, "a"), (4, "12345 !!", "fr", None), (4, "12345 !!", "fr", None), (None, "a row without an id but with words in it", "en", "b"), (5, "the same words of a plain text stand here twice", "en", "a"), (6, "the same words of a plain text stand here twice", "en", "b"), (7, "é" * 4000, "es", "c")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, rows):
    columns = "doc_id long, text string, lang string, source string"
    own = spark.createDataFrame(rows, columns)
    own = own.withColumns({c: F.lit(7) for c in ("row", "key", "size", "copies", "__row", "__file", "fp", "id")})
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    at = with_tables(spark, tmp_path, documents=own, benchmark=bench)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == own.columns, name
        docs = common.stored(docs, "stage")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, at)
    assert out.count() == docs.count() == len(corpus_pipeline.run(spark, at).collect())
    kept = {r.doc_id for r in docs.collect()}
    assert kept <= {r[0] for r in rows} and not kept & {1, 2, 3, 4} and (5 in kept) == bool(rows) and 6 not in kept


def test_local_folders_are_refused_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_tables_of_a_scratch_go_but_those_that_stay(spark):
    with common.scratch(spark) as keep:
        a, b = common.stored(spark.range(3), "a"), keep(common.stored(spark.range(4), "b"))
        assert a.count() == 3
    assert b.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a._basketry_path).count()
