"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.component_ids(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    held_out = common.crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fitted(docs, ~held_out)
    own = langid.identified(docs.select("doc_id", "text"), model)
    return own.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    return linededup.by_document(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import tokencounts

    docs = table(spark, sf_dir, "documents")
    return tokencounts.by_section(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    own = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return own.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, "copies", "rate")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    own = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.concat("pii_base", "pii_added")
    return own.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("pii_base")), 256).alias("base_sha256"), pii.joined(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    own = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfile
    from .encoder import public_file

    path = common.new_path(spark, "tokens")
    manifest = tokenfile.written(table(spark, sf_dir, "documents"), path, public_file("word_bpe_49k.json"), end_id=2)
    return tokenfile.summaries(manifest, path)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import qda

    held_out = common.crc_mod(F.col("id"), 3) == 1
    stats = common.stored(qda.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    own = qda.scored(stats, qda.fitted(stats, labels, ~held_out))
    return own.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_decoded_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decoded_secrets as d

    own, (base, added, unfinished) = d.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return own.select("doc_id", *[count(k) for k in d.KINDS], F.sha2(d.joined(F.col(base)), 256).alias("base_sha256"), d.joined(F.col(base), F.col(added)).alias("spans"), F.size(added).cast("long").alias("n_added"), F.col(unfinished).alias("unfinished"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.grouped(table(spark, sf_dir, "documents"))


#: Search of op11 by scoring every document that holds a term of the item.
SEARCH_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
    f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
    s AS (SELECT p.doc_id, p.t, CAST(floor(1000 * ln((2 * g.nd + 2) / CAST(2 * f.df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * g.nd) // g.nt))) AS s FROM p JOIN f ON p.t = f.t CROSS JOIN g),
    r AS (SELECT q.item_id, s.doc_id, CAST(sum(s.s) AS BIGINT) AS score FROM q JOIN s ON q.t = s.t GROUP BY 1, 2),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
    SELECT * FROM k WHERE rank <= 20"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_token_counts, op4_mixing, op5_decontamination, op6_pii, op7_quality_rules, op8_simhash, op9_token_file, op10_quality_classifier, op11_lexical_search, op12_decoded_secrets, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": SEARCH_SQL}
