"""Weak supervision of document quality, in DataFrame functions only.

Rules vote good (1) or bad (-1) or abstain (0) on measures of the whole text. Documents are
counted by their pattern of votes; expectation-maximisation over these counts, of which there
are at most 3 to the number of rules however many documents there are, estimates how often each
rule votes which way on good and on bad documents. A document is kept if its posterior
probability of being good is at least one half, so what a rule's vote weighs is learned and no
single rule decides as it would in all-must-pass filtering.

Defined cases: null or blank text has no words and zero measures; repeated rows are judged
alike; an empty table gives no rows. Columns of the input that are named like a measure, or
like ``votes``, ``posterior``, ``base_failed`` or ``kept``, give way; all others pass through.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"

#: (name, good if, bad if) over the measures; neither: abstain.
RULES = [
    ("length", "n_words >= 60", "n_words < 20"),
    ("word_length", "word_chars between 4 * n_words and 7 * n_words", "word_chars < 3 * n_words or word_chars > 9 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("capitals", "10 * n_capitals <= word_chars", "4 * n_capitals > word_chars"),
    ("exclamations", "50 * n_exclamations <= n_words", "5 * n_exclamations > n_words"),
    ("line_repeats", "n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    ("window_repeats", "20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    ("variety", "10 * n_distinct >= 6 * n_words", "20 * n_distinct < 7 * n_words"),
    ("short_words", "100 * n_short between 15 * n_words and 60 * n_words", "20 * n_short < n_words"),
    ("sentences", "50 * n_ends >= n_words and 4 * n_ends <= n_words", "n_ends = 0 or 2 * n_ends > n_words"),
]


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words covered by ``window``-word windows that are found twice or more in the array."""

    def counted(w: Column) -> Column:
        starts = F.when(F.size(w) >= window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[w[i + k] for k in range(window)]))
        return common.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # beyond either end get() is null and counts as different
        same = lambda s, e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        found = common.let(by_hash, lambda s: F.transform(F.filter(s, lambda e, k: same(s, e, k)), lambda e: e["i"]))
        return common.let(found, lambda at: F.size(F.array_distinct(F.concat(*[F.transform(at, shifted(k)) for k in range(window)]))))

    def shifted(k: int):
        return lambda i: i + k

    return common.let(words, counted)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures that the rules and the base criteria use (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda chars: F.length(F.translate(t, chars, ""))
    short = lambda x: (F.length(x) <= 3) & x.rlike("^\\p{L}+$")
    of_words = common.let(common.words(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"), F.size(F.array_distinct(w)).alias("d"), F.size(F.filter(w, short)).alias("s")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_lines = common.let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("r")))
    w, l = common.free(docs, "_w"), common.free(docs, "_l")
    out = docs.withColumns({
        w: of_words,
        l: of_lines,
        "word_chars": bare(" \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.length(t) - bare(SYMBOLS)).cast("long"),
        "n_exclamations": (F.length(t) - bare("!")).cast("long"),
        "n_capitals": F.regexp_count(t, F.lit("\\p{Lu}")).cast("long"),
        "n_ends": F.regexp_count(t, F.lit("[.!?](?=[\\x20\\x09-\\x0D]|\\z)")).cast("long"),
    })
    parts = {"n_words": f"{w}.n", "n_repeat_words": f"{w}.r", "n_distinct": f"{w}.d", "n_short": f"{w}.s", "n_lines": f"{l}.n", "n_dup_lines": f"{l}.r"}
    return out.withColumns({k: F.col(v).cast("long") for k, v in parts.items()}).drop(w, l)


def votes(rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Array of the rules' votes; bad wins if both conditions hold."""
    vote = lambda good, bad: F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("tinyint")
    return F.array(*[vote(good, bad) for _, good, bad in rules])


def estimate(patterns: list[tuple[list[int], int]], n_rules: int, most_rounds: int = 1000, settled: float = 1e-8) -> tuple[float, np.ndarray]:
    """(share of good documents, log chances of each vote: rule, vote + 1, (good, bad)), by
    expectation-maximisation.

    ``patterns``: distinct votes with their counts. The first posterior calls a pattern bad if
    more rules do than on the median document (none, unless a rule is amiss). Chances have half a document added for each vote, and a rule's bad vote
    never speaks for good nor its good vote for bad, so that the classes can't trade places.
    """
    vote = np.array([p for p, _ in patterns], np.int64).reshape(-1, n_rules)
    n = np.array([c for _, c in patterns], float)
    one = np.stack([vote == v for v in (-1, 0, 1)], 2).astype(float)
    bad = (vote == -1).sum(1)
    order = np.argsort(bad, kind="stable")
    usual = bad[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)] if len(n) else 0
    good = np.where(bad > usual, 0.1, 0.95)
    prior, chances = 0.5, np.zeros((n_rules, 3, 2))
    for _ in range(most_rounds if len(n) else 0):
        sums = np.stack([np.tensordot(n * good, one, 1), np.tensordot(n * (1 - good), one, 1)], 2) + 0.5
        chance = sums / sums.sum(1, keepdims=True)
        for v, wrong in ((0, chance[:, 0, 0] > chance[:, 0, 1]), (2, chance[:, 2, 0] < chance[:, 2, 1])):
            chance[wrong, v] = chance[wrong, v].mean(1, keepdims=True)
        prior, chances = float(((n * good).sum() + 1) / (n.sum() + 2)), np.log(chance)
        odds = log(prior / (1 - prior)) + np.tensordot(one, chances[:, :, 0] - chances[:, :, 1], 2)
        now = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, good = np.abs(now - good).max(), now
        if moved < settled:
            break
    return prior, chances


def accuracies(prior: float, chances: np.ndarray, rules: list[tuple[str, str, str]] = RULES) -> dict[str, float]:
    """How often each rule is right where it votes, as estimated."""
    share = np.exp(chances) * np.array([prior, 1 - prior])
    return {name: float((x[2, 0] + x[0, 1]) / x[[0, 2]].sum()) for (name, _, _), x in zip(rules, share, strict=True)}


def posterior(prior: float, chances: np.ndarray) -> Column:
    """Probability of being good, given ``votes``."""
    odds = F.lit(log(prior / (1 - prior)))
    for j, by_vote in enumerate(chances[:, :, 0] - chances[:, :, 1]):
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in by_vote]), (F.col("votes")[j] + 2).cast("int"))
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, text: str = "text", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``docs`` without the text, with measures, ``votes``, ``posterior``, ``base_failed``
    and ``kept``. Texts are read once; what follows works on the stored measures."""
    own = common.stored(measured(docs, text).drop(text).withColumn("votes", votes(rules)), "measures")
    prior, chances = learned(own, len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = own.withColumn("posterior", posterior(prior, chances)).withColumn("base_failed", failed)
    return own.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def learned(own: DataFrame, n_rules: int) -> tuple[float, np.ndarray]:
    """Estimates from the ``votes`` of all documents."""
    return estimate(sorted((list(r.votes), r.n) for r in own.groupBy("votes").agg(F.count("*").alias("n")).collect()), n_rules)
