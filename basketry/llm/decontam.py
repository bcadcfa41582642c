"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Items of the test set are indexed; every passage of every training text is a query. A score
is the BM25 weight of the item's words that the passage holds, as a share of the item's own
weight, so that one threshold suits items of any length. Where less than the threshold can
already make a leak, that lesser weight is the item's bar instead: whatever counts as a leak is
retrieved. Passages are windows of twice the
longest item that advance by half, so each occurrence of an item lies whole in one of them.

Retrieval is exact for the threshold: block-max WAND, for many queries in step. Each word of
a query has a cursor in its list of blocks of items. The cursors in order of their block and the
words' greatest weights name the first block, the pivot, up to which an item can reach the
threshold at all; blocks before it are passed over. At the pivot the words' maxima in that
block are summed, and only if these still reach the threshold are its postings scored. Then
all cursors move behind the pivot. A whole text is asked first, as its score bounds those of
all its passages; what it retrieves is then scored for every passage.

What is retrieved is verified on word shingles. A leak holds at least ``least_overlap`` of the
question's, or of question and answer together, or of the answer's with at least half of the
question's (``kind``: question, item, answer). A question or answer shorter than a shingle is a
common phrase by itself and decides nothing alone.

Items are taken in blocks of at most ``ITEMS`` (document frequencies are those of all items),
each with an index of bounded size that goes to the workers.

Defined cases: null or empty texts and items without words have no leaks; repeated rows are
judged each; an item that occurs several times in a text gives one row with its best passage;
empty tables give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = re.compile(r"\w+")
#: Items in one index; items of a block for the block maxima; BM25 parameters.
ITEMS, BLOCK, K1, B = 20_000, 16, 1.2, 0.75
#: Cursors that move in step, about; blocks of an index at most (of many items blocks are larger).
CURSORS, MOST_BLOCKS = 1 << 16, 256
#: Least share of the question that an answer needs beside it.
HALF = 0.5


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: what follows "answer:", or else the last
    sentence of several."""
    cut = re.search(r"\banswer\s*:", text, re.IGNORECASE)
    if cut:
        return WORD.findall(text[: cut.start()].lower()), WORD.findall(text[cut.end() :].lower())
    ends = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip().rstrip(".!?"))]
    at = ends[-1] if ends else len(text)
    return WORD.findall(text[:at].lower()), WORD.findall(text[at:].lower())


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Word shingles; of fewer words, all of them as one."""
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def reachable(words: list[str], weight: dict[str, float], size: int, least: float) -> float:
    """A weight that every passage has at least if it holds ``least`` of the shingles of
    ``words``: all of it but the most that the shingles that may be missing can take along
    (fractional knapsack: a word it lacks costs all shingles with it, a shingle has ``size``
    words at most)."""
    own = shingles(words, size)
    missing = int(len(own) * (1 - least) + 1e-9)
    within: dict[str, int] = {}
    for s in own:
        for w in set(s):
            within[w] = within.get(w, 0) + 1
    room, lost = float(size * missing), 0.0
    for w, n in sorted(within.items(), key=lambda x: (-weight[x[0]] / x[1], x[0])):
        if n <= missing and room > 0:
            lost += weight[w] * min(1.0, room / n)
            room -= n
    return sum(weight[w] for w in within) - lost


@dataclass
class Leak:
    item: object
    score: float
    start: int
    question: float
    answer: float
    kind: str


class Index:
    """Inverted index of items with block maxima, both as sorted lists: what it holds grows
    with its postings. ``steps``: pivots met, ``scored``: blocks whose postings were scored."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean_length: float, threshold: float, shingle: int, least_overlap: float):
        self.threshold, self.shingle, self.least = threshold, shingle, least_overlap
        self.ids = [k for k, _ in items]
        self.parts = [parts(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        rows: list[tuple[int, int, float]] = []
        longest, self.share = 1, np.ones(len(items))
        for k, (q, a) in enumerate(self.parts):
            words = q + a
            longest = max(longest, len(words))
            count: dict[str, int] = {}
            for w in words:
                count[w] = count.get(w, 0) + 1
            weight = {w: np.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_length)) for w, n in count.items()}
            own = whole = sum(weight.values())
            if words:
                may = [reachable(part, weight, shingle, least_overlap) for part in (q, words) if part is words or len(part) >= shingle]
                if len(a) >= shingle:
                    may.append(max(reachable(a, weight, shingle, least_overlap), reachable(q, weight, shingle, HALF)))
                own = min(whole, min(may) / threshold) if threshold > 0 else whole
                self.share[k] = own / whole
            rows += [(self.vocabulary.setdefault(w, len(self.vocabulary)), k, x / own) for w, x in weight.items()]
        self.window, self.step = 2 * longest, longest
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.item, self.impact = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        n = len(self.vocabulary)
        self.most = np.zeros(n)
        np.maximum.at(self.most, term, self.impact)
        self.size = max(BLOCK, -(-len(items) // MOST_BLOCKS))
        self.blocks = -(-len(items) // self.size)
        # (word, block) as one number, ascending, with an end that no cursor passes
        of = term * (self.blocks + 1) + self.item // self.size
        key, start = np.unique(of, return_index=True)
        self.block_key = np.append(key, (n + 1) * (self.blocks + 1))
        self.block_most = np.append(np.maximum.reduceat(self.impact, start) if len(of) else np.zeros(0), 0.0)
        self.block_start = np.append(start, [len(of), len(of)])
        self.first = np.searchsorted(key, np.arange(n) * (self.blocks + 1))
        self.by_item = np.argsort(self.item, kind="stable")
        self.item_first = np.searchsorted(self.item[self.by_item], np.arange(len(items) + 1))
        self.term = term
        self.steps = self.scored = 0

    def retrieve(self, queries: list[np.ndarray]) -> list[dict[int, float]]:
        """For each query, an array of distinct words: the items whose score, over their own
        bar's, reaches the threshold."""
        out: list[dict[int, float]] = [{} for _ in queries]
        some: list[int] = []
        held = 0
        for k, terms in enumerate(queries):
            if len(terms) and self.most[terms].sum() >= self.threshold - 1e-9:
                some.append(k)
                held += len(terms)
            if some and (held > CURSORS or k == len(queries) - 1):
                for row, item, score in self.search([queries[j] for j in some]):
                    out[some[row]][item] = score
                some, held = [], 0
        if some:
            for row, item, score in self.search([queries[j] for j in some]):
                out[some[row]][item] = score
        return out

    def search(self, queries: list[np.ndarray]):
        """(query, item, score) of all that reach the threshold; one cursor for each word."""
        end, bar, keys = self.blocks, self.threshold - 1e-9, self.block_key
        terms = np.concatenate(queries)
        row = np.repeat(np.arange(len(queries)), [len(x) for x in queries])
        query, most, base = np.arange(len(queries)), self.most[terms], terms * (end + 1)
        place = self.first[terms]
        now = np.minimum(keys[place] - base, end)
        while len(query):
            # words up to each block, counted by where their cursors stand
            upto = np.bincount(row * (end + 1) + now, most, len(query) * (end + 1)).reshape(-1, end + 1)[:, :end].cumsum(1)
            alive = upto[:, -1] >= bar
            if not alive.all():
                keep = alive[row]
                query, upto = query[alive], upto[alive]
                row, most, base, place, now = (np.cumsum(alive) - 1)[row[keep]], most[keep], base[keep], place[keep], now[keep]
                if not len(query):
                    return
            pivot = (upto >= bar).argmax(1)
            at = pivot[row]
            behind = np.flatnonzero(now < at)
            if len(behind):
                place[behind] = np.searchsorted(keys, base[behind] + at[behind])
                now[behind] = np.minimum(keys[place[behind]] - base[behind], end)
            here = np.flatnonzero(now == at)
            good = np.bincount(row[here], self.block_most[place[here]], len(query)) >= bar
            self.steps += len(query)
            if good.any():
                self.scored += int(good.sum())
                cells = here[good[row[here]]]
                first = self.block_start[place[cells]]
                n = self.block_start[place[cells] + 1] - first
                ends = n.cumsum()
                posting = np.arange(ends[-1]) + (first - ends + n).repeat(n)
                item = self.item[posting]
                score = np.bincount(row[cells].repeat(n) * self.size + item % self.size, self.impact[posting], len(query) * self.size)
                for cell in (score >= bar).nonzero()[0].tolist():
                    k = cell // self.size
                    yield int(query[k]), int(pivot[k]) * self.size + cell % self.size, float(score[cell])
            place[here] += 1
            now[here] = np.minimum(keys[place[here]] - base[here], end)

    def passages(self, codes: np.ndarray, found: list[int]):
        """(start, item, score) of the passages of a text that reach the threshold for items
        that its whole retrieved. ``codes``: number of each word, -1 if no item has it."""
        count = -(-max(1, len(codes) - self.step) // self.step)
        at = np.flatnonzero(codes >= 0)
        terms, which = np.unique(codes[at], return_inverse=True)
        there = np.zeros((len(terms), count + 2), np.float32)  # a word lies in two passages, with room at either end
        there[which, at // self.step] = there[which, at // self.step + 1] = 1
        weight = np.zeros((len(found), len(terms)), np.float32)
        for row, item in enumerate(found):
            own = self.by_item[self.item_first[item] : self.item_first[item + 1]]
            place = np.minimum(np.searchsorted(terms, self.term[own]), len(terms) - 1)
            known = terms[place] == self.term[own]
            weight[row, place[known]] = self.impact[own[known]]
        score = weight @ there[:, 1 : count + 1]
        for row, k in np.argwhere(score >= self.threshold - 1e-5).tolist():
            yield k * self.step, found[row], float(score[row, k])

    def leaks(self, texts: list[str | None]) -> list[list[Leak]]:
        """Leaks of each text, by item."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        codes = [np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w)) for w in words]
        own = [np.unique(c) for c in codes]
        best: list[dict[int, Leak]] = [{} for _ in texts]
        for k, found in enumerate(self.retrieve([x[1:] if len(x) and x[0] < 0 else x for x in own])):
            sets: dict[int, set] = {}
            for at, item, score in self.passages(codes[k], sorted(found)) if found else ():
                passage = words[k][at : at + self.window]
                if at not in sets:
                    sets[at] = shingles(passage, self.shingle)
                leak, known = self.verified(item, score, at, sets[at], passage), best[k].get(item)
                if leak and (known is None or (leak.score, -leak.start) > (known.score, -known.start)):
                    best[k][item] = leak
        return [[x[i] for i in sorted(x)] for x in best]

    def verified(self, k: int, score: float, at: int, has: set, passage: list[str]) -> Leak | None:
        q, a = self.parts[k]

        def share(words: list[str]) -> float:
            if len(words) < self.shingle:  # shorter than a shingle: as a run of words
                joined = f" {' '.join(passage)} "
                return float(bool(words) and f" {' '.join(words)} " in joined)
            own = shingles(words, self.shingle)
            return len(own & has) / len(own)

        question, answer, both = share(q), share(a), share(q + a)
        if len(q) >= self.shingle and question >= self.least:
            kind = "question"
        elif both >= self.least:
            kind = "item"
        elif len(a) >= self.shingle and answer >= self.least and question >= HALF:
            kind = "answer"
        else:
            return None
        return Leak(self.ids[k], score * float(self.share[k]), at, question, answer, kind)


def indexes(items: DataFrame, id: str, text: str, threshold: float, shingle: int, least_overlap: float):
    """Indexes of all items, a block of at most about ITEMS at a time."""
    items = items.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    n = items.count()
    if not n:
        return
    words = items.select("id", F.regexp_extract_all(F.lower("text"), F.lit("(?U)\\w+"), F.lit(0)).alias("w"))
    mean = words.agg(F.avg(F.size("w"))).first()[0] or 1.0
    frequency = words.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").count()
    blocks = -(-n // ITEMS)
    for block in range(blocks):
        own = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block
        rows = sorted(((r.id, r.text) for r in items.where(own).collect()), key=str)
        here = items.where(own).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?U)\\w+"), F.lit(0))).alias("w")).distinct()
        known = dict((frequency.join(here, "w") if blocks > 1 else frequency).collect())
        seen = {w for _, t in rows for w in WORD.findall(t.lower())}
        yield Index(rows, {w: known.get(w, 1) for w in seen}, n, mean, threshold, shingle, least_overlap)


def found(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, shingle: int = 5, least_overlap: float = 0.8) -> DataFrame:
    """(id, item_id, score, passage_start, question_overlap, answer_overlap, kind) of every leak."""
    schema = T.StructType([T.StructField(id, T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("passage_start", T.LongType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()), T.StructField("kind", T.StringType())])
    own = docs.select(F.col(id).cast("long").alias(id), F.col(text).alias("text"))

    def search(index: Index):
        def run(batches):
            for batch in batches:
                rows = [(key, x) for key, found in zip(batch.column(0).to_pylist(), index.leaks(batch.column(1).to_pylist()), strict=True) for x in found]
                cols = [[r for r, _ in rows], *[[getattr(x, f) for _, x in rows] for f in ("item", "score", "start", "question", "answer", "kind")]]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

        return run

    out = None
    for index in indexes(items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")), "i", "t", threshold, shingle, least_overlap):
        one = common.mapped(own, search(index), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, shingle: int = 5, least_overlap: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without a leak."""
    at = docs.columns.index(text)

    def keep(index: Index):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not x for x in index.leaks(batch.column(at).to_pylist())], pa.bool_()))

        return run

    for index in indexes(items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")), "i", "t", threshold, shingle, least_overlap):
        docs = common.mapped(docs, keep(index), docs.schema)
    return docs
