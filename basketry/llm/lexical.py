"""Ranked lexical search: the best documents for each item, by inverted treaps.

One pass over the texts keeps, for each document, its number of terms and how often it holds the
terms that items ask for; what statistics need is summed up from there. Then each task takes its
documents in segments of bounded size and answers every item from them, and a last top k takes the
best of all segments. No text and no posting is shuffled.

A segment has a treap for each term: its documents in order of id for the search, in order of
impact for the heap, so the root of every subtree bounds what is below it. Neighbours of greater
impact, found by doubling pointers, give all treaps of a segment at once. An item walks the treaps
of its terms together. A state is a range of documents with the root of each term's subtree there;
the sum of the roots' impacts bounds any score in it. The range is dropped if that can't enter the
k best (equal scores need a smaller id). Otherwise the document of the greatest root is scored in
full, and the ranges before and behind it go on with the subtrees that are left. States of many
items move in step as arrays, the most promising first, in chunks of bounded size.

Scores are whole numbers, and nothing is estimated: the result is that of scoring every document.

Defined cases: null texts have no terms, and items without terms no rows; repeated items are
ranked each; repeated ids are documents of their own; a null id comes before all others and is
returned as null; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import count
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Occurrences of terms in the items that are asked in one pass; postings of a segment; cells
#: (states x terms) of a chunk of states.
ASKED, POSTINGS, CELLS = 1 << 20, 1 << 20, 1 << 20
#: Documents, about, that are searched ahead to have a bar for each item, and how many times as many
#: there must be for that to pay.
AHEAD, PAYS = 20_000, 10
#: Slots of the filter that tells most documents without a term before its postings are searched.
SLOT_BITS, SPREAD = 24, np.uint64(0x9E3779B97F4A7C15)
LEAST_ID = np.iinfo(np.int64).min
#: Bytes of UTF-8 that are in terms stay or are lower-cased, all others are a space.
TERM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(TERM_BYTES).split() if text else []


def weight(n_documents: int, frequency: int) -> int:
    return floor(1000 * log((2 * n_documents + 2) / (2 * frequency + 1)))


def slots(cell: np.ndarray) -> np.ndarray:
    """Where the filter of a segment's postings has a posting."""
    return (cell.astype(np.uint64) * SPREAD) >> np.uint64(64 - SLOT_BITS)


class Segment:
    """Treaps of some documents. ``first``: where the postings of each term begin; ``order``:
    place in the heap; ``left``, ``right``, ``root``: -1 where there is none."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids = ids[by_id]
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        doc = place[doc]
        order = np.lexsort((doc, term))
        self.doc, term, self.impact = doc[order], term[order], impact[order]
        self.cell = term * len(ids) + self.doc
        self.there = np.zeros(1 << SLOT_BITS, bool)
        self.there[slots(self.cell)] = True
        n = len(order)
        first = np.searchsorted(term, np.arange(n_terms + 1))
        # equal impacts are spread by hash, so that treaps stay flat
        spread = (self.doc.astype(np.uint64) + np.uint64(1)) * SPREAD
        rank = np.empty(n, np.int64)
        rank[np.lexsort((spread ^ (spread >> np.uint64(29)), self.impact))] = np.arange(n)
        before, behind = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[first[:-1][first[:-1] < first[1:]]] = -1
        behind[first[1:][first[:-1] < first[1:]] - 1] = n
        for to, none in ((before, -1), (behind, n)):  # up to the next of greater rank
            active = np.flatnonzero(to != none)
            while len(active):
                active = active[rank[to[active]] < rank[active]]
                to[active] = to[to[active]]
                active = active[to[active] != none]
        high = np.append(rank, n)  # the place behind all, and before all at -1, has the highest rank
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        under = np.where(high[before] < high[behind], before, behind)
        child = np.flatnonzero((before >= 0) | (behind < n))
        is_left = under[child] > child
        self.left[under[child[is_left]]] = child[is_left]
        self.right[under[child[~is_left]]] = child[~is_left]
        top = np.flatnonzero((before < 0) & (behind == n))
        self.root = np.full(n_terms, -1)
        self.root[term[top]] = top
        self.visited = 0

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Roots of the parts of subtrees that lie in low <= document < high."""
        nodes = nodes.copy()
        row, col = np.nonzero(nodes >= 0)
        while len(row):
            own = nodes[row, col]
            under, over = self.doc[own] < low[row], self.doc[own] >= high[row]
            out = under | over
            row, col = row[out], col[out]
            nodes[row, col] = np.where(under[out], self.right[own[out]], self.left[own[out]])
            stay = nodes[row, col] >= 0
            row, col = row[stay], col[stay]
        return nodes


@dataclass
class Best:
    """The k best of each item so far, best first: scores and documents' places (-1: none)."""

    score: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(floors: np.ndarray, k: int) -> Best:
        """``floors``: scores that k documents elsewhere reach, so those that reach them enter too."""
        return Best(np.tile(np.maximum(floors, 1)[:, None] - 1, (1, k)), np.full((len(floors), k), -1))

    def enters(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        worst, at = self.score[item, -1], self.doc[item, -1]
        return (score > worst) | ((score == worst) & (doc < at))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        own = np.unique(item)
        k = self.score.shape[1]
        i = np.concatenate([np.repeat(own, k), item])
        s = np.concatenate([self.score[own].ravel(), score])
        d = np.concatenate([self.doc[own].ravel(), doc])
        order = np.lexsort((d, -s, i))
        i, s, d = i[order], s[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < k
        self.score[i[keep], nth[keep]], self.doc[i[keep], nth[keep]] = s[keep], d[keep]


def searched(segment: Segment, asked: np.ndarray, weights: np.ndarray, floors: np.ndarray, k: int) -> Best:
    """The k best documents of a segment for items of distinct terms ``asked`` (items x terms,
    -1 behind the last) with their ``weights`` (0 there)."""
    last, width = len(segment.ids), asked.shape[1]
    best = Best.of(floors, k)
    roots = np.where(asked >= 0, segment.root[asked], -1)
    stack = [(np.arange(len(asked)), np.zeros(len(asked), np.int64), np.full(len(asked), last), roots)]
    most = max(1, CELLS // max(1, width))
    while stack:
        some = [stack.pop()]
        while stack and sum(len(x[0]) for x in some) + len(stack[-1][0]) <= most:
            some.append(stack.pop())
        item, low, high, nodes = (np.concatenate(x) for x in zip(*some, strict=True))
        impact = np.where(nodes >= 0, segment.impact[nodes], 0) * weights[item]
        bound = impact.sum(1)
        live = (bound > 0) & best.enters(item, bound, low)
        if not live.any():
            continue
        item, low, high, nodes, impact, bound = item[live], low[live], high[live], nodes[live], impact[live], bound[live]
        if len(item) > most:  # the least promising last
            order = np.argsort(bound, kind="stable")
            cuts = np.array_split(order, -(-len(order) // most))
            stack += [(item[c], low[c], high[c], nodes[c]) for c in cuts]
            continue
        segment.visited += len(item)
        at = segment.doc[nodes[np.arange(len(item)), impact.argmax(1)]]
        # the true score: each term's posting of the document, if there is one
        row, col = np.nonzero(nodes >= 0)
        cell = asked[item[row], col] * last + at[row]
        maybe = segment.there[slots(cell)]
        row, col, cell = row[maybe], col[maybe], cell[maybe]
        place = np.minimum(np.searchsorted(segment.cell, cell), len(segment.cell) - 1)
        hit = segment.cell[place] == cell
        score = np.zeros(len(item), np.int64)
        np.add.at(score, row[hit], segment.impact[place[hit]] * weights[item[row[hit]], col[hit]])
        enters = best.enters(item, score, at)
        if enters.any():
            best.add(item[enters], score[enters], at[enters])
        stack += [(item, at + 1, high, segment.within(nodes, at + 1, high)), (item, low, at, segment.within(nodes, low, at))]
    return best


@dataclass
class Questions:
    """Items of one pass: ids, distinct terms by number and how often each item holds them."""

    ids: list
    terms: dict[bytes, int]
    asked: list[np.ndarray]
    times: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int | None, bytes]]) -> Questions:
        known: dict[bytes, int] = {}
        ids, asked, times = [], [], []
        for key, text in rows:
            own = Counter(terms(text))
            if own:
                ids.append(key)
                asked.append(np.array([known.setdefault(t, len(known)) for t in own], np.int64))
                times.append(np.array(list(own.values()), np.int64))
        return Questions(ids, known, asked, times)

    def chunks(self):
        """(rows, terms, times) of items with about as many terms, as matrices."""
        order = sorted(range(len(self.ids)), key=lambda k: len(self.asked[k]))
        at = 0
        while at < len(order):
            width, n = 0, 0
            for n in count(1):
                width = len(self.asked[order[at + n - 1]])
                if at + n == len(order) or (n + 1) * len(self.asked[order[at + n]]) > CELLS:
                    break
            rows = order[at : at + n]
            asked, times = np.full((n, width), -1), np.zeros((n, width), np.int64)
            for r, k in enumerate(rows):
                asked[r, : len(self.asked[k])], times[r, : len(self.asked[k])] = self.asked[k], self.times[k]
            yield np.array(rows), asked, times
            at += n


def occurrences(docs: DataFrame, known: dict[bytes, int], id: str, text: str) -> DataFrame:
    """(id, n, term, tf) of each document: its number of terms, and those that items ask for."""

    def run(batches):
        for batch in batches:
            n, own, tf = [], [], []
            for t in batch.column(1).to_pylist():
                words = terms(t)
                n.append(len(words))
                there = [(known[w], c) for w, c in Counter(words).items() if w in known]
                own.append([w for w, _ in there])
                tf.append([c for _, c in there])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "term", "tf"])

    return common.mapped(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary")), run, "id long, n long, term array<int>, tf array<int>")


def answers(stored: DataFrame, q: Questions, n_documents: int, n_terms: int, frequency: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """(item, id, score) of the k best of each segment."""
    weights = np.array([weight(n_documents, int(df)) for df in frequency], np.int64)
    groups = [(rows, asked, np.where(asked >= 0, weights[asked], 0) * times) for rows, asked, times in q.chunks()]

    def run(batches):
        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= POSTINGS:
                yield from best(held)
                held, postings = [], 0
        if held:
            yield from best(held)

    def best(held):
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            return
        ids = table.column(0).combine_chunks()
        n, term, tf = table.column(1).to_numpy(), table.column(2).combine_chunks(), table.column(3).combine_chunks()
        sizes = np.diff(term.offsets.to_numpy())
        doc = np.repeat(np.arange(len(ids)), sizes)
        m = 75 + 25 * n * n_documents // max(1, n_terms)
        tf = tf.flatten().to_numpy().astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        if not len(doc):
            return
        segment = Segment(ids.fill_null(LEAST_ID).to_numpy(), doc, term.flatten().to_numpy().astype(np.int64), impact, len(frequency))
        for rows, asked, own in groups:
            found = searched(segment, asked, own, floors[rows], k)
            i, j = np.nonzero(found.doc >= 0)
            at = segment.ids[found.doc[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[i], pa.int64()), pa.array(at, pa.int64(), mask=at == LEAST_ID), pa.array(found.score[i, j], pa.int64())], ["item", "id", "score"])

    return common.mapped(stored, run, "item long, id long, score long", rows=1 << 16)


def question_blocks(items: DataFrame, id: str, text: str):
    """Items in blocks of about ASKED bytes of text: each is held by the driver and the tasks."""
    own = items.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    blocks = max(1, -(-int(own.agg(F.sum(F.length("text"))).first()[0] or 0) // ASKED))
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield Questions.of(sorted(((r.id, bytes(r.text)) for r in rows.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0,
    equal scores by ascending id."""
    spark, out = docs.sparkSession, None
    for q in question_blocks(items, item_id, item_text):
        if not q.ids:
            continue
        stored = common.stored(occurrences(docs, q.terms, id, text), "occurrences")
        n_documents, n_terms = stored.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(q.terms), np.int64)
        for r in stored.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # the items' own terms
            frequency[r[0]] = r[1]
        floors = np.zeros(len(q.ids), np.int64)
        if n_documents > AHEAD * PAYS:  # any documents will do: what k of them reach is a floor
            ahead = stored.where(F.pmod(F.xxhash64("id", "n"), F.lit(n_documents // AHEAD)) == 0)
            for item, scores in merged(answers(ahead, q, n_documents, n_terms, frequency, floors, k), k).groupBy("item").agg(F.collect_list("score")).collect():
                if len(scores) == k:
                    floors[item] = min(scores)
        one = merged(answers(stored, q, n_documents, n_terms, frequency, floors, k), k)
        names = spark.createDataFrame(list(enumerate(q.ids)), "item long, item_id long")
        one = one.join(F.broadcast(names), "item").select("item_id", F.col("place").alias("rank"), F.col("id").alias("doc_id"), "score")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each item."""
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id")))
    return parts.withColumn("place", place).where(F.col("place") <= k)
