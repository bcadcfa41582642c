"""Spelling variants: words that differ by one code point, and the frequent form of each.

Texts are cut into words and counted in Arrow batches, so only a batch's distinct words are
shuffled. Two words of like length differ in one place if they are equal without it; a longer
one has the shorter one as one of its deletions. So a word has a key for itself, one for each
deletion, and one for each deletion with its place and length. Keys are integers: prefix sums of
powers give the polynomial hashes of all prefixes and suffixes of a batch at once, and two of them
make the hash of a deletion. Keys are dealt by their first bits, sorted, and those of a single word
go before any string is joined. What is left meets again by the true strings of the deletions, so a
collision of hashes links nothing.

No pairs are made. Words that are equal without one place form a group that the alphabet bounds
(90 code points), in which each word is near to all others; a word and what an insertion makes of
it form a star. Sums and the first two of a group give each word's number of near words and the
most frequent one.

Defined cases: null and empty texts have no words; a null id reads as an empty one where a word's
code point is chosen to go; repeated rows and ids count each; words of any length go in whole; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Base of the polynomial (odd, so it has an inverse modulo 2^64) and bits that deal the keys.
BASE, RADIX_BITS = np.uint64(0x9E3779B97F4A7C15), 12
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("insertion", pa.bool_()), ("at", pa.int32())])


def noisy(doc_id: str | None, run: str, one_in: int) -> str:
    """The run with only A-Z lower-cased; where ``one_in`` divides the crc32 of ``<doc_id>:<run>``
    a code point of it is missing."""
    own = run.encode().lower()
    h = zlib.crc32(own, zlib.crc32(f"{doc_id or ''}:".encode()))
    word = own.decode()
    if one_in and h % one_in == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 6, one_in: int = 199) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)  # shorter ones only get shorter

    def run(batches):
        for batch in batches:
            total: Counter[str] = Counter()
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(runs.findall(own or "")).items():
                    total[noisy(key, word, one_in)] += n
            own = [(w, n) for w, n in total.items() if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], ["word", "n"])

    part = common.mapped(docs.select(F.col(id).cast("string"), F.col(text)), run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a polynomial hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, insertion, at) of all words: ``at`` is the code point that is missing, -1 in
    the key of the word itself. Of equal neighbours only the first is deleted among the keys for
    insertions, as the others give the same string."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = len(points)
    power = np.ones(n + 2, np.uint64)
    power[1:] = BASE
    inverse = np.ones(n + 2, np.uint64)
    inverse[1:] = INVERSE
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64, out=upto[1:])
    end = size.cumsum()
    start = end - size
    whole = (upto[end] - upto[start]) * inverse[start]
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(n)
    first, last = start[word], end[word]
    # the suffix moves up by one place
    rest = (upto[place] - upto[first]) * inverse[first] + (upto[last] - upto[place + 1]) * inverse[first + 1]
    at, long = place - first, (last - first).astype(np.uint64)
    new = np.ones(n, bool)
    new[1:] = (points[1:] != points[:-1]) | (at[1:] == 0)
    with_place = mixed(mixed(rest) ^ (long << np.uint64(32)) ^ (at.astype(np.uint64) + np.uint64(1)))
    key = np.concatenate([with_place, mixed(whole), mixed(rest[new])])
    kinds = np.repeat([False, True, True], [n, len(words), int(new.sum())])
    return key, np.concatenate([word, np.arange(len(words)), word[new]]), kinds, np.concatenate([at, np.full(len(words), -1), at[new]])


def keyed(words: DataFrame) -> DataFrame:
    """(key, id, insertion, at) of (id, word)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key, row, insertion, at = deletion_keys(batch.column(1).to_pylist())
                ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(insertion), pa.array(at.astype(np.int32))], schema=KEYS)

    return common.mapped(words.select("id", "word"), run, "key long, id long, insertion boolean, at int")


def shared(keys: DataFrame) -> DataFrame:
    """Rows whose key others have too; keys for insertions need the word itself among them.

    Keys are dealt by their first bits and sorted by Spark, which spills; a task holds a batch and
    the rows of its last key, whose number the alphabet and the word's length bound.
    """

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            key = rows.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            yield kept(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield kept(held)

    def kept(rows):
        key = rows.column(0).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = new.cumsum() - 1
        size = np.bincount(group)
        centre = np.bincount(group, rows.column(3).to_numpy() < 0) > 0
        good = (size[group] > 1) & (centre[group] | ~rows.column(2).to_numpy(zero_copy_only=False))
        return rows.filter(pa.array(good))

    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    return common.mapped(dealt, run, "key long, id long, insertion boolean, at int", rows=1 << 16)


def near(words: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_near, best_word, best_n) from the rows of ``shared``, by the true strings."""
    own = found.join(words, "id")
    rest = F.when(F.col("at") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
    own = own.select("id", "word", "n", "insertion", "at", F.when(F.col("insertion"), -1).otherwise(F.col("at")).alias("place"), rest.alias("rest"))
    group = W.partitionBy("insertion", "place", "rest")
    order = group.orderBy(F.col("at") >= 0, F.desc("n"), "word")  # a star's centre first
    entry = F.struct(F.col("n"), F.col("word"), F.col("at"))
    own = own.withColumns({"size": F.count("*").over(group), "nth": F.row_number().over(order), "head": F.first(entry).over(order), "next": F.lead(entry).over(order)})
    own = own.where((F.col("size") > 1) & (~F.col("insertion") | (F.col("head.at") < 0)))
    best = F.when(F.col("nth") == 1, F.col("next")).otherwise(F.col("head"))
    many = F.when(F.col("insertion") & (F.col("nth") > 1), 1).otherwise(F.col("size") - 1)
    own = own.select("id", many.alias("many"), F.struct((-best["n"]).alias("minus"), best["word"].alias("word")).alias("best"))
    return own.groupBy("id").agg(F.sum("many").alias("n_near"), F.min("best").alias("best")).select("id", "n_near", F.col("best.word").alias("best_word"), (-F.col("best.minus")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all rows of (word, form), each step of which leads to another word and
    none in a circle: pointers double their reach in each stored round."""
    own = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = own.select(F.col("word").alias("root"), F.col("root").alias("far"))
        longer = own.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        last, own = own, common.stored(longer, "roots")
        common.forget(last)
        if not own.where("moved").limit(1).count():
            return own.select("word", "root")


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 6, least_n: int = 5, one_in: int = 199, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words that occur ``least_n`` times or more:
    ``form`` is the near word of largest n (of equals the first in code-point order) if that n is
    at least ``times`` the word's own; ``root`` is where the forms lead. As ``times`` is over 1,
    forms never lead back."""
    if times < 2:
        raise ValueError("times must be 2 or more")
    many = counts(docs, id, text, least_length, one_in).where(F.col("n") >= least_n)
    words = common.stored(many.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    own = words.join(near(words, shared(keyed(words))), "id", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_word")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    own = common.stored(own, "forms")
    ends = roots(own.where("form is not null"))
    return own.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
