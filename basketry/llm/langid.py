"""Language identification by averaged hashed subword embeddings.

A text is lower-cased and cut into byte n-grams of its words with their borders. Each n-gram
is hashed to a bucket, every bucket has an embedding, their average over the whole text goes
through a linear softmax. Embeddings and softmax are trained by stochastic gradient descent in
numpy on the driver, on a sample of labelled rows of about ``rows_a_language`` for each
language (chosen by hash; the bound of the sample). A fifth of it is kept from training and
calibrates: a temperature for the probabilities, and the probability below which a text is
rejected, so that about ``false_rejects`` of texts of the known languages are.

Scoring needs no embeddings: bucket logits are multiplied out once, so a text is one gather
and one sum, in pieces of bounded size.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; rows
with null language are never learned from; without any labelled row everything is ``und``;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
#: Bytes looked at together.
PIECE = 1 << 17
LETTER = regex.compile(r"\p{L}")

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, bucket) of all n-grams that have no space but at an end."""
    last = len(data) - n + 1
    if last <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.ones(last, bool)
    for k in range(1, n - 1):
        inside &= data[k : k + last] != 32
    if n == 2:
        inside &= (data[:last] != 32) & (data[1 : 1 + last] != 32)
    at = np.flatnonzero(inside)
    h = np.full(len(at), 2166136261 + n, np.uint32)
    for k in range(n):
        h = (h ^ data[at + k]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return at, (h % np.uint32(BUCKETS)).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    data = _CLASS[np.frombuffer(b" " + text_bytes(text) + b" ", np.uint8)]
    for at in range(0, len(data), PIECE):
        for n in SIZES:
            _, h = grams(data[at : at + PIECE + n - 1], n)
            counts += np.bincount(h, minlength=BUCKETS)
    own = np.flatnonzero(counts)
    return own.astype(np.int32), counts[own].astype(np.float32)


@dataclass
class Model:
    """Bucket logits of each language, bias, temperature and rejection threshold."""

    languages: list[str] = field(default_factory=list)
    logits: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        out, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if known:
            p = self.probabilities(self.means([texts[k] for k in known]))
            for k, best, top in zip(known, p.argmax(1), p.max(1), strict=True):
                out[k], score[k] = self.languages[best], top
        return out, score

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean bucket logits of whole texts: texts are laid end to end, two spaces apart, so
        that no n-gram spans two, and looked at in pieces."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        raw = [b" " + text_bytes(t) + b" " for t in texts]
        starts = np.append(0, np.cumsum([len(x) for x in raw]))
        data = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
        for at in range(0, len(data), PIECE):
            for size in SIZES:
                where, h = grams(data[at : at + PIECE + size - 1], size)
                if not len(where):
                    continue
                doc = np.searchsorted(starts, where + at, "right") - 1
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                sums[doc[cut]] += np.add.reduceat(self.logits[h], cut, axis=0, dtype=np.float64)
                n[doc[cut]] += np.diff(np.append(cut, len(doc)))
        return sums / np.maximum(n, 1)[:, None]


def train(bags: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, false_rejects: float = 0.001) -> Model:
    """Fit on (language, buckets, counts); every fifth bag calibrates."""
    languages = sorted({x[0] for x in bags})
    if not languages:
        return Model()
    code = {x: k for k, x in enumerate(languages)}
    held = bags[::5] if len(bags) >= 50 else []
    fit = [x for k, x in enumerate(bags) if k % 5] if held else bags
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            name, own, counts = fit[k]
            step, done = rate * (1 - done / steps), done + 1
            if not len(own):
                continue
            share = counts / counts.sum()
            mean = share @ emb[own]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[code[name]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= step * p
            # an average over many buckets moves each little: scale as for the sum
            emb[own] -= step * 50 * share[:, None] * back
    model = Model(languages, (emb @ out).astype(np.float32), bias)
    if held:
        means = np.array([(c / c.sum()) @ model.logits[b] if len(b) else np.zeros(len(languages)) for _, b, c in held])
        truth = np.array([code[x[0]] for x in held])
        loss = {}
        for t in np.geomspace(0.02, 5, 60):
            model.temperature = t
            loss[t] = -np.log(np.maximum(model.probabilities(means)[np.arange(len(held)), truth], 1e-12)).mean()
        model.temperature = min(loss, key=lambda t: (loss[t], t))
        top = np.sort(model.probabilities(means).max(1))
        model.threshold = float(min(0.5, top[int(false_rejects * len(top))]))
    return model


def sample(docs: DataFrame, id: str, text: str, lang: str, rows_a_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Bags of about ``rows_a_language`` rows of each language, chosen by a hash of the row."""
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = F.create_map(*[F.lit(x) for n, c in own.groupBy(lang).count().collect() for x in (n, min(1.0, rows_a_language / c))] or [F.lit(""), F.lit(0.0)])
    key = F.xxhash64(F.col(id), F.col(lang), F.lit(1))
    chosen = own.withColumn("_key", key).where(F.pmod("_key", F.lit(1_000_003)) < share[F.col(lang)] * 1_000_003).select("_key", F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for key, name, t in zip(*[batch.column(i) for i in range(3)], strict=True):
                b, c = bag(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([name.as_py()]), pa.array([b.tobytes()]), pa.array([c.tobytes()])], ["key", "lang", "b", "c"])

    rows = common.mapped(chosen, run, "key long, lang string, b binary, c binary").collect()
    rows.sort(key=lambda r: (r.key, r.lang, bytes(r.b)))
    return [(r.lang, np.frombuffer(r.b, np.int32), np.frombuffer(r.c, np.float32)) for r in rows]


def fitted(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", rows_a_language: int = 500) -> Model:
    """A model of the rows of ``docs`` where ``learn`` holds."""
    model = train(sample(docs.where(learn), id, text, lang, rows_a_language))
    common.give_back()  # the driver held bags and embeddings
    return model


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected (columns of these names give way)."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    keep = [c for c in docs.columns if c not in {f.name for f in new}]
    at = keep.index(text)

    def run(batches):
        for batch in batches:
            names, scores = [], []
            texts = batch.column(at)
            for k in range(0, len(texts), 200):
                n, s = model.predict(texts[k : k + 200].to_pylist())
                names += n
                scores.append(s)
            score = np.concatenate(scores) if scores else np.zeros(0)
            rejected = np.array([n == "und" for n in names], bool) | (score < model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*keep, *(f.name for f in new)])

    return common.mapped(docs.select(*keep), run, T.StructType([*docs.select(*keep).schema.fields, *new]))
