"""Forward passes of given weights: experts, gates and fusions, cross layers, attention pooling and
factorisation machines.

Weights come from elsewhere; nothing is trained here. ``weighted`` puts them beside the rows as one
broadcast row, so that all the rest are column expressions over arrays that Spark plans like any
other. The wide layers of experts run as one matrix product for each Arrow batch instead.

A matrix is an array of output rows. Arrays that are null or hold a null give null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nearest import matrix

#: Numbers that ``weighted`` broadcasts at most.
MOST_WEIGHTS = 1 << 22
Pair = tuple[Column, Column]


def weighted(rows: DataFrame, weights: dict[str, list]) -> DataFrame:
    """``rows`` with a column for each of the weights: numbers, vectors or matrices."""
    arrays = {k: np.asarray(v, np.float64) for k, v in weights.items()}
    n = sum(a.size for a in arrays.values())
    if n > MOST_WEIGHTS:
        raise ValueError(f"{n} weights are more than are broadcast ({MOST_WEIGHTS})")
    kinds = ("double", "array<double>", "array<array<double>>")
    one = rows.sparkSession.createDataFrame([tuple(a.tolist() for a in arrays.values())], ", ".join(f"`{k}` {kinds[a.ndim]}" for k, a in arrays.items()))
    return rows.crossJoin(F.broadcast(one))  # one row


def add_all(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def product(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def inner(x: Column, y: Column) -> Column:
    return add_all(product(x, y))


def plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def linear(x: Column, w: Column, b: Column) -> Column:
    return let(x, lambda x: F.zip_with(w, b, lambda row, c: inner(row, x) + c))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    shares = lambda e: let(add_all(e), lambda t: F.transform(e, lambda v: v / t))
    return let(x, lambda x: let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), shares)))


def normed(x: Column, scale: Column, shift: Column, epsilon: float = 1e-6) -> Column:
    """Layer norm: mean 0 and variance 1 over the array, then scaled and shifted."""
    centred = let(x, lambda x: let(add_all(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))
    unit = let(centred, lambda d: let(F.sqrt(inner(d, d) / F.size(d) + epsilon), lambda sd: F.transform(d, lambda v: v / sd)))
    return plus(product(unit, scale), shift)


# gates: weights of the factual and the reasoning expert, which add up to 1


def fixed_gate(logit: Column) -> Pair:
    """The same weights for all rows."""
    g = sigmoid(logit)
    return g, 1 - g


def _two(x: Column) -> Pair:
    s = softmax(x)
    return s[0], s[1]


def expert_gate(fact: Column, reason: Column, w: Column, b: Column) -> Pair:
    """From both experts' outputs."""
    return _two(linear(F.concat(fact, reason), w, b))


def context_gate(fact: Column, reason: Column, context: Column, w: Column, b: Column) -> Pair:
    """From both experts' outputs and what is known of the user."""
    return _two(linear(F.concat(fact, reason, context), w, b))


def cross_gate(fact: Column, reason: Column, w: Column, b: Column) -> Pair:
    """From where the experts agree: their product, element by element."""
    return _two(linear(product(fact, reason), w, b))


def gated(fact: Column, reason: Column, gate: Pair) -> Column:
    """Both experts' outputs by their weights."""
    return let(F.array(*gate), lambda g: F.zip_with(fact, reason, lambda f, r: g[0] * f + g[1] * r))


# fusions of a backbone's vector with what the experts add, projected to its width


def concat_fusion(x: Column, added: Column) -> Column:
    return F.concat(x, added)


def sum_fusion(x: Column, added: Column, alpha: Column) -> Column:
    return F.zip_with(x, added, lambda a, b: a + alpha * b)


def gated_fusion(x: Column, added: Column, w: Column, b: Column) -> Column:
    """Each element between both by a gate of its own."""
    def mixed(y: Column) -> Column:
        gate = F.transform(linear(F.concat(x, y), w, b), sigmoid)
        return F.zip_with(gate, F.zip_with(x, y, lambda a, b: F.array(a, b)), lambda g, p: g * p[0] + (1 - g) * p[1])

    return let(added, mixed)


def attention_fusion(x: Column, added: Column, value: Pair, out: Pair, scale: Column, shift: Column) -> Column:
    """The vector attends to what is added. That is one key, which takes all attention in every
    head whatever the query, so the attended value is the value projection alone."""
    return normed(plus(x, linear(linear(added, *value), *out)), scale, shift)


# backbones


def cross_layer(x0: Column, x: Column, down: Column, up: Column, gate: Pair, bias: Column, scale: Column, shift: Column) -> Column:
    """A cross layer whose matrix is a gated mixture of low-rank ones: ``down`` and ``up`` hold a
    matrix for each expert (width x rank lists of rows), ``gate`` weighs them by row."""
    def crossed(x: Column) -> Column:
        parts = F.zip_with(down, up, lambda v, u: let(F.transform(v, lambda r: inner(r, x)), lambda low: F.transform(u, lambda row: inner(row, low))))
        scaled = F.zip_with(softmax(linear(x, *gate)), parts, lambda g, p: F.transform(p, lambda v: g * v))
        mixture = F.aggregate(scaled, F.transform(x, lambda _: F.lit(0.0)), plus)
        return plus(product(x0, plus(mixture, bias)), x)

    return normed(let(x, crossed), scale, shift)


def attended(query: Column, history: Column, layers: list[Pair]) -> Column:
    """Sum of the history's vectors by their attention, over their number. Each is weighed by a
    sigmoid of layers over [q, k, q - k, q * k]; null vectors are padding; no history gives zeros."""
    keys = F.filter(history, lambda k: k.isNotNull())

    def weight(k: Column) -> Column:
        h = F.concat(query, k, F.zip_with(query, k, lambda a, b: a - b), product(query, k))
        for w, b in layers[:-1]:
            h = relu(linear(h, w, b))
        return sigmoid(linear(h, *layers[-1])[0])

    total = F.aggregate(keys, F.transform(query, lambda _: F.lit(0.0)), lambda s, k: plus(s, let(weight(k), lambda w: F.transform(k, lambda v: v * w))))
    return F.transform(total, lambda v: v / F.greatest(F.size(keys), F.lit(1)))


def pairwise_term(fields: Column) -> Column:
    """Second-order term of a factorisation machine over vectors of fields: half of the square of
    their sum less the sum of their squares, with no pairs."""
    zero = F.transform(fields[0], lambda _: F.lit(0.0))
    total = F.aggregate(fields, zero, plus)
    squares = F.aggregate(fields, zero, lambda s, f: plus(s, product(f, f)))
    return add_all(F.zip_with(total, squares, lambda t, q: t * t - q)) / 2


# experts


def expert_outputs(rows: DataFrame, id: str, vector: str, layers: list[tuple[list, list]], scale: list, shift: list, version: str) -> DataFrame:
    """(id, version, output) of a network of linear layers with relu between them and a layer
    norm behind: one matrix product for each layer and Arrow batch. Null vectors give null."""
    own = [(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in layers]
    scale, shift = np.asarray(scale, np.float64), np.asarray(shift, np.float64)
    forward = _network(own, scale, shift)

    def run(batches):
        for batch in batches:
            there = batch.column(1).is_valid()
            some = batch.filter(there)
            out = forward(matrix(some.column(1))) if some.num_rows else np.zeros((0, len(scale)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(scale), pa.int32()), pa.array(out.ravel()))
            at = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
            full = lists.take(pa.array(at, pa.int64(), mask=~there.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * batch.num_rows, pa.string()), full], [id, "version", "output"])

    kind = rows.schema[id].dataType.simpleString()
    return rows.select(id, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"`{id}` {kind}, version string, output array<double>")


def _network(layers: list, scale: np.ndarray, shift: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    def forward(x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(layers):
            x = x @ w.T + b
            if k < len(layers) - 1:
                x = np.maximum(x, 0)
        x = x - x.mean(1, keepdims=True)
        return x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-6) * scale + shift

    return forward


def restored(store: DataFrame, outputs: DataFrame, id: str) -> DataFrame:
    """``store`` with new outputs: those of the same id and model version are replaced, other
    versions stay."""
    keys = outputs.select(id, "version").distinct()
    return store.join(keys, [id, "version"], "left_anti").unionByName(outputs)
