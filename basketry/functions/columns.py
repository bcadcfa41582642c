"""Column expressions that several operators share; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_list(c: Column, bad: str = "empty") -> Column:
    """Strings of a JSON array; null and blank give none. What isn't a JSON array gives none
    (``bad="empty"``) or is itself the only member (``bad="raw"``)."""
    parsed = F.from_json(c, "array<string>")
    other = F.array(F.trim(c)) if bad == "raw" else F.array().cast("array<string>")
    empty = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.trim(c) == ""), empty).when(parsed.isNotNull() & F.trim(c).startswith("["), F.filter(parsed, lambda x: x.isNotNull())).otherwise(other)


def json_weights(c: Column) -> Column:
    """Map of a JSON object of numbers; anything else gives an empty map."""
    return F.coalesce(F.from_json(c, "map<string,double>"), F.create_map().cast("map<string,double>"))


def is_filled(c: Column) -> Column:
    """Neither null nor NaN nor blank."""
    text = F.lower(F.trim(c.cast("string")))
    return c.isNotNull() & ~text.isin("", "nan", "none")


def finite(c: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + floor)


def decay(day: Column, last: Column, half_life: float = 90.0) -> Column:
    """Weight that halves every ``half_life`` days before ``last``."""
    return F.exp(-F.log(F.lit(2.0)) * F.datediff(last, day) / half_life)


def binned(x: Column, edges: list[float]) -> Column:
    """1-based bin of left-closed intervals between edges; null and outside give 0."""
    out = F.when(x.isNull(), 0)
    for k in range(len(edges) - 1):
        out = out.when((x >= edges[k]) & (x < edges[k + 1]), k + 1)
    return out.otherwise(0)


def encoded(x: Column, vocabulary: list[str], unseen: int) -> Column:
    """Index in a fixed vocabulary; null gives 0 and what it lacks ``unseen``."""
    out = F.when(x.isNull(), 0)
    for k, v in enumerate(vocabulary):
        out = out.when(x == v, k)
    return out.otherwise(unseen)


def decade(age: Column, unknown: str | None = "unknown") -> Column:
    """Decade group of an age: 10s to 50s, then 60+."""
    out = F.when(age.isNull(), unknown)
    for low in (20, 30, 40, 50, 60):
        out = out.when(age < low, f"{low - 10}s")
    return out.otherwise("60+")


def quintile(place: Column, n: Column) -> Column:
    """1 to 5 from a 1-based place among n: equal-width over the places, not NTILE."""
    return F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(5 * (place - 1) / (n - 1)))).cast("int")


def left_padded(items: Column, length: int, pad: int = 0) -> Column:
    """The last ``length`` members, pads in front."""
    kept = F.slice(items, F.greatest(F.size(items) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(pad), length - F.size(kept)), kept)
