"""Token counts by section, attributed through offsets.

A whole text is encoded once. The character spans of its tokens are joined with the spans of
its sections (disjoint and in order) by binary search, and a token that crosses a boundary
goes, as a whole, to the section that holds most of its characters, of equals the earlier.
Counts of the sections therefore add up to the tokens of the text.

Defined cases: null or empty text has one ``empty`` section with no tokens; tokens outside all
sections count for ``none``; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoder import encoder

Section = tuple[str, int, int]


def line_kinds(text: str) -> Iterator[Section]:
    """Sections of a plain text: the first line is its ``head``; neighbouring lines with
    column bars form a ``table``, lines that begin with a bullet a ``list``, lines of a
    licence a ``notice``, all others ``prose``. A line end belongs to its line."""
    at, held = 0, None
    for k, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        lead = line.lstrip()
        kind = "head" if k == 0 else "table" if " | " in line else "list" if lead[:2] in ("- ", "* ", "• ") else "notice" if "icense" in line else "prose"
        if held and held[0] == kind != "head":
            held = (kind, held[1], end)
        else:
            if held:
                yield held
            held = (kind, at, end)
        at = end
    if held and held[2] > held[1]:
        yield held


def attribute(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a boundary. Sections are
    disjoint and ascending; tokens without characters belong where they stand."""
    last = np.maximum(end - 1, start)
    a = np.searchsorted(low, start, "right") - 1
    b = np.searchsorted(low, last, "right") - 1
    best = np.where((a >= 0) & (start < high[a]), a, -1)
    inside = (best >= 0) & (last < high[np.maximum(a, 0)])
    crosses = ~inside & ((b > a) | (best >= 0))
    for t in np.flatnonzero(crosses):  # few: boundaries fall inside few tokens
        most = 0
        for s in range(max(a[t], 0), b[t] + 1):
            share = min(end[t], high[s]) - max(start[t], low[s])
            if share > most:
                most, best[t] = share, s
    return best, crosses


def by_section(docs: DataFrame, tokenizer: str, pattern: str, id: str = "doc_id", text: str = "text", sections: Callable[[str], Iterator[Section]] = line_kinds) -> DataFrame:
    """(id, section, n_tokens, n_crossing, n_chars): one row for each kind of section of a
    row of ``docs``; n_crossing of its tokens reach over its bounds."""
    def rows(texts: list[str], keys: list) -> pa.RecordBatch:
        ids, start, end, counts = encoder(tokenizer, pattern).encode(texts)
        bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        move = np.repeat(bounds[:-1], counts)
        spans = [(k, name, bounds[k] + a, bounds[k] + b) for k, t in enumerate(texts) for name, a, b in sections(t) if b > a]
        low, high = np.array([x[2] for x in spans], np.int64), np.array([x[3] for x in spans], np.int64)
        in_text = np.repeat(np.arange(len(texts)), counts)
        if len(spans):
            best, crosses = attribute(start + move, end + move, low, high)
        else:
            best, crosses = np.full(len(ids), -1), np.zeros(len(ids), bool)
        out: dict[tuple[int, str], list[int]] = {}
        n = np.bincount(best[best >= 0], minlength=len(spans))
        over = np.bincount(best[(best >= 0) & crosses], minlength=len(spans))
        for s, (k, name, a, b) in enumerate(spans):
            got = out.setdefault((k, name), [0, 0, 0])
            got[0], got[1], got[2] = got[0] + int(n[s]), got[1] + int(over[s]), got[2] + int(b - a)
        for k in in_text[best < 0]:
            out.setdefault((int(k), "none"), [0, 0, 0])[0] += 1
        known = {k for k, _ in out}
        out |= {(k, "empty"): [0, 0, 0] for k in range(len(texts)) if k not in known}
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k, _ in out], pa.int64()), pa.array([s for _, s in out]), *[pa.array([v[i] for v in out.values()], pa.int64()) for i in range(3)]], ["id", "section", "n_tokens", "n_crossing", "n_chars"])

    def run(batches):
        for batch in batches:
            texts, keys, at = [x or "" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= 2_000_000):
                    chars += len(texts[to])
                    to += 1
                yield rows(texts[at:to], keys[at:to])
                at = to

    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return common.mapped(own, run, "id long, section string, n_tokens long, n_crossing long, n_chars long").withColumnRenamed("id", id)
