"""Greedy packing of lines into chunks, in one order over all lines.

A chunk takes lines until the next would exceed its bytes or its number of lines. Where a chunk
ends depends on where it began, so the chunks are a chain of pointers through all lines: each line
points to where the next chunk would begin if one began there. Running sums of bytes tell that from
a block of lines and a bounded look ahead. Within a block pointers double until they leave it, which
leaves one jump for each line at which the block can be entered; jumps double over the blocks from
the first line, and each block, once it knows its entry, numbers its own lines. No task sees more
than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_sums, settled

#: Lines of a block at least.
LINES = 1 << 16


def following(before: np.ndarray, size: np.ndarray, most_bytes: int, most_lines: int, at: np.ndarray) -> np.ndarray:
    """Where the next chunk begins if one begins at ``at``; places are relative to the first."""
    full = np.searchsorted(before + size, before[at] + most_bytes, side="right")
    return np.maximum(at + 1, np.minimum(full, at + most_lines))


def numbered(lines: DataFrame, id: str, size: str, most_bytes: int, most_lines: int, block: int | None = None) -> DataFrame:
    """(id, place, chunk): lines of ``size`` bytes by ascending id, which are unique. A line over
    ``most_bytes`` is a chunk of its own; places and chunks count from 0; no lines give no rows."""
    block = max(block or LINES, most_lines)
    own = lines.select(F.col(id).alias("id"), F.col(size).cast("long").alias("size"))
    own = settled(running_sums(own, F.col("id"), amounts={"place": F.lit(1).cast("long"), "before": F.col("size")}).withColumn("block", F.floor(F.col("place") / block)))
    n = own.count()
    last = max(0, (n - 1) // block)

    def jumps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        first = int(pdf["place"].iloc[0])
        mine = int(pdf["own"].sum())
        if not mine:
            return pd.DataFrame({"block": [], "entry": [], "leave": [], "chunks": []})
        to = following(pdf["before"].to_numpy(), pdf["size"].to_numpy(), most_bytes, most_lines, np.arange(mine))
        chunks = np.ones(mine, np.int64)
        while (inside := np.flatnonzero(to < mine)).size:
            over = to[inside]
            chunks[inside], to[inside] = chunks[inside] + chunks[over], to[over]
        entries = np.arange(min(mine, most_lines) if first else 1)
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "entry": entries + first, "leave": to[entries] + first, "chunks": chunks[entries]})

    head = own.where((F.col("place") % block < most_lines) & (F.col("block") > 0)).withColumns({"block": F.col("block") - 1, "own": F.lit(0)})
    seen = own.withColumn("own", F.lit(1)).unionByName(head).select("block", "place", "before", "size", "own")
    jump = settled(seen.groupBy("block").applyInPandas(jumps, "block long, entry long, leave long, chunks long"))
    spark = lines.sparkSession
    reached = spark.createDataFrame([(0, 0)], "entry long, chunk long")
    jump = jump.select("entry", "leave", "chunks")
    for _ in range(int(last + 1).bit_length()):
        ahead = reached.join(jump, "entry").select(F.col("leave").alias("entry"), (F.col("chunk") + F.col("chunks")).alias("chunk"))
        reached = settled(reached.unionByName(ahead).distinct())
        next = jump.select(F.col("entry").alias("leave"), F.col("leave").alias("far"), F.col("chunks").alias("more"))
        jump = settled(jump.join(next, "leave").select("entry", F.col("far").alias("leave"), (F.col("chunks") + F.col("more")).alias("chunks")))
    # a last block that no chunk begins in goes by the end of all lines
    entries = reached.withColumn("block", F.least(F.floor(F.col("entry") / block), F.lit(last))).groupBy("block").agg(F.min(F.struct("entry", "chunk")).alias("first")).select("block", "first.entry", "first.chunk")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        first, at, chunk = int(pdf["place"].iloc[0]), int(pdf["entry"].iloc[0]), int(pdf["chunk"].iloc[0])
        before, size = pdf["before"].to_numpy(), pdf["size"].to_numpy()
        starts, k = np.zeros(len(pdf), np.int64), at - first
        while k < len(pdf):
            starts[k] = 1
            k = int(following(before, size, most_bytes, most_lines, np.array([k]))[0])
        return pd.DataFrame({"id": pdf["id"], "place": pdf["place"], "chunk": chunk - 1 + starts.cumsum()})

    kind = own.schema["id"].dataType.simpleString()
    full = own.join(entries, "block").select("id", "block", "place", "before", "size", "entry", "chunk")
    return full.groupBy("block").applyInPandas(number, f"id {kind}, place long, chunk long").withColumnRenamed("id", id)
