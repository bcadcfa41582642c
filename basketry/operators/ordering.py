"""Places and running sums in a total order without a single-task window."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Paths of the tables settled in each open ``scratch``, innermost last.
_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Tables settled inside are deleted at its end, but for those given to ``keep``, which the
    yielded function is; these go with the scratch around it or with the application."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._settled_path)
        return table

    _scratches.append([])
    try:
        yield keep
    finally:
        for path in _scratches.pop():
            if path in kept:
                if _scratches:
                    _scratches[-1].append(path)
                continue
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to the checkpoint folder as Parquet and read back, so that what was counted
    on them still holds after a lost executor, and later plans know their size. The files go with the
    ``scratch`` around, or when the application ends. A local session without such a folder gets one
    of its own."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        context.setCheckpointDir(own or f"file:///tmp/basketry-{uuid.uuid4().hex}")
    path = f"{context.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if _scratches:
        _scratches[-1].append(path)
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._settled_path = path
    return out


def running(rows: DataFrame, *by: Column, amount: Column, to: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before in the order of ``by``."""
    return running_sums(rows, *by, amounts={to: amount})


def running_sums(rows: DataFrame, *by: Column, amounts: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each amount over all rows before in the order of ``by``.

    Rows are dealt by range; each range sums up its own and starts from what those before hold,
    so no task sees more than a range.
    """
    names = list(amounts)
    own = rows.withColumns({f"__amount{k}": amounts[c] for k, c in enumerate(names)}).repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    own = settled(own)
    sizes = own.groupBy("__part").agg(*[F.sum(f"__amount{k}").alias(f"__n{k}") for k in range(len(names))])
    starts = sizes.select("__part", *[(F.sum(f"__n{k}").over(W.orderBy("__part")) - F.col(f"__n{k}")).alias(f"__start{k}") for k in range(len(names))])  # a row for each range
    upto = W.partitionBy("__part").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumns({f"__in{k}": F.sum(f"__amount{k}").over(upto) - F.col(f"__amount{k}") for k in range(len(names))}).join(F.broadcast(starts), "__part")
    own = own.withColumns({c: F.col(f"__start{k}") + F.col(f"__in{k}") for k, c in enumerate(names)})
    return own.drop("__part", *[f"__{what}{k}" for what in ("in", "start", "amount") for k in range(len(names))])


def placed(rows: DataFrame, *by: Column, to: str = "place") -> DataFrame:
    """``rows`` with their 0-based place in the order of ``by``."""
    return running(rows, *by, amount=F.lit(1).cast("long"), to=to)


def midranks(rows: DataFrame, column: str, to: str) -> DataFrame:
    """``rows`` with the mean of the 1-based places that equal values of ``column`` share."""
    values = rows.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__count"))
    ranked = running(values, F.col("__value"), amount=F.col("__count"), to="__before")
    ranked = ranked.select("__value", (F.col("__before") + (F.col("__count") + 1) / 2).alias(to))
    return rows.join(ranked, F.col(column) == F.col("__value")).drop("__value")
