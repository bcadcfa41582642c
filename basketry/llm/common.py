"""Shared helpers: shared-folder tables, column idioms and graph components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of every contract: runs of anything but space and U+0009..U+000D.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir`` or
    ``SparkContext.setCheckpointDir``. Without it only a session whose executors share this
    machine may go on, in a folder of its own."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = own or spark.sparkContext.getCheckpointDir()
    if not own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        own = f"file:///tmp/basketry-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(own)
    return f"{own.rstrip('/')}/basketry-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def place_of(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that ``placed`` has added."""
    return docs._basketry_place


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Hadoop gives it."""
    files, hadoop = _file_system(spark, path)
    return files.makeQualified(hadoop).toString()


#: Paths of the tables stored in each open ``scratch``, innermost last.
_scratches: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, hadoop = _file_system(spark, path)
    files.deleteOnExit(hadoop)
    if _scratches:
        _scratches[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)
    files.cancelDeleteOnExit(hadoop)


def forget(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    delete(table.sparkSession, table._basketry_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Tables stored inside are deleted at its end, but for those given to ``keep``, which
    the yielded function is; these go with the scratch around it or with the application."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _scratches.append([])
    try:
        yield keep
    finally:
        own, stay = _scratches.pop(), {t._basketry_path for t in kept}
        for path in own:
            if path not in stay:
                delete(spark, path)
        if _scratches:
            _scratches[-1] += stay


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: the lineage
    ends there, and a lost executor costs nothing that was stored. ``files``: at most so
    many, for tables whose size is known to be small."""
    path = new_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._basketry_path = path
    return out


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row: a hash of its file's path and its number in the
    file, the same at every reading, in two columns whose names ``place_of`` tells. What isn't
    a plain table of files is stored first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stored(docs, "rows")
    file, at = free(docs, "__file"), free(docs, "__at")
    out = docs.withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")})
    out._basketry_place = file, at
    if hasattr(docs, "_basketry_path"):
        out._basketry_path = docs._basketry_path
    return out


#: Rows that a Python stage over texts takes at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For queries, whose session is their own: Arrow batches of texts take a few MB instead of
    the 64 that Spark allows. The operators leave the session's settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mapped(df: DataFrame, run, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches cut to at most ``rows`` rows. Python workers
    outlive their tasks, so each gives back at its end what it has freed."""

    def cut(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows):
                yield batch.slice(at, rows)

    def task(batches):
        try:
            yield from run(cut(batches))
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Free memory of this process goes to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once, also if ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: word ends are counted."""
    text = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(text, WORD_BREAK, -1))
    edge = lambda at: F.when(text.rlike(at), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(parts - edge("^[\\x20\\x09-\\x0D]") - edge("[\\x20\\x09-\\x0D]\\z")).cast("long")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


#: Edges that one file of a round holds, about.
EDGES_A_FILE = 500_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b of type long) as (node, root):
    a row for each node that is not the least of its component.

    Alternating large-star and small-star rounds, each stored in the shared folder. A hub
    is met with a map-side minimum and a join that adaptive execution can split, so no
    task has to hold all neighbours of a node.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before, files = None, max(4, e.count() // EDGES_A_FILE)  # no round has more edges than there are now
    while True:  # stars get shorter in every round until nothing moves
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges", files)
        forget(last)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
