"""Reading, cleaning, checkpointing and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = "t_dat date, customer_id string, article_id string, price double, sales_channel_id int"
CUSTOMERS = "customer_id string, FN double, Active double, club_member_status string, fashion_news_frequency string, age int, postal_code string"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a given schema; ids keep their leading zeros."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def cleaned_articles(raw: DataFrame) -> DataFrame:
    """Missing descriptions become empty."""
    return raw.withColumn("detail_desc", F.coalesce("detail_desc", F.lit("")))


def cleaned_customers(raw: DataFrame) -> DataFrame:
    """Missing activity becomes 0, a missing club status UNKNOWN."""
    return raw.withColumn("Active", F.coalesce("Active", F.lit(0.0))).withColumn("club_member_status", F.coalesce("club_member_status", F.lit("UNKNOWN")))


def by_day(transactions: DataFrame) -> DataFrame:
    """Transactions dealt by day range and sorted, so that files hold consecutive days."""
    return transactions.repartitionByRange("t_dat").sortWithinPartitions("t_dat")


def split_by_date(txn: DataFrame, train_end: str, val_end: str, test_end: str | None = None) -> DataFrame:
    """``split``: train, val or test by day, ends included; later rows are dropped."""
    d = F.col("t_dat").cast("date")
    own = txn if test_end is None else txn.where(d <= F.lit(test_end).cast("date"))
    return own.withColumn("split", F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(val_end).cast("date"), "val").otherwise("test"))


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """A feature store: one Parquet table for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it lacks; lists and maps as JSON text."""
    return as_json(old).join(new.select(key).distinct(), key, "left_anti").unionByName(as_json(new), allowMissingColumns=True)


def as_json(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f.name) for f in df.schema])


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids that have no result yet."""
    return ids.join(done.select(key).distinct(), key, "left_anti")


def chunked(lines: DataFrame, id: str, line: str, most_bytes: int, most_lines: int) -> DataFrame:
    """``lines`` with ``chunk``: packed in one order of their ids, which are unique, a new chunk
    where the next line would exceed the bytes or the number of lines."""
    from ..operators import packing

    sized = lines.select(id, (F.octet_length(line) + 1).alias("size"))
    return lines.join(packing.numbered(sized, id, "size", most_bytes, most_lines).drop("place"), id)


def with_fallback(wanted: DataFrame, found: DataFrame, templates: DataFrame, key: str, source: str = "profile_source") -> DataFrame:
    """Results of all ``wanted`` keys: those ``found``, and for keys that have none (their request
    failed) the row of ``templates``; ``source`` tells which. A key without either is missing."""
    own = found.join(wanted.select(key).distinct(), key, "left_semi").withColumn(source, F.lit("model"))
    failed = pending(wanted.select(key).distinct(), found, key)
    return own.unionByName(templates.join(failed, key, "left_semi").withColumn(source, F.lit("template_fallback")), allowMissingColumns=True)


def parsed_responses(lines: DataFrame, payload: str, order: str = "file_no") -> DataFrame:
    """(custom_id, parsed, ok) of JSON response lines (``line``, and ``order`` of their files):
    lines with an error are skipped, later files win, what can't be parsed has ok = false."""
    own = lines.select(order, F.get_json_object("line", "$.custom_id").alias("custom_id"), F.get_json_object("line", "$.error").alias("error"), F.get_json_object("line", "$.response.body.output[0].content[0].text").alias("text"))
    own = own.where("error is null and custom_id is not null")
    last = own.withColumn("_k", F.row_number().over(W.partitionBy("custom_id").orderBy(F.desc(order), F.desc("text")))).where("_k = 1")
    parsed = F.from_json("text", payload)
    return last.select("custom_id", parsed.alias("parsed"), (parsed.isNotNull() & F.col("text").rlike("^\\s*\\{.*\\}\\s*$")).alias("ok"))


def image_paths(articles: DataFrame, id: str = "article_id") -> DataFrame:
    """(id, path): where the picture of an article would lie."""
    padded = F.lpad(F.col(id).cast("string"), 10, "0")
    return articles.select(id, F.concat(F.lit("images/"), F.substring(padded, 1, 3), F.lit("/"), padded, F.lit(".jpg")).alias("path"))


def encoded_images(files: DataFrame) -> DataFrame:
    """(path, content) of a binaryFile scan as base64 text."""
    return files.select("path", F.base64("content").alias("content"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists, maps and structs as JSON text."""
    as_json(df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def processed(rows: DataFrame, work, key: str, path: str, batches: int = 10) -> DataFrame:
    """Results of ``work`` on all ``rows``, kept under ``path`` in parts by hash of ``key``; a
    run that is taken up again does only rows whose key has no result yet."""
    spark = rows.sparkSession
    for k in range(batches):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        done = _existing(spark, path)
        if done is not None:
            part = pending(part, done, key)
        work(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None
