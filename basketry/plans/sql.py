"""One SQL text for two engines.

A plan is a function of a :class:`Dialect`, which spells the few constructs that differ. The
Spark text is what the engine runs; the other text is its check on the same Parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "pages", "benchmark", "conversations")

TRAIN_END, VAL_END = "2000-12-31", "2001-04-30"

#: Retail views over the sample tables; the same text in both engines.
VIEWS = {
    "txn": """SELECT CAST(o.o_orderdate AS DATE) AS t_dat, o.o_custkey AS customer_id, l.l_partkey AS article_id,
        l.l_extendedprice AS price, CASE WHEN l.l_linestatus = 'O' THEN 2 ELSE 1 END AS sales_channel_id
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "articles": """SELECT p_partkey AS article_id, p_name AS product_code, p_brand AS product_type_name,
        p_type AS colour_group_name, CONCAT('G', CAST(p_size % 5 AS STRING)) AS garment_group_name,
        CONCAT('S', CAST(p_size % 10 AS STRING)) AS section_name,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CONCAT('I', CAST(p_partkey % 3 AS STRING)) END AS index_name
        FROM part""",
    "customers": """SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(15 + c_custkey % 70 AS INT) END AS age,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'ACTIVE' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'PRE-CREATE' WHEN c_mktsegment = 'MACHINERY' THEN 'LEFT CLUB' ELSE c_mktsegment END AS club_member_status,
        CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'Monthly' WHEN c_custkey % 2 = 0 THEN 'Regularly' ELSE 'NONE' END AS fashion_news_frequency FROM customer""",
    "fk": """SELECT p_partkey AS article_id,
        CASE p_size % 3 WHEN 0 THEN 'Apparel' WHEN 1 THEN 'Footwear' ELSE 'Accessories' END AS super_category,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END AS l1_material,
        CASE p_partkey % 3 WHEN 0 THEN '["Casual","Sporty"]' WHEN 1 THEN '["Classic"]' ELSE NULL END AS l2_style_mood,
        CAST(1 + p_size % 5 AS INT) AS l2_perceived_quality,
        CASE p_size % 4 WHEN 0 THEN 'Classic' WHEN 1 THEN 'Current' WHEN 2 THEN 'Emerging' ELSE 'Dated' END AS l2_trendiness,
        CAST(1 + p_partkey % 5 AS INT) AS l3_visual_weight,
        CASE p_partkey % 4 WHEN 0 THEN 'Monochromatic' WHEN 1 THEN 'Analogous' ELSE 'Neutral' END AS l3_color_harmony
        FROM part WHERE p_partkey % 23 <> 0""",
    "fx": """SELECT article_id, super_category, l2_style_mood, l3_visual_weight, l3_color_harmony, CASE article_id % 4 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Statement' WHEN 2 THEN 'Accent' END AS l3_coordination_role,
        CASE article_id % 3 WHEN 0 THEN 'I-line' WHEN 1 THEN 'O-line' ELSE 'A-line' END AS l3_silhouette, CASE article_id % 5 WHEN 0 THEN 'Slim' WHEN 1 THEN 'Oversized' WHEN 2 THEN 'Regular' WHEN 3 THEN 'Boxy' ELSE 'Skinny' END AS l1_fit,
        CASE article_id % 6 WHEN 0 THEN 'Sleeveless' WHEN 1 THEN 'Long' WHEN 2 THEN 'N/A' WHEN 3 THEN 'Short' END AS l1_sleeve_type, CASE WHEN article_id % 7 < 3 THEN 'Strapless' ELSE 'Crew' END AS l1_neckline,
        CASE WHEN article_id % 9 < 3 THEN 'Winter' WHEN article_id % 9 < 8 THEN 'Summer' END AS l2_season_fit, CASE WHEN article_id % 8 < 4 THEN 'Foam' ELSE 'Rubber' END AS l1_sole_type,
        CASE WHEN article_id % 10 < 5 THEN 'Storage' ELSE 'Decoration' END AS l1_primary_function, CASE article_id % 4 WHEN 0 THEN 'Mini' WHEN 1 THEN 'Compact' ELSE 'Large' END AS l1_form_factor,
        CASE article_id % 5 WHEN 0 THEN 'Wrist' WHEN 1 THEN 'Finger' ELSE 'Shoulder' END AS l1_wearing_method, CASE article_id % 11 WHEN 0 THEN 'Petite' WHEN 1 THEN 'Small' WHEN 2 THEN 'Large' END AS l1_size_scale,
        CASE WHEN article_id % 6 < 3 THEN 'Stiletto' ELSE 'Flat' END AS l1_heel_type, CASE article_id % 4 WHEN 0 THEN '["Work","Party"]' WHEN 1 THEN '["Outdoor"]' WHEN 2 THEN '["Daily"]' END AS l2_occasion,
        CASE article_id % 5 WHEN 0 THEN '["Punk","Grunge"]' WHEN 1 THEN '["Streetwear"]' WHEN 2 THEN '["Minimal"]' END AS l3_style_lineage FROM fk""",
    "train": f"SELECT * FROM txn WHERE t_dat <= DATE '{TRAIN_END}'",
    "val": f"SELECT * FROM txn WHERE t_dat > DATE '{TRAIN_END}' AND t_dat <= DATE '{VAL_END}'",
    "test": f"SELECT * FROM txn WHERE t_dat > DATE '{VAL_END}'",
}


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def days(self, start: str, end: str) -> str:
        """Whole days from start to end."""
        return f"CAST(datediff({end}, {start}) AS BIGINT)" if self.spark else f"CAST(date_diff('day', {start}, {end}) AS BIGINT)"

    def isodow(self, d: str) -> str:
        return f"CAST(weekday({d}) + 1 AS BIGINT)" if self.spark else f"CAST(isodow({d}) AS BIGINT)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})" if self.spark else f"quantile_cont({x}, {p})"


SPARK, OTHER = Dialect(True), Dialect(False)
Plan = Callable[[Dialect], str]


def text(plan: Plan, dialect: Dialect) -> str:
    """The plan with those retail views that it names, in front."""
    body = plan(dialect).strip()
    recursive = "RECURSIVE " if body[:14].upper() == "WITH RECURSIVE" else ""
    if recursive:
        body = f"WITH{body[14:]}"
    rest = f", {body[4:].lstrip()}" if body[:4].upper() == "WITH" else f" {body}"
    need: list[str] = []

    def add(where: str) -> None:
        for name in VIEWS:
            if name not in need and _names(where, name):
                add(VIEWS[name])
                if name not in need:
                    need.append(name)

    add(body)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return f"WITH {recursive}{head}{rest}" if need else body.replace("WITH", f"WITH {recursive}".rstrip(), 1) if recursive else body


def _names(where: str, name: str) -> bool:
    import re

    return bool(re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", where, re.IGNORECASE))


def run(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    """The query of a plan."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if _names(text(plan, SPARK), name):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text(plan, SPARK))

    return query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A retail view as a DataFrame."""
    return run(lambda d: f"SELECT * FROM {name}")(spark, sf_dir)
