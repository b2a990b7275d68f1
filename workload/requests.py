"""The request workload: a few literal requests, and one per supplier, so that the request side grows; some are not valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.bindings import words
from workload.sql import quote

COLUMNS = "query_id q labels prices lat lng radius_km sort_mode page_offset page_limit user_id".split()
SCHEMA = (
    "query_id bigint, q string, labels string, prices string, lat double, lng double, radius_km double, "
    "sort_mode string, page_offset int, page_limit int, user_id bigint"
)
ROWS = [
    (0, "ther tion onre", None, None, None, None, None, "default", 0, 20, None),
    (1, "erer anan ", "vegan", None, None, None, None, "diet_first", 0, 20, 1),
    (2, "que les tion", None, None, None, None, None, "rating_first", 0, 15, 2),
    (3, "", None, None, None, None, None, "default", 0, 20, None),
    (4, None, "halal,keto", None, None, None, None, "default", 0, 20, 4),
    (5, "", None, "1,2", None, None, None, "rating_first", 20, 20, 5),
    (6, "", None, None, 39.95, 116.4, 5.0, "distance_first", 0, 20, 6),
    (7, "", "vegan,organic", None, 39.95, 116.4, 12.0, "distance_first", 0, 20, 7),
    (8, "erin thble", None, None, 39.95, 116.4, 10.0, "distance_first", 0, 20, 3),
    (9, "thre der und", None, "3", None, None, None, "default", 0, 20, 9),
    (10, "Vegan kitchen", None, None, None, None, None, "diet_first", 0, 20, 10),
    (11, "keto", None, None, None, None, None, "no_such_mode", 0, 20, 1),
    (12, "ther tion onre", None, None, None, None, None, "rating_first", 0, 20, 12),
    (13, "Ther tion, onre", None, None, None, None, None, "default", 10, 10, 13),
    (14, "zzzz", None, None, None, None, None, "default", 0, 20, None),
    (15, "find kitchen-src5 en", None, None, None, None, None, "default", 0, 20, 15),
    (16, "the best of", None, "4", None, None, None, "default", 0, 10, 16),
    (17, "vegn kitchn ther", None, None, None, None, None, "default", 0, 20, 17),
    (18, "rue street", None, None, 39.9, 116.3, None, "distance_first", 0, 20, 18),
    (19, "ther thed", "gluten-free", "1,3", 39.95, 116.4, 50.0, "diet_first", 0, 100, 19),
]


# words, filters and places that many ask for, under different modes, pages and users
GROWING = """
SELECT 100 + s_suppkey AS query_id,
       CASE s_suppkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'ther tion' WHEN 2 THEN concat('kitchen src', CAST(s_suppkey % 4 AS STRING)) WHEN 3 THEN NULL WHEN 4 THEN 'vegan kitchn'
            WHEN 5 THEN 'que les' WHEN 6 THEN concat('rue street ', CAST(s_suppkey % 4 AS STRING)) WHEN 7 THEN 'erer anan' ELSE 'find halal food' END AS q,
       CASE s_suppkey % 4 WHEN 0 THEN 'vegan' WHEN 1 THEN 'halal,organic' ELSE NULL END AS labels,
       CASE s_suppkey % 4 WHEN 2 THEN '1,2' WHEN 3 THEN '4' ELSE NULL END AS prices,
       CASE WHEN s_suppkey % 41 = 0 THEN 95e0 WHEN s_suppkey % 3 = 0 THEN 39.8e0 + (s_suppkey % 4) / 10e0 END AS lat,
       CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 41 = 0 THEN 116.2e0 + (s_suppkey % 4) / 10e0 END AS lng,
       CASE WHEN s_suppkey % 37 = 0 THEN 60e0 WHEN s_suppkey % 2 = 0 THEN 2e0 + 6 * (s_suppkey % 4) END AS radius_km,
       CASE s_suppkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'diet_first' WHEN 2 THEN 'rating_first' ELSE 'distance_first' END AS sort_mode,
       CAST(CASE WHEN s_suppkey % 43 = 0 THEN -1 WHEN s_suppkey % 6 = 0 THEN 20 ELSE 0 END AS INT) AS page_offset,
       CAST(CASE WHEN s_suppkey % 31 = 0 THEN 0 WHEN s_suppkey % 29 = 0 THEN 101 WHEN s_suppkey % 10 = 0 THEN 50 ELSE 10 END AS INT) AS page_limit,
       CASE WHEN s_suppkey % 8 <> 0 THEN s_suppkey END AS user_id
FROM {supplier}
"""
#: Oracle of the request checks, problem by problem.
PROBLEMS = """concat_ws(',', CASE WHEN length(q) > 500 THEN 'q' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' END,
    CASE WHEN lng NOT BETWEEN -180 AND 180 THEN 'lng' END, CASE WHEN radius_km NOT BETWEEN 0.1e0 AND 50 THEN 'radius_km' END,
    CASE WHEN page_offset < 0 THEN 'offset' END, CASE WHEN page_limit NOT BETWEEN 1 AND 100 THEN 'limit' END)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = spark.sql(GROWING, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    rows = spark.createDataFrame(ROWS, SCHEMA).unionByName(grown)
    return rows.select(
        "query_id", "q",
        words("labels").alias("diet_labels"),
        words("prices").cast("array<int>").alias("price_levels"),
        "lat", "lng", F.coalesce("radius_km", F.lit(5.0)).alias("radius_km"), "sort_mode",
        F.col("page_offset").alias("offset"), F.col("page_limit").alias("limit"), "user_id",
    )


def requests_cte() -> str:
    rows = ",\n  ".join(
        "(" + ", ".join(f"{v}e0" if isinstance(v, float) else quote(v) for v in row) + ")" for row in ROWS
    )
    literal = f"SELECT * REPLACE (CAST(query_id AS BIGINT) AS query_id) FROM (VALUES\n  {rows}) r({', '.join(COLUMNS)})"
    grown = GROWING.replace("{supplier}", "supplier")
    return f"asked AS ({literal} UNION ALL BY NAME {grown}), requests AS (SELECT * FROM asked WHERE {PROBLEMS} = '')"
