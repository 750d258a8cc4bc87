"""Reading and writing the tables of the library, and listings made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Offers of parts by three suppliers' groups as shop listings.  The same text runs on Spark and on other SQL engines.
LISTINGS_SQL = """
SELECT concat('s', CAST(s AS STRING), '-', CAST(pk AS STRING)) AS id, concat('s', CAST(s AS STRING)) AS source,
       CASE s WHEN 0 THEN concat(p_brand, ' ', p_name, ' ', p_type, ' ', CAST(p_size AS STRING), 'GB $', CAST(price AS STRING))
              WHEN 1 THEN concat(upper(p_name), ' ', CAST(p_size AS STRING), 'G ', p_brand, ' ', p_type, ' (bulk)')
              ELSE concat(p_brand, ' ', p_name, ' ', CAST(p_size AS STRING), 'GB ', p_type, ' <b>new</b> ') END AS raw_name,
       price, p_brand AS brand, lower(p_type) AS category, concat(lower(p_type), ' > ', p_name) AS subcategory, scraped_at, pk
FROM (SELECT l_partkey AS pk, l_suppkey % 3 AS s, CAST(floor(min(l_extendedprice / l_quantity)) AS BIGINT) AS price, max(l_shipdate) AS scraped_at
      FROM lineitem GROUP BY l_partkey, l_suppkey % 3) offer JOIN part ON p_partkey = pk"""

#: Price observations of products from the event stream: values in steps, so that some repeat.
OBSERVATIONS_SQL = "SELECT user_id AS product_id, CAST(floor(value / 50) AS BIGINT) AS price, ts AS recorded_at FROM events"
#: Run logs from the event stream.
LOGS_SQL = """SELECT concat('u', CAST(user_id % 7 AS STRING)) AS source, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       CAST(floor(value) AS INT) AS items_count, CASE WHEN event_type = 'error' THEN concat('failed ', CAST(event_id AS STRING)) END AS error_message, ts AS created_at
FROM events WHERE event_type IN ('error', 'purchase')"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write df; with partition columns only the partitions that df has are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def view(spark: SparkSession, folder: str, sql: str, *tables: str) -> DataFrame:
    """A query over tables of a folder."""
    return spark.sql(_named(sql, tables), args=None, **{t: read_table(spark, folder, t) for t in tables})


def _named(sql: str, tables: tuple[str, ...]) -> str:
    """The query with {table} where a table stands after FROM or JOIN."""
    for t in tables:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return sql


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return spread(view(spark, folder, LISTINGS_SQL, "lineitem", "part"), "id")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to all cores: names are costly to clean for their few bytes, by which Spark would merge partitions."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *by)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, OBSERVATIONS_SQL, "events")


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, LOGS_SQL, "events")
