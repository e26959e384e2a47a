"""Views over the given tables with nulls, padding and duplicate rows, for the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    repeated = orders.unionByName(orders.where(key % 50 == 0))
    priority = F.col("o_orderpriority")
    return repeated.select(
        key,
        "o_custkey",
        F.when(key % 97 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 13 == 0, F.concat(F.lit("  "), priority, F.lit(" ")))
        .otherwise(priority).alias("o_orderpriority"),
        F.lit("x").alias("const_col"),
        F.when(key % 5 == 0, F.lit("v")).alias("mostly_missing"),
        F.when(key % 101 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("num_text"),
    )


def lineitem_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").withColumn("l_quantity", quantity)


def labels_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id")


def events_holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 != 0, F.col("value"))
    return table(spark, sf_dir, "events").withColumn("value", value)
