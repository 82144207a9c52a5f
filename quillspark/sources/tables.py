"""Tables of a folder, and the logical views that the queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, confidence, seq: places and supplies of the sales tables; seq orders equal triples."""
    parts = [
        table(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("subject"), F.lit("belongs_to").alias("predicate"), _id("region", "n_regionkey").alias("object"), F.lit(0.95).alias("confidence"), F.col("n_nationkey").cast("long").alias("seq")),
        table(spark, sf_dir, "supplier").select(_id("supplier", "s_suppkey"), F.lit("located_in"), _id("nation", "s_nationkey"), F.lit(0.9), F.col("s_suppkey")),
        table(spark, sf_dir, "customer").select(_id("customer", "c_custkey"), F.lit("located_in"), _id("nation", "c_nationkey"), F.lit(0.9), F.col("c_custkey")),
        table(spark, sf_dir, "lineitem").select(_id("supplier", "l_suppkey"), F.lit("supplies"), _id("part", "l_partkey"), F.round(F.lit(0.5) + F.col("l_discount"), 6), F.col("l_orderkey")),
    ]
    return reduce(DataFrame.union, parts)


TRIPLES_SQL = """
triples AS (
  SELECT 'nation_' || n_nationkey AS subject, 'belongs_to' AS predicate, 'region_' || n_regionkey AS object, 0.95::double AS confidence, n_nationkey::bigint AS seq FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'located_in', 'nation_' || s_nationkey, 0.9::double, s_suppkey FROM supplier
  UNION ALL SELECT 'customer_' || c_custkey, 'located_in', 'nation_' || c_nationkey, 0.9::double, c_custkey FROM customer
  UNION ALL SELECT 'supplier_' || l_suppkey, 'supplies', 'part_' || l_partkey, round(0.5::double + l_discount, 6), l_orderkey FROM lineitem)"""


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, attribute, value, seq: the columns of part and supplier, unpivoted."""
    part = table(spark, sf_dir, "part").select(_id("part", "p_partkey").alias("entity"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    supplier = table(spark, sf_dir, "supplier").select(_id("supplier", "s_suppkey").alias("entity"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"))
    return part.unpivot(["entity", "seq"], ["name", "brand", "type"], "attribute", "value").union(supplier.unpivot(["entity", "seq"], ["name"], "attribute", "value")).select("entity", "attribute", "value", "seq")


ATTRIBUTES_SQL = """
attributes AS (
  SELECT 'part_' || p_partkey AS entity, 'name' AS attribute, p_name AS value, p_partkey AS seq FROM part
  UNION ALL SELECT 'part_' || p_partkey, 'brand', p_brand, p_partkey FROM part
  UNION ALL SELECT 'part_' || p_partkey, 'type', p_type, p_partkey FROM part
  UNION ALL SELECT 'supplier_' || s_suppkey, 'name', s_name, s_suppkey FROM supplier)"""
