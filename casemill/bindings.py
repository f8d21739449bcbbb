"""The driver's tables bound to roles: a case table, an event table and demographics, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions.roles import RoleMap

CASE_ROLES = RoleMap({"case_id": "id", "ts": "timestamp", "area": "admin_area_1", "category": "category", "status": "status", "money": "money", "lat": "latitude", "lng": "longitude"})
EVENT_ROLES = RoleMap({"event_id": "id", "ts": "timestamp", "area": "admin_area_1", "category": "category", "value": "measure", "lat": "latitude", "lng": "longitude"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str):
    return (12 + F.pmod(F.col(key), F.lit(97)) * 0.01).alias("lat"), (77 + F.pmod(F.col(key), F.lit(89)) * 0.01).alias("lng")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of their customer's nation."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("ts"), F.col("n_name").alias("area"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("money"), *place("o_orderkey"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("area"), F.col("event_type").alias("category"), "value", *place("event_id"))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation: customers as people, suppliers as density, mean balance as urbanization."""
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.count("*") * 1000).alias("population"), F.avg("c_acctbal").alias("urbanization_pct"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("density"))
    return nation.join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("area"), "population", "density", "urbanization_pct")


CASES_SQL = """cases AS (
  SELECT o_orderkey AS case_id, o_orderdate AS ts, n_name AS area, o_orderpriority AS category, o_orderstatus AS status,
         o_totalprice AS money, 12 + (o_orderkey % 97) * 0.01::DOUBLE AS lat, 77 + (o_orderkey % 89) * 0.01::DOUBLE AS lng
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
EVENTS_SQL = """ev AS (
  SELECT event_id, ts, 'A' || CAST(user_id % 10 AS VARCHAR) AS area, event_type AS category, value,
         12 + (event_id % 97) * 0.01::DOUBLE AS lat, 77 + (event_id % 89) * 0.01::DOUBLE AS lng FROM events)"""
DEMO_SQL = """demo AS (
  SELECT n_name AS area, population::DOUBLE AS population, density::DOUBLE AS density, urbanization
  FROM nation JOIN (SELECT c_nationkey, count(*) * 1000 AS population, avg(c_acctbal) AS urbanization FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT s_nationkey, count(*) AS density FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)"""
