"""Parquet tables, and the personal-record view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voilage import fixed_values as fixed
from voilage.config import Roles
from voilage.session import spread

CLIENT_ROLES = Roles(
    id="id_client",
    postal="code_postal",
    date1="date_naissance",
    revenue="revenu_annuel",
    sensitive="statut",
    qids=("date_naissance", "code_postal", "revenu_annuel"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def facts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows get the heavy per-row work, dealt out if it has few splits."""
    return spread(table(spark, folder, name))


def client_records(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One personal record per order, all cells text."""
    key = F.col("o_orderkey")
    region = F.col("c_nationkey") % 3
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.cast("string").alias("id_client"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@" + fixed.MAIL_DOMAIN)).alias("email"),
        F.concat(F.lit("418-555-"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("telephone"),
        F.concat(
            F.when(region == 0, "G7H").when(region == 1, "H2X").otherwise("J4K"),
            (key % 10).cast("string"),
            F.lit("B"),
            (F.col("c_custkey") % 10).cast("string"),
        ).alias("code_postal"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date_naissance"),
        F.floor("o_totalprice").cast("bigint").cast("string").alias("revenu_annuel"),
        F.col("c_mktsegment").alias("type_compte"),
        F.col("o_orderpriority").alias("statut"),
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    return client_records(facts(spark, folder, "orders"), table(spark, folder, "customer"))
