"""The seven star-schema queries.

Predicates are ranges on the scanned columns, so they reach the Parquet scan; joins carry no hints: small dimensions are
broadcast when their measured size allows it, and large ones are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.tables import after, prefix_range

Tables = Callable[[str], DataFrame]


def q1(t: Tables, date: str) -> DataFrame:
    return t("lineitem").where(prefix_range("l_shipdate", date)).agg(F.count(F.lit(1)).alias("cnt"))


def q2(t: Tables, date: str, top: int = 20) -> DataFrame:
    shipped = t("lineitem").where(prefix_range("l_shipdate", date)).select("l_orderkey")
    rows = shipped.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", "o_orderkey")
    return rows.orderBy("o_orderkey", "o_orderpriority").limit(top)


def q3(t: Tables, date: str, top: int = 20) -> DataFrame:
    shipped = t("lineitem").where(prefix_range("l_shipdate", date))
    rows = shipped.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "p_name", "s_name").orderBy("l_orderkey", "p_name", "s_name").limit(top)


def q4(t: Tables, date: str) -> DataFrame:
    rows = t("lineitem").where(prefix_range("l_shipdate", date)).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("cnt")).orderBy("n_nationkey")


def q5(t: Tables, us: int = 24, ca: int = 3) -> DataFrame:
    """Line items by ship month of the customers of two nations, in one pass; months with both."""
    buyers = t("customer").where(F.col("c_nationkey").isin(us, ca)).select("c_custkey", "c_nationkey")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    count = lambda k: F.count(F.when(F.col("c_nationkey") == k, 1))
    months = rows.groupBy(F.date_trunc("month", "l_shipdate").alias("m")).agg(count(us).alias("us"), count(ca).alias("ca")).where("us > 0 and ca > 0")
    return months.orderBy("m").select(F.date_format("m", "MM-yyyy").alias("month"), "us", "ca")


def q6(t: Tables, date: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t("lineitem").where(prefix_range("l_shipdate", date)).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 4).alias("sum_disc_price"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 6).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


def q7(t: Tables, date: str, top: int = 10) -> DataFrame:
    before, _ = after("o_orderdate", date)
    _, shipped_after = after("l_shipdate", date)
    orders = t("orders").where(before).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = t("lineitem").where(shipped_after).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)
    rows = rows.groupBy("c_name", "l_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority").agg(revenue.alias("revenue"))
    return rows.select("c_name", "l_orderkey", "revenue", "o_orderdate", "o_orderpriority").orderBy(F.desc("revenue"), "l_orderkey").limit(top)
