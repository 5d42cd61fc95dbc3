"""Domain tables built from the given tables, and the same tables as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlore.queries.registry import Tables


def sales_input(t: Tables, *wanted: str) -> DataFrame:
    """One row per order line with exact money columns and the wanted roles, all by default.

    Only the tables those roles come from are joined (every key has its match, so leaving
    a table out loses nothing). The optimizer broadcasts what it measures to be small and
    shuffles the rest.
    """
    roles = set(wanted or ("customer", "product", "article", "category", "region", "date",
                           "quantity", "revenue", "profit"))
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"),
        (price * (1 - discount)).cast("decimal(18,4)").alias("revenue"),
        (price * (F.lit("0.40").cast("decimal(4,2)") - discount)).cast("decimal(18,4)").alias("profit"),
    )
    if roles & {"customer", "region", "date"}:
        orders = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("date"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if roles & {"customer", "region"}:
        customers = t.customer.select("c_custkey", "c_nationkey", F.col("c_name").alias("customer"))
        rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if "region" in roles:
        nations = t.nation.select("n_nationkey", F.col("n_name").alias("region"))
        rows = rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    if roles & {"product", "article", "category"}:
        parts = t.part.select("p_partkey", F.col("p_brand").alias("product"),
                              F.col("p_type").alias("category"), F.col("p_name").alias("article"))
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*sorted(roles))


SALES = """sales AS (
  SELECT c_name AS customer, p_brand AS product, p_name AS article, p_type AS category,
         n_name AS region, o_orderdate AS date, l_quantity AS quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS revenue,
         CAST(CAST(l_extendedprice AS DECIMAL(14,2))
              * (CAST('0.40' AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""
