"""Exact order, prefix sums, quantiles and top rows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordering import join_lookup, quantiles, ranked, tied, top_k
from .base import query, r6, table


@query("""
    SELECT o_orderkey, o_orderstatus, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n,
           round(COALESCE(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before_price
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)""")
def rank_within_status(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = ranked(rows, ["o_orderstatus"], ["o_totalprice", "o_orderkey"], {"price": "o_totalprice"})
    return out.select("o_orderkey", "o_orderstatus", "rn", "n", F.round("before_price", 2).alias("before_price"))


@query("SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) AS rn, count(*) OVER () AS n FROM documents")
def rank_whole_table(spark, sf):
    return ranked(table(spark, sf, "documents").select("doc_id", "text"), [], ["text", "doc_id"]).select("doc_id", "rn", "n")


@query("""
    SELECT l_returnflag, l_quantity, count(*) AS rows, (sum(count(*)) OVER w - count(*))::BIGINT AS before_rows,
           (sum(count(*)) OVER (PARTITION BY l_returnflag))::BIGINT AS total_rows
    FROM lineitem GROUP BY l_returnflag, l_quantity WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def tied_values(spark, sf):
    return tied(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "l_quantity", "rows", "before_rows", "total_rows")


@query("""
    SELECT l_returnflag, q, round(CASE q WHEN 0.05 THEN a WHEN 0.5 THEN b ELSE c END, 4) AS value FROM (
      SELECT l_returnflag, unnest([0.05, 0.5, 0.95])::DOUBLE AS q, quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.5) AS b,
             quantile_cont(l_extendedprice, 0.95) AS c FROM lineitem GROUP BY l_returnflag)""")
def exact_quantiles(spark, sf):
    return quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95]).withColumn("value", F.round("value", 4))


@query("""
    SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 5""")
def top_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_k(rows, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5, ["o_orderkey"])


@query("""
    SELECT l.l_returnflag, o.o_orderpriority, count(*) AS lines, round(sum(l.l_extendedprice / m.mean), 4) AS relative
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN (SELECT l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_returnflag) m ON m.l_returnflag = l.l_returnflag
    GROUP BY l.l_returnflag, o.o_orderpriority""")
def hot_key_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber")
    means = lines.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"))
    rows = join_lookup(lines, means, ["l_returnflag"], ["l_orderkey", "l_linenumber"], "inner")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return rows.join(orders, "l_orderkey").groupBy("l_returnflag", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") / F.col("mean")), 4).alias("relative")
    )
