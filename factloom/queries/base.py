"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with DuckDB SQL for its rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as triples: who supplies, places, lives where."""

    def named(kind: str, key: str):
        return F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))

    def rows(name: str, doc, chunk, head: str, head_key: str, relation: str, tail: str, tail_key: str, confidence, seq):
        h, t = named(head.lower(), head_key), named(tail.lower(), tail_key)
        return table(spark, sf_dir, name).select(
            doc.cast("string").alias("doc_id"), chunk.alias("chunk_id"), h.alias("head"), F.lit(head).alias("head_type"),
            F.lit(relation).alias("surface_relation"), F.lit(relation).alias("normalized_relation"), t.alias("tail"), F.lit(tail).alias("tail_type"),
            confidence.alias("confidence"), F.concat_ws(" ", h, F.lit(relation), t).alias("evidence"), F.lit(name).alias("source"), seq.cast("bigint").alias("seq"),
        )

    sure, base = F.lit(0.9), 10**15
    line = F.concat_ws("::", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    parts = [
        rows("lineitem", F.col("l_orderkey"), line, "Supplier", "l_suppkey", "supplies", "Part", "l_partkey", F.round(F.col("l_quantity") / 50, 2), (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")),
        rows("orders", F.col("o_orderkey"), F.lit(""), "Order", "o_orderkey", "placed_by", "Customer", "o_custkey", sure, F.col("o_orderkey") + base),
        rows("customer", F.lit("customer"), F.lit(""), "Customer", "c_custkey", "located_in", "Nation", "c_nationkey", sure, F.col("c_custkey") + 2 * base),
        rows("supplier", F.lit("supplier"), F.lit(""), "Supplier", "s_suppkey", "located_in", "Nation", "s_nationkey", sure, F.col("s_suppkey") + 3 * base),
        rows("nation", F.lit("nation"), F.lit(""), "Nation", "n_nationkey", "part_of", "Region", "n_regionkey", sure, F.col("n_nationkey") + 4 * base),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The same triples in SQL, as the first of a query's common table expressions.
FACTS = """
facts AS (
  SELECT CAST(l_orderkey AS VARCHAR) doc_id, l_orderkey || '::' || l_linenumber chunk_id, 'supplier ' || l_suppkey head, 'Supplier' head_type,
    'supplies' relation, 'part ' || l_partkey tail, 'Part' tail_type, round(l_quantity / 50, 2) confidence, 'lineitem' source, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey seq FROM lineitem
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '', 'order ' || o_orderkey, 'Order', 'placed_by', 'customer ' || o_custkey, 'Customer', 0.9, 'orders', o_orderkey + 1000000000000000 FROM orders
  UNION ALL SELECT 'customer', '', 'customer ' || c_custkey, 'Customer', 'located_in', 'nation ' || c_nationkey, 'Nation', 0.9, 'customer', c_custkey + 2000000000000000 FROM customer
  UNION ALL SELECT 'supplier', '', 'supplier ' || s_suppkey, 'Supplier', 'located_in', 'nation ' || s_nationkey, 'Nation', 0.9, 'supplier', s_suppkey + 3000000000000000 FROM supplier
  UNION ALL SELECT 'nation', '', 'nation ' || n_nationkey, 'Nation', 'part_of', 'region ' || n_regionkey, 'Region', 0.9, 'nation', n_nationkey + 4000000000000000 FROM nation
)
"""
