"""All queries of the library's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The tables of a folder, and the panel that most queries read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.cells = spark, folder, None

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def cell(self) -> DataFrame:
        """unit (nation), parent (region), event (year), block (return flag), votes.

        The sums are stored, as the panel and all that is joined to it read them many times: the large tables are read and shuffled
        once. Orders meet their customers first, so that the lines are shuffled for one join alone."""
        from arealis.sources.io import stored

        if self.cells is not None:
            return self.cells
        lines = self.lineitem.select("l_orderkey", "l_returnflag", "l_quantity")
        orders = self.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("event"))
        people = self.customer.select("c_custkey", "c_nationkey").join(self.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        joined = lines.join(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        keys = [F.col("n_nationkey").cast("long").alias("unit"), F.col("n_regionkey").cast("long").alias("parent"), "event", F.col("l_returnflag").alias("block")]
        self.cells = stored(joined.groupBy(*keys).agg(F.sum("l_quantity").alias("votes")), "cells")
        return self.cells

    def panel(self) -> DataFrame:
        """One row per unit and event: percentages of the blocks A, N, R and the total as weight."""
        from arealis.operators import panel as P

        cells = P.share(self.cell(), ["unit", "event"], "votes")
        keys = ["unit", "parent", "event"]
        wide = P.block_pivot(cells, keys, "block", ["A", "N", "R"], "share")
        return wide.join(cells.groupBy(*keys).agg(F.sum("votes").alias("weight")), keys)


#: The same panel in SQL.
CELL = """cell AS (SELECT CAST(n_nationkey AS BIGINT) AS unit, CAST(n_regionkey AS BIGINT) AS parent, CAST(year(o_orderdate) AS BIGINT) AS event, l_returnflag AS block, sum(l_quantity) AS votes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""
PANEL = f"""{CELL}, panel AS (SELECT unit, parent, event, coalesce(100 * sum(votes) FILTER (block = 'A') / sum(votes), 0) AS A, coalesce(100 * sum(votes) FILTER (block = 'N') / sum(votes), 0) AS N,
coalesce(100 * sum(votes) FILTER (block = 'R') / sum(votes), 0) AS R, sum(votes) AS weight FROM cell GROUP BY 1, 2, 3)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as sums depend on the order of their terms; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


from arealis.plans import backtest_queries, join_queries, model_queries, more_queries, panel_queries, run_queries, scalar_queries, source_queries  # noqa: E402, F401
