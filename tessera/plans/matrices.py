"""The matrices that the registered queries derive from the tables, in DataFrames and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import SparseMatrix, SparseVector
from ..operators.indexing import index_list
from ..sources import build

SQL = {
    "OP": "SELECT l_orderkey + 1 AS i, l_partkey + 1 AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "PS": "SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "OS": "SELECT l_orderkey + 1 AS i, l_suppkey + 1 AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "DZ": "SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "CO": "SELECT o_custkey + 1 AS i, o_orderkey + 1 AS j, CAST(1 AS BIGINT) AS v FROM orders",
    "UE": "SELECT user_id + 1 AS i, t AS j, CAST(COUNT(*) AS BIGINT) AS v FROM events JOIN (SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY event_type) AS BIGINT) AS t FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) GROUP BY 1, 2",
    "NN": "SELECT CAST(c_nationkey + 1 AS BIGINT) AS i, CAST(s_nationkey + 1 AS BIGINT) AS j, CAST(COUNT(*) AS BIGINT) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "px": "SELECT p_partkey + 1 AS i, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size <= 5",
    "py": "SELECT p_partkey + 1 AS i, CAST(p_size AS BIGINT) - 25 AS v FROM part WHERE p_size >= 4 AND p_size <= 30",
    "sx": "SELECT s_suppkey + 1 AS i, CAST(s_nationkey AS BIGINT) AS v FROM supplier WHERE s_nationkey <= 12",
    "N_ORDERS": "SELECT COUNT(*) AS n FROM orders", "N_PART": "SELECT COUNT(*) AS n FROM part", "N_SUPP": "SELECT COUNT(*) AS n FROM supplier", "N_CUST": "SELECT COUNT(*) AS n FROM customer",
    "GRID": "SELECT a.k AS i, b.k AS j FROM (SELECT p_partkey + 1 AS k FROM part WHERE p_partkey < 40) a, (SELECT s_suppkey + 1 AS k FROM supplier WHERE s_suppkey < 10) b",
    # DZ with every part one row further, so that its pattern differs.
    "DZ2": "SELECT (l_partkey + 1) % (SELECT COUNT(*) FROM part) + 1 AS i, l_suppkey + 1 AS j, CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    # The corner of DZ with 40 x 10 cells, small enough for dense results.
    "SM": "SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE l_partkey < 40 AND l_suppkey < 10 GROUP BY 1, 2",
    "SM2": "SELECT l_partkey - 39 AS i, l_suppkey + 1 AS j, CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE l_partkey BETWEEN 40 AND 79 AND l_suppkey < 10 GROUP BY 1, 2",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


class Matrices:
    """Lazy handles on the tables of one folder; dimensions are one small aggregate each."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def size(self, name: str) -> int:
        return self.table(name).count()

    @cached_property
    def orders(self) -> int:
        return self.size("orders")

    @cached_property
    def parts(self) -> int:
        return self.size("part")

    @cached_property
    def suppliers(self) -> int:
        return self.size("supplier")

    @cached_property
    def customers(self) -> int:
        return self.size("customer")

    def lines(self, i: str, j: str, v: str = "CAST(l_quantity AS BIGINT)") -> DataFrame:
        return self.table("lineitem").select((F.col(i) + 1).alias("i"), (F.col(j) + 1).alias("j"), F.expr(v).alias("v"))

    @cached_property
    def OP(self) -> SparseMatrix:
        return build.sparse(self.lines("l_orderkey", "l_partkey"), self.orders, self.parts)

    @cached_property
    def PS(self) -> SparseMatrix:
        return build.sparse(self.lines("l_partkey", "l_suppkey"), self.parts, self.suppliers)

    @cached_property
    def OS(self) -> SparseMatrix:
        return build.sparse(self.lines("l_orderkey", "l_suppkey"), self.orders, self.suppliers)

    @cached_property
    def DZ(self) -> SparseMatrix:
        return build.sparse(self.lines("l_partkey", "l_suppkey", "CAST(round(l_discount * 100) AS BIGINT)"), self.parts, self.suppliers)

    @cached_property
    def CO(self) -> SparseMatrix:
        return build.from_table(self.table("orders"), "o_custkey", "o_orderkey", F.lit(1).cast("long"), self.customers, self.orders)

    @cached_property
    def UE(self) -> SparseMatrix:
        e = self.table("events")
        kinds = e.select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).cast("long").alias("j"))
        df = e.join(kinds, "event_type").groupBy((F.col("user_id") + 1).alias("i"), "j").agg(F.count("*").alias("v"))
        return SparseMatrix(df, build.inferred(df, "i"), 5)

    @cached_property
    def NN(self) -> SparseMatrix:
        li, o, c, s = (self.table(t) for t in ("lineitem", "orders", "customer", "supplier"))
        df = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
        df = df.groupBy((F.col("c_nationkey") + 1).cast("long").alias("i"), (F.col("s_nationkey") + 1).cast("long").alias("j")).agg(F.count("*").alias("v"))
        return SparseMatrix(df, 25, 25)

    @cached_property
    def px(self) -> SparseVector:
        return SparseVector(self.table("part").where("p_size <= 5").select((F.col("p_partkey") + 1).alias("i"), F.col("p_size").cast("long").alias("v")), self.parts)

    @cached_property
    def py(self) -> SparseVector:
        return SparseVector(self.table("part").where("p_size BETWEEN 4 AND 30").select((F.col("p_partkey") + 1).alias("i"), (F.col("p_size").cast("long") - 25).alias("v")), self.parts)

    @cached_property
    def sx(self) -> SparseVector:
        return SparseVector(self.table("supplier").where("s_nationkey <= 12").select((F.col("s_suppkey") + 1).alias("i"), F.col("s_nationkey").cast("long").alias("v")), self.suppliers)

    def small(self, first: int) -> SparseMatrix:
        df = self.table("lineitem").where(F.col("l_partkey").between(first, first + 39) & (F.col("l_suppkey") < 10))
        return build.sparse(df.select((F.col("l_partkey") + 1 - first).alias("i"), (F.col("l_suppkey") + 1).alias("j"), F.expr("CAST(round(l_discount * 100) AS BIGINT)").alias("v")), 40, 10)

    @cached_property
    def SM(self) -> SparseMatrix:
        return self.small(0)

    @cached_property
    def SM2(self) -> SparseMatrix:
        return self.small(40)

    def indices(self, values) -> DataFrame:
        return index_list(self.spark, values)

    def row(self, **values) -> DataFrame:
        """One row. A missing value has no type to infer; those of the queries that can be missing are whole numbers."""
        out = self.spark.createDataFrame([tuple(0 if v is None else v for v in values.values())], list(values))
        return out.withColumns({n: F.lit(None).cast("long") for n, v in values.items() if v is None})


class Whole(Matrices):
    """The same handles with the whole of ``lineitem`` in place of the corners SM and SM2."""

    @cached_property
    def SM(self) -> SparseMatrix:
        return self.DZ

    @cached_property
    def SM2(self) -> SparseMatrix:
        df = self.lines("l_partkey", "l_suppkey", "CAST(round(l_discount * 100) AS BIGINT)")
        return build.sparse(df.withColumn("i", F.col("i") % self.parts + 1), self.parts, self.suppliers)
