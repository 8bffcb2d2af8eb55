"""The registered queries of the matrix operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .matrices import SQL, Matrices, Whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[[Matrices], DataFrame]] = {}

#: Queries of the corners SM and SM2 whose operators need no dense result; each runs as NAME_whole on the whole tables, too.
WHOLE = ("A06_mapreduce", "C03_hvcat", "C05_cat", "C08_repeat", "C09_pattern_sets", "E01_functions", "S26_complex", "U02_assign", "U03_fill_zero", "U07_mergeinds")


def query(name: str, sql: str | None = None):
    """Registers a function of the matrices under a name."""

    def put(f: Callable[[Matrices], DataFrame]):
        FUNCTIONS[name] = f
        QUERIES[name] = lambda spark, sf_dir: f(Matrices(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from . import queries_elementwise, queries_matrix, queries_more, queries_solve  # noqa: E402, F401


def whole_sql(sql: str) -> str:
    """The SQL of a query of the corners over the whole tables, whose shape takes the place of 40 x 10."""
    for a, b in ((SQL["SM2"], SQL["DZ2"]), (SQL["SM"], SQL["DZ"]), ("i + 40", "i + (SELECT COUNT(*) FROM part)"), ("j + 10", "j + (SELECT COUNT(*) FROM supplier)")):
        sql = sql.replace(a, b)
    return sql


for _name in WHOLE:
    QUERIES[f"{_name}_whole"] = lambda spark, sf_dir, f=FUNCTIONS[_name]: f(Whole(spark, sf_dir))
    ORACLES[f"{_name}_whole"] = whole_sql(ORACLES[_name])
