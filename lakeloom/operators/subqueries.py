"""Subqueries and recursion, in SQL."""

from __future__ import annotations

from lakeloom.registry import query
from lakeloom.tables import views

TEXTS = {
    "p17_exists_in": (
        """SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)
           AND EXISTS (SELECT 1 FROM {events} WHERE user_id = c_custkey AND event_type = 'error')""",
        ("customer", "orders", "events"),
    ),
    "p17_scalar_subquery": (
        """SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} AS o
           WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM {orders} AS i WHERE i.o_custkey = o.o_custkey)""",
        ("orders",),
    ),
    "p18_recursive_cte": (
        """WITH RECURSIVE bounds AS (SELECT CAST(min(year(o_orderdate)) AS INT) AS lo, CAST(max(year(o_orderdate)) AS INT) AS hi FROM {orders}),
           years AS (SELECT lo AS y, hi FROM bounds UNION ALL SELECT CAST(y + 1 AS INT), hi FROM years WHERE y < hi),
           sums AS (SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM {orders} GROUP BY 1)
           SELECT years.y AS order_year, coalesce(n, 0) AS n FROM years LEFT JOIN sums ON years.y = sums.y""",
        ("orders",),
    ),
}
for _name, (_text, _tables) in TEXTS.items():

    @query(_name, _text.format(**{t: t for t in _tables}))
    def run(spark, sf_dir, text=_text, tables=_tables):
        return spark.sql(text, **views(spark, sf_dir, *tables))


@query("p17_not_in", "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40 AND l_partkey IS NOT NULL)")
def not_in(spark, sf_dir):
    """NOT IN as an anti join that may shuffle: Spark's own NOT IN broadcasts all of the subquery's keys. A null key is in no result, unless the subquery is empty."""
    text = """SELECT p_partkey, p_brand FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_quantity >= 40 AND l_partkey = p_partkey)
              AND (p_partkey IS NOT NULL OR (SELECT count(l_partkey) FROM {lineitem} WHERE l_quantity >= 40) = 0)"""
    return spark.sql(text, **views(spark, sf_dir, "part", "lineitem"))
