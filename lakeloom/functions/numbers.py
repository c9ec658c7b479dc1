"""Arithmetic."""

from __future__ import annotations

from lakeloom.registry import query
from lakeloom.tables import views

TEXT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, -2) AS hundreds, floor(l_extendedprice / 7) AS down, ceil(l_extendedprice / 7) AS up,
  l_quantity % 7 AS rest, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity), 6) AS logarithm, round(exp(l_discount), 6) AS growth,
  round(power(l_quantity, 1.5), 4) AS pow, sign(l_discount - 0.05) AS side, abs(l_discount - 0.05) AS off, greatest(l_discount, l_tax) AS most,
  least(l_discount, l_tax) AS fewest, {divided} AS per_discount, l_orderkey {div} 10 AS tens, round(degrees(atan2(l_tax, l_quantity)), 6) AS angle FROM {lineitem}"""


@query("p26_arithmetic", TEXT.replace("floor(l_extendedprice / 7)", "CAST(floor(l_extendedprice / 7) AS BIGINT)").replace("ceil(l_extendedprice / 7)", "CAST(ceil(l_extendedprice / 7) AS BIGINT)").replace("sign(l_discount - 0.05)", "CAST(sign(l_discount - 0.05) AS DOUBLE)").format(divided="round(l_tax / nullif(l_discount, 0), 6)", div="//", lineitem="lineitem"))
def arithmetic(spark, sf_dir):
    return spark.sql(TEXT.replace("l_discount - 0.05", "l_discount - 0.05D").format(divided="round(try_divide(l_tax, l_discount), 6)", div="div", lineitem="{lineitem}"), **views(spark, sf_dir, "lineitem"))
