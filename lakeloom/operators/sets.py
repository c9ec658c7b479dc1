"""Set operations."""

from __future__ import annotations

from lakeloom.registry import query
from lakeloom.tables import table

SIDES = ("SELECT user_id AS k FROM events WHERE event_type = 'click'", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW'")
WAYS = {
    "union": ("UNION", lambda a, b: a.unionByName(b).distinct()),
    "union_all": ("UNION ALL", lambda a, b: a.unionByName(b)),
    "intersect": ("INTERSECT", lambda a, b: a.intersect(b)),
    "intersect_all": ("INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    "except": ("EXCEPT", lambda a, b: a.subtract(b)),
    "except_all": ("EXCEPT ALL", lambda a, b: a.exceptAll(b)),
}
for _name, (_word, _way) in WAYS.items():

    @query(f"p23_{_name}", f"{SIDES[0]} {_word} {SIDES[1]}")
    def run(spark, sf_dir, way=_way):
        clicks = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id AS k")
        low = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").selectExpr("o_custkey AS k")
        return way(clicks, low)
