"""Hierarchies of symbols (problem 7)."""

from pyspark.sql import functions as F

from siltstone.operators.hierarchy import descendants, hierarchy
from siltstone.plans.registry import query
from siltstone.sources.tables import table

_TREE = """
WITH RECURSIVE s AS (
  SELECT id, min(CASE WHEN trim(parent_id) <> '' THEN parent_id END) AS parent_id
  FROM symbols WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT s.id, p.id AS parent_id FROM s LEFT JOIN s p ON s.parent_id = p.id),
down AS (
  SELECT id, id AS root_id, 0 AS depth, [id] AS path FROM t WHERE parent_id IS NULL
  UNION ALL
  SELECT t.id, down.root_id, down.depth + 1, list_append(down.path, t.id) FROM t JOIN down ON t.parent_id = down.id),
lost AS (SELECT id, parent_id FROM t WHERE id NOT IN (SELECT id FROM down)),
up AS (SELECT id, parent_id AS a FROM lost UNION SELECT up.id, lost.parent_id FROM up JOIN lost ON up.a = lost.id),
ring AS (SELECT id FROM up WHERE id = a),
cyc AS (
  SELECT l.id, least(min(up.a), min(CASE WHEN l.id IN (SELECT id FROM ring) THEN l.id ELSE up.a END)) AS root_id
  FROM lost l JOIN up ON up.id = l.id AND up.a IN (SELECT id FROM ring) GROUP BY l.id)
"""


@query(
    "p7_found",
    _TREE
    + """SELECT id, root_id, CAST(depth AS INT) AS depth FROM down WHERE depth >= 3
UNION ALL SELECT id, root_id, CAST(-1 AS INT) AS depth FROM cyc""",
)
def p7_found(spark, base):
    tree = hierarchy(table(spark, base, "symbols"), with_path=False)
    return tree.where("depth >= 3 or depth = -1").select("id", "root_id", "depth")


@query(
    "p7_hierarchy",
    _TREE
    + """SELECT id, root_id, CAST(depth AS INT) AS depth, FALSE AS in_cycle, array_to_string(path, '/') AS path FROM down
UNION ALL SELECT id, root_id, CAST(-1 AS INT), TRUE, NULL FROM cyc""",
)
def p7_hierarchy(spark, base):
    tree = hierarchy(table(spark, base, "symbols"))
    return tree.select("id", "root_id", "depth", "in_cycle", F.array_join("path", "/").alias("path"))


@query(
    "p7_descendants",
    _TREE
    + """SELECT path[CAST(i AS BIGINT)] AS ancestor_id, id AS descendant_id, CAST(depth - (i - 1) AS INT) AS distance
FROM down, unnest(range(1, depth + 1)) AS u(i)""",
)
def p7_descendants(spark, base):
    return descendants(hierarchy(table(spark, base, "symbols")))
