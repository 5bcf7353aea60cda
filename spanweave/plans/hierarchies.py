"""Queries over structure nodes as forests, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..runtime import table


def _resolved(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "structure_nodes"), "document_id", "id", "parent_id", "level", ("seq", "loaded_at"), paths)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.findings(_resolved(spark, d, False)).select(F.col("scope").alias("document_id"), F.col("node").alias("node_id"), "finding")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, True).select(
        F.col("scope").alias("document_id"), F.col("node").alias("node_id"), "status", "depth", F.col("root").alias("root_id"), "path", "descendants")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its descendants."""
    return hierarchy.descendants(_resolved(spark, d, False)).select(
        F.col("scope").alias("document_id"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


_NODES = """
n AS (SELECT document_id, id, parent_id, level FROM (
        SELECT *, row_number() OVER (PARTITION BY document_id, id ORDER BY seq, loaded_at, parent_id) AS rn
        FROM structure_nodes WHERE document_id IS NOT NULL AND id IS NOT NULL) WHERE rn = 1),
up AS (SELECT n.document_id, n.id, n.parent_id AS anc FROM n JOIN n p ON p.document_id = n.document_id AND p.id = n.parent_id
       UNION
       SELECT up.document_id, up.id, n.parent_id FROM up JOIN n ON n.document_id = up.document_id AND n.id = up.anc
         JOIN n p ON p.document_id = n.document_id AND p.id = n.parent_id),
cyc AS (SELECT DISTINCT document_id, id FROM up WHERE anc = id),
below AS (SELECT DISTINCT up.document_id, up.id FROM up JOIN cyc ON cyc.document_id = up.document_id AND cyc.id = up.anc
          WHERE NOT EXISTS (SELECT 1 FROM cyc c WHERE c.document_id = up.document_id AND c.id = up.id)),
missing AS (SELECT n.document_id, n.id FROM n WHERE n.parent_id IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM n p WHERE p.document_id = n.document_id AND p.id = n.parent_id)),
depths AS (SELECT n.document_id, n.id, n.level, count(up.anc) + 1 AS depth,
                  bool_or(r.id IS NOT NULL) OR n.parent_id IS NULL AS rooted
           FROM n LEFT JOIN up ON up.document_id = n.document_id AND up.id = n.id
             LEFT JOIN n r ON r.document_id = up.document_id AND r.id = up.anc AND r.parent_id IS NULL
           GROUP BY n.document_id, n.id, n.level, n.parent_id)"""

_WAYS = f"""{_NODES},
linked AS (SELECT n.document_id, n.id, n.parent_id FROM n JOIN n p ON p.document_id = n.document_id AND p.id = n.parent_id
           WHERE NOT EXISTS (SELECT 1 FROM cyc c WHERE c.document_id = n.document_id AND c.id = n.id)),
way AS (SELECT document_id, id, parent_id AS anc, 1 AS distance FROM linked
        UNION ALL
        SELECT w.document_id, w.id, l.parent_id, w.distance + 1 FROM way w JOIN linked l ON l.document_id = w.document_id AND l.id = w.anc)"""

QUERIES = {f.__name__: f for f in (p6_found, p6_hierarchy, p6_descendants)}
SQL = {
    "p6_found": f"""WITH RECURSIVE {_NODES}
SELECT document_id, id AS node_id, 'cycle' AS finding FROM cyc
UNION ALL SELECT document_id, id, 'below_cycle' FROM below
UNION ALL SELECT document_id, id, 'missing_parent' FROM missing
UNION ALL SELECT document_id, id, 'wrong_level' FROM depths WHERE rooted AND level IS NOT NULL AND level <> depth""",
    "p6_descendants": f"""WITH RECURSIVE {_WAYS}
SELECT document_id, anc AS node_id, id AS descendant_id, CAST(distance AS INTEGER) AS distance FROM way""",
    "p6_hierarchy": f"""WITH RECURSIVE {_WAYS},
above AS (SELECT document_id, id, count(*) + 1 AS depth, arg_max(anc, distance) AS top, string_agg(anc, '/' ORDER BY distance DESC) AS over FROM way GROUP BY ALL),
below_n AS (SELECT document_id, anc AS id, count(*) AS k FROM way GROUP BY ALL),
named AS (SELECT n.document_id, n.id, coalesce(a.top, n.id) AS top, coalesce(a.depth, 1) AS depth, coalesce(a.over || '/', '') || n.id AS path, coalesce(b.k, 0) AS k
          FROM n LEFT JOIN above a ON a.document_id = n.document_id AND a.id = n.id LEFT JOIN below_n b ON b.document_id = n.document_id AND b.id = n.id),
told AS (SELECT m.*, CASE WHEN c.id IS NOT NULL THEN CASE WHEN m.top = m.id THEN 'cycle' ELSE 'below_cycle' END
                          WHEN t.parent_id IS NULL THEN CASE WHEN m.top = m.id THEN 'root' ELSE 'child' END
                          WHEN m.top = m.id THEN 'missing_parent' ELSE 'below_missing' END AS status
         FROM named m JOIN n t ON t.document_id = m.document_id AND t.id = m.top
              LEFT JOIN cyc c ON c.document_id = m.document_id AND c.id = m.top)
SELECT document_id, id AS node_id, status, CASE WHEN status NOT LIKE '%cycle' THEN CAST(depth AS INTEGER) END AS depth,
       CASE WHEN status NOT LIKE '%cycle' THEN top END AS root_id, CASE WHEN status NOT LIKE '%cycle' THEN path END AS path, CAST(k AS BIGINT) AS descendants FROM told""",
}
