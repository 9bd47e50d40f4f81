"""Queries of the general training-data operators (problems 3 and 5)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.operators import orphans, packed
from kgloom.sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(packed.cells(table(spark, d, "entities")))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return packed.delimiter_profile(packed.cells(table(spark, d, "entities")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.graph_orphans(*[table(spark, d, n) for n in ("kb", "nodes", "linked_mentions", "triples")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tbl", "field", "row_id", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


_P5 = r"""
WITH k AS (SELECT DISTINCT upper(trim(entity_id)) id, added_at b, deleted_at e FROM kb WHERE entity_id IS NOT NULL),
n AS (SELECT DISTINCT upper(trim(node_id)) id, created_at b, removed_at e FROM nodes WHERE node_id IS NOT NULL),
r AS (
  SELECT DISTINCT 'linked_mentions' tbl, 'entity_id' field, CAST(mention_id AS VARCHAR) row_id, upper(trim(entity_id)) id, created_at t, 'k' src FROM linked_mentions
  UNION SELECT 'nodes', 'node_id', node_id, upper(trim(node_id)), created_at, 'k' FROM nodes WHERE upper(trim(node_id)) NOT LIKE 'MENTION::%'
  UNION SELECT 'triples', 'head_id', CAST(triple_id AS VARCHAR), upper(trim(head_id)), created_at, 'n' FROM triples
  UNION SELECT 'triples', 'tail_id', CAST(triple_id AS VARCHAR), upper(trim(tail_id)), created_at, 'n' FROM triples),
p AS (SELECT 'k' src, * FROM k UNION ALL SELECT 'n', * FROM n),
j AS (SELECT r.tbl, r.field, r.row_id, r.t, count(p.id) rows_, count(*) FILTER (WHERE p.id IS NOT NULL AND p.b <= r.t AND (p.e IS NULL OR r.t < p.e)) live,
        count(*) FILTER (WHERE p.id IS NOT NULL AND p.b <= r.t) begun
      FROM r LEFT JOIN p ON r.src = p.src AND r.id = p.id WHERE r.id IS NOT NULL AND r.id NOT IN ('', 'NIL') GROUP BY ALL),
o AS (SELECT tbl, field, row_id, t, CASE WHEN rows_ = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END reason FROM j WHERE live = 0)
"""
QUERIES = {f.__name__: f for f in (p3_found, p3_profile, p5_found, p5_report)}
ORACLES = {
    "p5_found": _P5 + "SELECT tbl, field, row_id, reason FROM o",
    "p5_report": _P5 + "SELECT tbl, field, strftime(t, '%Y-%m') AS \"month\", reason, count(*) n_orphans FROM o GROUP BY ALL",
}
