"""Problem 5: references to records that do not exist.

References and parent validity intervals are put into one stream of events, co-partitioned by
(parent table, key, salt) and sorted by time; one running window then merges both streams
linearly. A reference sees how many intervals are open (``live``), how many have begun, and
whether the key has any row at all. No key is ever gathered: a hot key is spread over ``salts``
buckets by its references, and only the parents' few events are repeated in every bucket.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def norm_id(c: Column) -> Column:
    """Ids match after cutting blanks of any kind and ignoring case; null, blank and NIL are no reference."""
    k = F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when((k == "") | (k == "NIL"), None).otherwise(k)


def references(df: DataFrame, tbl: str, field: str, row_id: str, at: str, parent: str) -> DataFrame:
    """Rows (tbl, field, row_id, parent, key, t) of one reference column; rows without reference are left out."""
    return (df.select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field"), F.col(row_id).cast("string").alias("row_id"), F.lit(parent).alias("parent"),
                      norm_id(F.col(field)).alias("key"), F.col(at).cast("timestamp_ntz").alias("t")).where("key IS NOT NULL"))


def parents(df: DataFrame, parent: str, key: str, begins: str, ends: str) -> DataFrame:
    """Distinct validity intervals [begin, end) of a target table; a null begin is 'always', a null end 'never'."""
    return df.select(F.lit(parent).alias("parent"), norm_id(F.col(key)).alias("key"), F.col(begins).cast("timestamp_ntz").alias("begin"),
                     F.col(ends).cast("timestamp_ntz").alias("end")).where("key IS NOT NULL").distinct()


def orphan_references(refs: DataFrame, targets: DataFrame, salts: int = SALTS) -> DataFrame:
    """References without a live target row at their time: (tbl, field, row_id, t, reason).

    reason: ``missing`` (no row has the key), ``late`` (every row begins after t), else ``deleted``.
    An interval that ends no later than it begins is never live. A reference whose t is null can
    only be ``missing``. Repeated rows give one row. Empty inputs give no rows.
    """
    lo = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    ev = targets.select("parent", "key", F.coalesce("begin", lo).alias("b"), F.col("end").alias("e"))
    # prio: existence first, then ends and begins before references of the same instant
    steps = F.array(
        F.struct(lo.alias("t"), F.lit(0).alias("prio"), F.lit(1).alias("has"), F.lit(0).alias("begun"), F.lit(0).alias("d")),
        F.struct(F.col("b").alias("t"), F.lit(1).alias("prio"), F.lit(1).alias("has"), F.lit(1).alias("begun"), F.lit(1).alias("d")),
        F.struct(F.greatest("b", "e").alias("t"), F.lit(1).alias("prio"), F.lit(1).alias("has"), F.lit(0).alias("begun"), F.lit(-1).alias("d")))
    ev = (ev.select("parent", "key", F.explode(F.filter(steps, lambda s: ~((s.d == -1) & F.col("e").isNull()))).alias("s"))
          .select("parent", "key", "s.*").groupBy("parent", "key", "t", "prio").agg(F.max("has").alias("has"), F.max("begun").alias("begun"), F.sum("d").cast("int").alias("d"))
          .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    null = lambda t: F.lit(None).cast(t)
    ev = ev.select("parent", "key", "salt", "t", "prio", "has", "begun", "d", null("string").alias("tbl"), null("string").alias("field"), null("string").alias("row_id"), F.lit(False).alias("no_t"))
    rf = refs.select("parent", "key", F.pmod(F.hash("row_id"), F.lit(salts)).alias("salt"), F.coalesce("t", lo).alias("t"), F.lit(2).alias("prio"), F.lit(0).alias("has"),
                     F.lit(0).alias("begun"), F.lit(0).alias("d"), "tbl", "field", "row_id", F.col("t").isNull().alias("no_t"))
    w = Window.partitionBy("parent", "key", "salt").orderBy("t", "prio").rowsBetween(Window.unboundedPreceding, 0)
    m = rf.unionByName(ev).select("tbl", "field", "row_id", "t", "no_t", "prio", F.max("has").over(w).alias("has"), F.max("begun").over(w).alias("begun"), F.sum("d").over(w).alias("live"))
    m = m.where((F.col("prio") == 2) & (F.col("live") <= 0) & ~(F.col("no_t") & (F.col("has") == 1)))
    reason = F.when(F.col("has") == 0, "missing").when(F.col("begun") == 0, "late").otherwise("deleted")
    return m.select("tbl", "field", "row_id", F.when(~F.col("no_t"), F.col("t")).alias("t"), reason.alias("reason")).distinct()


def graph_orphans(kb: DataFrame, nodes: DataFrame, mentions: DataFrame, triples: DataFrame) -> DataFrame:
    """The four references of the graph tables; a ``MENTION::`` node is its own record and refers to nothing."""
    refs = references(mentions, "linked_mentions", "entity_id", "mention_id", "created_at", "kb")
    refs = refs.unionByName(references(nodes, "nodes", "node_id", "node_id", "created_at", "kb").where("key NOT LIKE 'MENTION::%'"))
    for f in ("head_id", "tail_id"):
        refs = refs.unionByName(references(triples, "triples", f, "triple_id", "created_at", "nodes"))
    targets = parents(kb, "kb", "entity_id", "added_at", "deleted_at").unionByName(parents(nodes, "nodes", "node_id", "created_at", "removed_at"))
    return orphan_references(refs, targets)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, reference, month of the referring row, and reason."""
    return orphans.groupBy("tbl", "field", F.date_format("t", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
