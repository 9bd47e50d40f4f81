"""Linked mentions gathered to the entities of a document."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import text as X


def in_sections(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions (source_file, start, ...) with the ``title`` of the first section that holds their start (both ends included), null where none does.

    Sections and mentions of a document run as one stream in order of their starts: no mention meets all sections.
    """
    w = Window.partitionBy("source_file").orderBy("sec_idx")
    s = X.section_offsets(docs, "source_file").withColumn("before", F.lag(F.struct("title", "end")).over(w))
    cols = [c for c in mentions.columns if c != "source_file"]
    a = s.select("source_file", F.col("start").alias("_at"), F.lit(0).alias("_side"), F.struct("title", "end", "before").alias("_s"))
    b = mentions.select("source_file", F.col("start").alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_m"))
    stream = Window.partitionBy("source_file").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(stream)).where("_m IS NOT NULL")
    title = F.when(F.col("_s.before.end") >= F.col("_at"), F.col("_s.before.title")).when(F.col("_s.end") >= F.col("_at"), F.col("_s.title"))
    return u.select("source_file", *[F.col(f"_m.{c}").alias(c) for c in cols], title.alias("title"))


def grouped(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document and entity (id, else normal name): counts, distinct mentions and sections in order of their place, mean score, basis.

    Entities met once drop if their score is below 0.3 or their name longer than 16 characters, unless a dictionary found them. Repeated rows count once; rows without place or
    document are left out; a mean is taken over scores, null counting 0.
    """
    eid = F.upper(F.trim("entity_id"))
    m = mentions.select("mention_id", "source_file", "mention", "entity_type", "start", "end", F.when((eid != "") & (eid != "NIL"), eid).alias("eid"), F.coalesce("normalized_entity", "mention").alias("name"),
                        F.coalesce("link_score", F.lit(0.0)).alias("score"), F.coalesce("source", F.lit("")).alias("source")).where("source_file IS NOT NULL AND start IS NOT NULL AND mention IS NOT NULL").distinct()
    g = in_sections(m, docs.select("source_file", "text")).groupBy("source_file", F.coalesce("eid", "name").alias("normalized_entity")).agg(
        F.count("*").alias("mention_count"), F.array_sort(F.collect_list(F.struct("start", "end", "mention_id", "mention", "name", "entity_type", "title"))).alias("_l"),  # an entity's mentions in one document
        F.avg("score").alias("_avg"), F.max(F.col("source").isin("input_dict", "kb_dict")).alias("_strong"))
    first, seen = F.get(F.col("_l"), F.lit(0)), lambda c: F.array_join(F.array_distinct(F.filter(F.transform("_l", lambda x: x[c]), lambda v: v.isNotNull())), " | ")
    g = g.withColumn("main_entity", first["name"]).where((F.col("mention_count") > 1) | F.col("_strong") | ((F.round("_avg", 9) >= 0.3) & (F.length("main_entity") <= 16)))
    sections = F.when(seen("title") == "", "全文").otherwise(seen("title"))
    basis = F.format_string("entity_id=%s; mentions=%d; avg_link_score=%.4f", "normalized_entity", "mention_count", "_avg")
    return g.select("main_entity", first["entity_type"].alias("entity_type"), "mention_count", seen("mention").alias("mentions"), "source_file", "normalized_entity", seen("mention").alias("aliases"), sections.alias("section_titles"), seen("mention").alias("merged_entities"),
                    F.round("_avg", 6).alias("disambiguation_confidence"), F.lit("entity_linker_grouping").alias("disambiguation_method"), basis.alias("disambiguation_basis"))
