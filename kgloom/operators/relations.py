"""Mentions in sentences, pairs, triggers, carried subjects, and the reconciliation of edges."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.packs import rules as R


def clean_mentions(mentions: DataFrame) -> DataFrame:
    """Distinct linked mentions with null for blank ids and 0 for missing scores."""
    eid = F.upper(F.trim("entity_id"))
    return mentions.select("mention_id", "source_file", "mention", "entity_type", "start", "end", F.when((eid != "") & (eid != "NIL"), eid).alias("eid"),
                           F.coalesce("link_score", F.lit(0.0)).alias("score"), "source").where("start IS NOT NULL AND `end` IS NOT NULL AND source_file IS NOT NULL").distinct()


def placed(s: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions with the sentence (of ``s``: source_file, sent_idx, s_start, s_end, ...) that holds them whole.

    Sentences and mentions of a document run as one stream in order of their starts, each mention takes the last sentence before it: work is linear, no mention meets
    all sentences of its document.
    """
    cs, cm = [c for c in s.columns if c != "source_file"], [c for c in mentions.columns if c != "source_file"]
    a = s.select("source_file", F.col("s_start").alias("_at"), F.lit(0).alias("_side"), F.struct(*cs).alias("_s"))
    b = mentions.select("source_file", F.col("start").alias("_at"), F.lit(1).alias("_side"), F.struct(*cm).alias("_m"))
    w = Window.partitionBy("source_file").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_m IS NOT NULL AND _m.`end` <= _s.s_end")
    return u.select("source_file", *[F.col(f"_m.{c}").alias(c) for c in cm], *[F.col(f"_s.{c}").alias(c) for c in cs])


def in_sentences(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each mention with the sentence that holds it whole."""
    return placed(X.sentences(docs, "source_file"), mentions)


def ranked(sm: DataFrame) -> DataFrame:
    """Adds rn: order of mentions in their sentence."""
    w = Window.partitionBy("source_file", "sent_idx").orderBy("start", "end", "mention_id")
    return sm.withColumn("rn", F.row_number().over(w))


def pairs(sm: DataFrame, max_gap: int = 64, neighbours: int = 6) -> DataFrame:
    """Ordered mention pairs of one sentence at most ``neighbours`` apart and with 0..max_gap characters between."""
    r = ranked(sm)
    a = r.select("source_file", "sent_idx", "sent", "s_start", F.col("mention_id").alias("h_id"), F.col("mention").alias("h"), F.col("entity_type").alias("h_type"), F.col("end").alias("h_end"), F.col("rn").alias("h_rn"))
    b = r.select("source_file", "sent_idx", F.col("mention_id").alias("t_id"), F.col("mention").alias("t"), F.col("entity_type").alias("t_type"), F.col("start").alias("t_start"), F.col("rn").alias("t_rn"))
    gap = F.col("t_start") - F.col("h_end")
    p = a.join(b, ["source_file", "sent_idx"]).where((F.col("t_rn") > F.col("h_rn")) & (F.col("t_rn") - F.col("h_rn") <= neighbours) & (gap >= 0) & (gap <= max_gap))
    return p.withColumn("gap", gap).withColumn("between", F.substring(F.col("sent"), F.col("h_end") - F.col("s_start") + 1, gap))


def pair_rules(p: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs whose types suit a rule and whose between-text holds its trigger; the first trigger of a relation counts."""
    j = p.join(F.broadcast(rules), F.array_contains("head_types", F.col("h_type")) & F.array_contains("tail_types", F.col("t_type")) & F.contains(F.col("between"), F.col("alias")))  # some dozens of rules
    return j.groupBy("source_file", "sent_idx", "h_id", "t_id", "relation_id").agg(F.min_by("alias", "rule_idx").alias("alias"), F.min("h").alias("h"), F.min("t").alias("t"))


def triggers(s: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_file, sent_idx, rule_idx, relation_id, alias, pos): every occurrence of every trigger in the sentences."""
    j = s.join(F.broadcast(rules), F.contains(F.col("sent"), F.col("alias")))
    return j.withColumn("pos", F.explode(X.occurrences(F.col("sent"), F.col("alias"))))


def trigger_window(s: DataFrame, sm: DataFrame, rules: DataFrame) -> DataFrame:
    """Best-ranked mention of a head type ending before each trigger and of a tail type starting after it (linked, score, nearness, length, order)."""
    t = triggers(s, rules).select("source_file", "sent_idx", "s_start", "rule_idx", "relation_id", "alias", "pos", "head_types", "tail_types")
    m = ranked(sm).select("source_file", "sent_idx", "mention_id", "mention", "entity_type", "start", "end", "eid", "score", "rn")
    j = t.join(m, ["source_file", "sent_idx"]).withColumn("ls", F.col("start") - F.col("s_start")).withColumn("le", F.col("end") - F.col("s_start"))
    stop = F.col("pos") + F.length("alias")

    def rank(dist: Column) -> Column:
        return F.struct(F.col("eid").isNotNull().cast("int"), F.round("score", 6), -dist, F.length("mention"), -F.col("rn"))
    left = F.array_contains("head_types", F.col("entity_type")) & (F.col("le") <= F.col("pos"))
    right = F.array_contains("tail_types", F.col("entity_type")) & (F.col("ls") >= stop)
    g = j.groupBy("source_file", "sent_idx", "rule_idx", "relation_id", "alias", "pos").agg(
        F.max_by(F.when(left, F.col("mention_id")), F.when(left, rank(F.col("pos") - F.col("le")))).alias("head_id"), F.max_by(F.when(right, F.col("mention_id")), F.when(right, rank(F.col("ls") - stop))).alias("tail_id"))
    return g.where("head_id IS NOT NULL AND tail_id IS NOT NULL")


def nearest(s: DataFrame, sm: DataFrame, rules: DataFrame) -> DataFrame:
    """As-of in both directions: the mention ending last before each trigger and the one starting first after it."""
    t = triggers(s, rules).select("source_file", "sent_idx", "s_start", "rule_idx", "alias", "pos")
    j = t.join(ranked(sm).select("source_file", "sent_idx", "mention_id", "start", "end", "rn"), ["source_file", "sent_idx"])
    ls, le, stop = F.col("start") - F.col("s_start"), F.col("end") - F.col("s_start"), F.col("pos") + F.length("alias")
    return j.groupBy("source_file", "sent_idx", "rule_idx", "alias", "pos").agg(
        F.max_by(F.when(le <= F.col("pos"), F.col("mention_id")), F.when(le <= F.col("pos"), F.struct(le, -F.col("rn")))).alias("before_id"),
        F.max_by(F.when(ls >= stop, F.col("mention_id")), F.when(ls >= stop, F.struct(-ls, -F.col("rn")))).alias("after_id"))


def subjects(sm: DataFrame) -> DataFrame:
    """(source_file, sent_idx, subject_id): the best person of each sentence (linked, score, length, earliest)."""
    p = sm.where("entity_type = 'PER'")
    return p.groupBy("source_file", "sent_idx").agg(F.max_by("mention_id", F.struct(F.col("eid").isNotNull().cast("int"), F.round("score", 6), F.length("mention"), -F.col("start"), -F.col("mention_id"))).alias("subject_id"))


def carried_subjects(s: DataFrame, sm: DataFrame) -> DataFrame:
    """Every sentence with the last subject before it in its document; a pronoun at its start takes that subject over."""
    w = Window.partitionBy("source_file").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    j = s.select("source_file", "sent_idx", F.col("sent").rlike(R.PRONOUN).alias("pronoun")).join(subjects(sm), ["source_file", "sent_idx"], "left")
    return j.withColumn("carried_id", F.last("subject_id", ignorenulls=True).over(w)).withColumn("effective_id", F.when(F.col("pronoun"), F.coalesce("carried_id", "subject_id")).otherwise(F.coalesce("subject_id", "carried_id")))


def dominant_person(mentions: DataFrame) -> DataFrame:
    """Per document the person with most mentions; then linked, best score, longest name, smallest key."""
    key = F.coalesce("eid", "mention")
    g = mentions.where("entity_type = 'PER'").groupBy("source_file", key.alias("person")).agg(F.count("*").alias("n"), F.max(F.col("eid").isNotNull().cast("int")).alias("linked"), F.max(F.round("score", 6)).alias("best"), F.max(F.length("mention")).alias("len"))
    w = Window.partitionBy("source_file").orderBy(F.desc("n"), F.desc("linked"), F.desc("best"), F.desc("len"), "person")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "len")


def last_study(s: DataFrame, found: DataFrame, studied: str = "R_STUDIED_AT", cue: str = "毕业|graduated") -> DataFrame:
    """Sentences that speak of graduating without naming the place take the last place of study met before in the document."""
    st = found.where(F.col("relation_id") == studied).groupBy("source_file", "sent_idx").agg(F.max("tail_id").alias("place_id"))
    w = Window.partitionBy("source_file").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    named = found.where("relation_id = 'R_GRADUATED_FROM'").select("source_file", "sent_idx", F.lit(True).alias("named")).distinct()
    j = s.join(st, ["source_file", "sent_idx"], "left").join(named, ["source_file", "sent_idx"], "left").withColumn("last_id", F.last("place_id", ignorenulls=True).over(w))
    return j.where(F.col("sent").rlike(cue) & F.col("named").isNull() & F.col("last_id").isNotNull()).select("source_file", "sent_idx", F.col("last_id").alias("place_id"))


# ---- edges: (triple_id, head, head_id, relation, tail, tail_id, confidence, source, sentence) ----

def edges(triples: DataFrame) -> DataFrame:
    """Distinct triples with keys: the id, or the text where there is none."""
    h, t = F.upper(F.trim("head_id")), F.upper(F.trim("tail_id"))
    e = triples.select("triple_id", "head", F.when((h != "") & (h != "NIL"), h).alias("head_id"), "relation", "tail", F.when((t != "") & (t != "NIL"), t).alias("tail_id"), "confidence", "source", "sentence").distinct()
    return e.withColumn("hk", F.coalesce("head_id", "head")).withColumn("tk", F.coalesce("tail_id", "tail"))


def _first(e: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return e.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r = 1").drop("r")


def dedup_exact(e: DataFrame) -> DataFrame:
    """First edge of each (head, tail, relation, sentence); self loops drop."""
    return _first(e.where("hk <> tk"), ["hk", "tk", "relation", "sentence"], F.asc("triple_id"))


def best_confidence(e: DataFrame) -> DataFrame:
    """Best edge of each (head, tail, relation); the first on ties."""
    return _first(e, ["hk", "tk", "relation"], F.desc("confidence"), F.asc("triple_id"))


def dedup_text(e: DataFrame) -> DataFrame:
    """Per (head text, tail text, relation): a linked tail beats an unlinked one, then confidence, then order."""
    return _first(e, ["head", "tail", "relation"], F.desc(F.col("tail_id").isNotNull()), F.desc("confidence"), F.asc("triple_id"))


def prune_subsumed(e: DataFrame) -> DataFrame:
    """Drops an edge if another of the same relation, sentence and head has a strictly longer tail text containing its own."""
    o = e.select("relation", "sentence", "hk", F.col("tail").alias("o_tail")).distinct()
    return e.join(o, (e["relation"] == o["relation"]) & (e["sentence"] == o["sentence"]) & (e["hk"] == o["hk"]) & F.contains(o["o_tail"], e["tail"]) & (F.length(o["o_tail"]) > F.length(e["tail"])), "left_anti")


def labelled(rel: DataFrame) -> DataFrame:
    """Adds the relation's label in English and in Chinese; an id outside the library is its own label."""
    zh = F.create_map(*[F.lit(x) for kv in R.LABEL_ZH.items() for x in kv])
    en = F.regexp_replace("relation_id", "^R_", "")
    return rel.withColumn("label_en", en).withColumn("label_zh", F.coalesce(F.element_at(zh, F.col("relation_id")), en))
