"""Measures: span precision and recall, errors, relation labels, tag sequences, character features."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SPAN = ["sample_id", "start", "end", "label"]


def gold_spans(samples: DataFrame) -> DataFrame:
    """Distinct (sample_id, start, end, label); null entities give none."""
    return gold_rows(samples).distinct()


def gold_rows(samples: DataFrame) -> DataFrame:
    """What gold_spans gives, for each row of ``samples``."""
    return samples.select("sample_id", F.explode("entities").alias("e")).select("sample_id", "e.start", "e.end", "e.label")


def sides(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(sample_id, start, end, label, g, p): each distinct span, nulls being equal, and which sides have it. Rows of either side may repeat.

    Both sides move once, by sample, and the spans of a sample stay together.
    """
    u = gold.select(*SPAN, F.lit(True).alias("g"), F.lit(False).alias("p")).unionByName(pred.select(*SPAN, F.lit(False).alias("g"), F.lit(True).alias("p")))
    return u.repartition("sample_id").groupBy(*SPAN).agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p"))


def prf(gold: DataFrame, pred: DataFrame, *by: str) -> DataFrame:
    """True and false positives, misses, precision, recall, F1 over (sample, start, end, label); a span with a null matches none."""
    both = F.col("g") & F.col("p") & F.forall(F.array(*[F.col(c).isNotNull() for c in SPAN]), lambda x: x)
    a = sides(gold, pred).groupBy(*by).agg(F.count_if(both).alias("tp"), F.count_if(F.col("p") & ~both).alias("fp"), F.count_if(F.col("g") & ~both).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    return a.select(*by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def span_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per label: misses, spurious spans, boundary errors (overlap, same label) and type errors (same span, other label). A null label equals none and has no errors."""
    x = sides(gold, pred).where("g <> p").select("sample_id", F.struct("start", "end", "label").alias("s"), "g")
    per = x.groupBy("sample_id").agg(F.collect_list(F.when(F.col("g"), F.col("s"))).alias("miss"), F.collect_list(F.when(~F.col("g"), F.col("s"))).alias("spur"))  # the spans of one text
    lap = lambda m, s: (m["start"] < s["end"]) & (s["start"] < m["end"])
    has = lambda m, f: (F.col("sample_id").isNotNull() & F.coalesce(F.exists("spur", lambda s: lap(m, s) & f(s)), F.lit(False))).cast("long")
    one = lambda m, missed, spurious, boundary, kind: F.struct(m["label"].alias("label"), missed.alias("missed"), spurious.alias("spurious"), boundary.alias("boundary"), kind.alias("type"))
    no, yes = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = F.concat(F.transform("miss", lambda m: one(m, yes, no, has(m, lambda s: m["label"] == s["label"]), has(m, lambda s: (m["label"] != s["label"]) & (m["start"] == s["start"]) & (m["end"] == s["end"])))),
                    F.transform("spur", lambda s: one(s, no, yes, no, no)))
    known = lambda c: F.sum(F.when(F.col("label").isNotNull(), F.col(c)).otherwise(0)).alias(c)
    return per.select(F.explode(rows).alias("r")).select("r.*").groupBy("label").agg(known("missed"), known("spurious"), known("boundary"), known("type"))


def label_metrics(pairs: DataFrame) -> DataFrame:
    """Per class of (gold, pred): support, precision, recall, F1."""
    g = pairs.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gold") == F.col("pred")).alias("tp"))
    p = pairs.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("n_pred"))
    j = g.join(p, "label", "full").na.fill(0, ["support", "tp", "n_pred"])
    r = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    return j.select("label", "support", r(F.col("tp"), F.col("n_pred")).alias("precision"), r(F.col("tp"), F.col("support")).alias("recall"), r(2 * F.col("tp"), F.col("n_pred") + F.col("support")).alias("f1"))


def label_totals(pairs: DataFrame) -> DataFrame:
    """(n_labels, macro_f1, micro_f1) of (gold, pred); every record has one of each, so micro F1 is the share of hits. No rows: no labels, null scores."""
    g = pairs.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gold") == F.col("pred")).alias("tp"))
    p = pairs.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("n_pred"))
    j = g.join(p, "label", "full").na.fill(0, ["support", "tp", "n_pred"])
    return j.agg(F.count("*").alias("n_labels"), F.round(F.avg(2 * F.col("tp") / (F.col("n_pred") + F.col("support"))), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("support"), 6).alias("micro_f1"))


def decode_bio(tags: DataFrame) -> DataFrame:
    """(sample_id, start, end, label) of runs B-X I-X* in (sample_id, i, tag); an I- without its B- is left out. Gaps and islands."""
    w = Window.partitionBy("sample_id").orderBy("i")
    t = tags.withColumn("prev", F.lag("tag").over(w)).withColumn("lab", F.when(F.col("tag") != "O", F.substring("tag", 3, 100)))
    cont = F.col("tag").startswith("I-") & (F.coalesce(F.substring("prev", 3, 100), F.lit("")) == F.col("lab")) & (F.col("prev") != "O")
    t = t.withColumn("run", F.sum(F.when(cont, 0).otherwise(1)).over(w))
    return t.groupBy("sample_id", "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.min_by("tag", "i").alias("first")).where("first LIKE 'B-%'").select("sample_id", "start", "end", F.substring("first", 3, 100).alias("label"))


def char_features(texts: DataFrame, key: str) -> DataFrame:
    """One row per character with its class and neighbours (two back, two on), null at the edges."""
    c = texts.where("length(text) > 0").select(key, F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    w = Window.partitionBy(key).orderBy("i")
    return c.select(key, "i", "ch", F.col("ch").rlike("^[0-9]$").alias("digit"), F.col("ch").rlike("^[A-Z]$").alias("upper"), F.col("ch").rlike("^[a-z]$").alias("lower"), F.lag("ch", 1).over(w).alias("c_1"), F.lag("ch", 2).over(w).alias("c_2"),
                    F.lead("ch", 1).over(w).alias("c1"), F.lead("ch", 2).over(w).alias("c2"), F.lag("i").over(w).isNull().alias("bos"), F.lead("i").over(w).isNull().alias("eos"))
