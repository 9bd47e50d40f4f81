"""Titles, concepts and names inside sentences: what a relation may point to without a linked mention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.packs import rules as R

# Patterns of titles
QUOTED = '[《"“]([^》"”]{2,120})[》"”]'
CUE_TITLE = r"(?:题为|英语[:：]|英文[:：])\s*([A-Za-z][A-Za-z0-9 ,.'\-:&]{6,180})"
ENGLISH_TITLE = r"\b(?:The|On|Can|Paper|Foundations)\s+[A-Za-z][A-Za-z]+(?:\s+(?:of|to|and|the|in|for|on|with|an|a|by|[A-Z][A-Za-z]+|[A-Za-z]+|\[\d+\])){1,20}"
TITLE_PAIR = r"《([^》]{2,80})》\s*[（(](?:英语[:：])?\s*([A-Za-z][A-Za-z0-9 ,.'\-:&]+?)[）)]"
COUNTED = "^[一二三四五六七八九十几两0-9]+(?:个)?(?:月|年|天|次)$"
_EDGE = r"^[ ,?;:()\[\]]+|[ ,?;:()\[\]]+$"


def valid_concept(c: Column) -> Column:
    """Whether a text may be a concept: an acceptable name that opens with no particle and is no count of time."""
    return X.once(X.strip(c), lambda t: X.clean_entity(t) & ~t.rlike("^[了并其该]") & ~t.rlike(COUNTED))


def concept_after(sent: Column, at: Column) -> Column:
    """The run of letters right after a trigger that may be a concept, or null."""
    run = F.regexp_extract(F.substring(sent, at + 1, F.lit(18)), "^([一-鿿A-Za-z0-9·]{2,16})", 1)
    return X.once(F.regexp_replace(X.strip(run), "^(?:一篇|一项|一个|一种)", ""), lambda t: F.when((t != "") & valid_concept(t), t))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\[\d+\]", ""), _EDGE, "")


def sentence_titles(sent: Column) -> Column:
    """The distinct titles of a sentence, in order: in quotation marks, after a cue, or of English shape."""
    quoted = F.transform(F.regexp_extract_all(sent, F.lit(QUOTED), F.lit(1)), X.strip)
    chunks = F.transform(F.regexp_extract_all(sent, F.lit(CUE_TITLE), F.lit(1)), lambda x: F.split(x, "[。；\\n]")[0])
    parts = F.flatten(F.transform(chunks, lambda x: F.split(x, r"\s*(?:和|以及| and |, and )\s*")))
    cued = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(_bare(p), "[一-鿿].*$", ""), _EDGE, "")), lambda p: X.any_start(p, R.TITLE_STARTS))
    english = F.transform(F.regexp_extract_all(sent, F.lit(ENGLISH_TITLE), F.lit(0)), _bare)
    return F.array_distinct(F.filter(F.concat(quoted, cued, english), valid_concept))


def title_pairs(docs: DataFrame, key: str) -> DataFrame:
    """(key, alias, title, pos): English forms of titles given with their translation, whole and by their first two and three words.

    One row per alias of a document; where two titles share an alias the later one holds. Null texts give none.
    """
    d = docs.where("text IS NOT NULL").select(key, F.posexplode(F.regexp_extract_all("text", F.lit(TITLE_PAIR), F.lit(0))).alias("n", "hit"))
    d = d.select(key, "n", X.strip(F.regexp_extract("hit", TITLE_PAIR, 1)).alias("title"), F.regexp_replace(F.regexp_replace(X.strip(F.regexp_extract("hit", TITLE_PAIR, 2)), r"\[\d+\]$", ""), "^[ ,，。；;:：]+|[ ,，。；;:：]+$", "").alias("en"))
    words = F.split("en", r"\s+")
    first = lambda k: F.when(F.size(words) >= k, F.array_join(F.slice(words, 1, k), " "))
    a = d.where("title <> '' AND en <> ''").select(key, "n", "title", F.posexplode(F.array_compact(F.array(F.col("en"), first(2), first(3)))).alias("k", "alias"))
    w = Window.partitionBy(key, "alias")
    a = a.withColumn("first_at", F.min(F.col("n") * 4 + F.col("k")).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), F.desc("k"))))
    return a.where("r = 1").select(key, "alias", "title", F.col("first_at").cast("int").alias("pos"))


def canonical_title(t: Column, pairs: Column) -> Column:
    """The translated title a text stands for: by its whole form, else as the beginning (ten letters at least) of the first alias that fits; the text itself where none does.

    ``pairs`` is an array of (pos, alias, title) in order.
    """
    raw = X.strip(t)
    hit = lambda f: F.get(F.filter(pairs, f), F.lit(0))["title"]
    return F.when((raw == "") | (F.size(pairs) == 0), raw).otherwise(F.coalesce(hit(lambda p: p["alias"] == raw), F.when(F.length(raw) >= 10, hit(lambda p: F.startswith(p["alias"], raw))), raw))


def titles_after(sent: Column, at: Column, pairs: Column) -> Column:
    """Titles first found from two characters before the end of a trigger, translated, each once."""
    later = F.filter(sentence_titles(sent), lambda t: F.instr(sent, t) - 1 >= at - 2)
    return F.array_distinct(F.transform(later, lambda t: canonical_title(t, pairs)))
