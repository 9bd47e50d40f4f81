"""Text to mentions: lexica of the knowledge base and of a document's own names, dictionary and pattern extraction, overlap resolution."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import dictionary, titles
from kgloom.packs import rules as R

# Patterns of names
ZH_PERSON = r"[一-鿿]{1,4}·[一-鿿]{1,8}(?:·[一-鿿]{1,8})?"
EN_PERSON = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"
EN_BEFORE_HAN = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}(?=[一-鿿])"
EN_NAME = r"\b[A-Z][A-Za-z]+(?:[ .'\-][A-Z][A-Za-z]+){1,5}\b"
ACRONYM = r"\b[A-Z][A-Z0-9&.\-]{1,15}\b"
TITLE_WORDS = [x.strip() for x in R.TITLE_STARTS]  # each match of titles.ENGLISH_TITLE opens with one
IN_QUOTES = '[《"“]([^》"”]{2,80})[》"”]'
EN_CUE = r"(?:英语：|英文：)([A-Z][A-Za-z0-9 ,.'\-&:]{2,160})"
PATTERNS = {"PER": r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}", "ZH": ZH_PERSON, "ACR": r"[A-Z][A-Z0-9&.\-]{1,15}"}
# rank of a span's source when spans overlap
PRIORITY = {"input_dict": 4, "kb_dict": 3, "regex": 2, "ner": 0}
# which of two equal spans is met first: a tagger's, then a dictionary's, then a pattern's
TURN = {"ner": 0, "kb_dict": 1, "input_dict": 2, "regex": 20}


def kb_lexicon(kb: DataFrame) -> DataFrame:
    """Distinct (name, label) of names and aliases of at least two characters."""
    named = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return kb.select(F.explode(F.transform(named, X.strip)).alias("name"), F.col("type").alias("label")).where("length(name) >= 2").distinct()


def _around(text: Column, m: Column, n: int) -> tuple[Column, Column]:
    """Up to ``n`` characters before and after a match."""
    end = m["pos"] + F.length(m["whole"])
    start = F.greatest(m["pos"] - n, F.lit(0))
    return F.substring(text, start + 1, m["pos"] - start), F.substring(text, end + 1, F.lit(n))


def own_names(docs: DataFrame, kb: DataFrame, key: str) -> DataFrame:
    """(key, name, label, o): names a document brings itself: in quotation marks, after a cue of language, titles, persons, acronyms, organisations by their ending.

    A name is the normal term of what matched; a name of the knowledge base has its type there, else the pattern's label, else the one its shape and surroundings suggest;
    names that do not suit their label drop, as do those the knowledge base holds with it. ``o`` is the first pattern that found the name.
    """
    text = F.col("text")
    cand = "struct<term:string,label:string,l:string,r:string>"

    def found(pattern: str, group: int, label: str | None, n: int, test=None, term=lambda g: g, holds=None) -> Column:
        def one(m: Column) -> Column:
            left, right = _around(text, m, n) if n else (F.lit(""), F.lit(""))
            t = term(m["got"])
            return F.struct(t.alias("term"), F.lit(label).cast("string").alias("label"), left.alias("l"), right.alias("r"))
        hits = X.matches(text, pattern, group, holds)
        return F.transform(F.filter(hits, test) if test else hits, one)
    bare = lambda g: F.regexp_replace(F.regexp_replace(X.strip(F.split(g, "[）)。，；\n]")[0]), r"\[\d+\]", ""), r"^[ ,?;:()\[\]]+|[ ,?;:()\[\]]+$", "")
    title = lambda g: F.regexp_replace(F.regexp_replace(g, r"\[\d+\]", ""), r"^[ ,?;:()\[\]]+|[ ,?;:()\[\]]+$", "")
    ends = []
    for e in R.ORG_ENDS:
        window = lambda m: F.substring(text, F.greatest(m["pos"] + len(e) - 20, F.lit(0)) + 1, m["pos"] + len(e) - F.greatest(m["pos"] + len(e) - 20, F.lit(0)))  # noqa: E731, B023
        ends.append(F.transform(X.matches(text, e, holds=[e]), lambda m: F.struct(F.regexp_extract(window(m), r"[一-鿿A-Za-z&.\-]+$", 0).alias("term"), F.lit("ORG").alias("label"), F.lit("").alias("l"), F.lit("").alias("r"))))  # noqa: B023
    every = [found(IN_QUOTES, 1, "PROD", 12, holds=list('《"“')), found(EN_CUE, 1, None, 8, term=bare, holds=["英语：", "英文："]), found(titles.ENGLISH_TITLE, 0, "PROD", 0, term=title, holds=TITLE_WORDS), found(ZH_PERSON, 0, "PER", 0, holds=["·"]),
             found(EN_NAME, 0, "PER", 12, lambda m: ~X.any_start(m["whole"], R.TITLE_STARTS)), found(ACRONYM, 0, None, 12), *ends]
    c = docs.where("length(text) > 0").select(key, "text").distinct().select(key, F.explode(F.array_distinct(F.concat(*[F.transform(x.cast(f"array<{cand}>"), lambda v: F.struct(v.alias("v"), F.lit(k).alias("o"))) for k, x in enumerate(every)]))).alias("c"))  # noqa: B023
    c = c.select(key, X.once_a_row(X.normal_term(F.col("c.v.term"))).alias("name"), F.col("c.v.label").alias("label"), "c.v.l", "c.v.r", "c.o").where("name <> ''").distinct()
    known = kb_lexicon(kb)
    c = c.join(known.groupBy("name").agg(F.min("label").alias("held")), "name", "left").withColumn("label", X.once_a_row(F.coalesce("held", "label", X.infer_label(F.col("name"), F.col("l"), F.col("r")))))
    c = c.where(F.col("label").isNotNull() & X.plausible(F.col("name"), F.col("label"))).groupBy(key, "name", "label").agg(F.min("o").alias("o"))
    return c.join(known, ["name", "label"], "left_anti").select(key, "name", "label", "o")


def dict_extract(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, start, end, label, text): all, also overlapping, occurrences of every lexicon name in every text.

    A sketch of fixed size holds the names and their beginnings; texts are looked through beside it, where they lie, and what may be a name is joined with the names.
    Nothing is shuffled per place, names may have any length and share any beginnings; what the sketch lets through by chance drops in the join.
    """
    return dict_hits(texts.select(key, "text").distinct(), lexicon, key)


def dict_hits(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """What dict_extract gives, for each row of ``texts``: texts stay where they lie, a repeated text repeats its occurrences."""
    lex = lexicon.where("length(name) >= 2").select("name", "label").distinct()
    t = texts.where("length(text) >= 2")
    hit = dictionary.places(t, lex.select("name"), key).join(lex.select(F.col("name").alias("text"), "label"), "text")
    return hit.select(key, "start", (F.col("start") + F.length("text")).alias("end"), "label", "text")


def own_extract(docs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, start, end, label, text, o): occurrences of each document's own names (key, name, label, o) in that document."""
    g = names.groupBy(key).agg(F.collect_set(F.struct("name", "label", "o")).alias("_n"))  # the names of one text
    d = docs.where("length(text) > 0").select(key, "text").distinct().join(g, key)
    hits = F.flatten(F.transform("_n", lambda n: F.transform(X.occurrences(F.col("text"), n["name"]), lambda s: F.struct(s.alias("start"), n["name"].alias("name"), n["label"].alias("label"), n["o"].alias("o")))))
    return d.select(key, F.explode(hits).alias("h")).select(key, F.col("h.start").cast("int").alias("start"), (F.col("h.start") + F.length("h.name")).cast("int").alias("end"), F.col("h.label").alias("label"), F.col("h.name").alias("text"), "h.o")


def regex_extract(docs: DataFrame, key: str) -> DataFrame:
    """(key, start, end, label, text): matches of the six name patterns: transliterated persons, English titles, English persons (also right before ideographs), organisations by ending, known places."""
    text = F.col("text")
    no_role = lambda m: ~X.any_start(m["whole"], R.TITLE_STARTS) & ~X.any_in(m["whole"], R.NAME_ROLES)

    def org(m: Column) -> Column:
        ok = lambda n: ((n == m["whole"]) | (F.length(n) + 2 >= F.length(m["whole"]))) & X.plausible(n, F.lit("ORG"))
        return ~X.any_in(m["whole"], R.ORG_NOISE) & X.once(X.normal_term(m["whole"]), ok)
    families = [("PER", ZH_PERSON, None, ["·"]), ("PROD", titles.ENGLISH_TITLE, None, TITLE_WORDS), ("PER", EN_PERSON, no_role, None), ("PER", EN_BEFORE_HAN, no_role, None),
                ("ORG", "[一-鿿A-Za-z&]{2,18}(?:" + "|".join(R.ORG_PATTERN_ENDS) + ")", org, R.ORG_PATTERN_ENDS), ("LOC", "|".join(R.PLACE_PATTERN), None, R.PLACE_PATTERN)]
    out = []
    for label, pattern, test, holds in families:
        hits = X.matches(text, pattern, holds=holds)
        shown = lambda m: X.strip(F.regexp_replace(m["whole"], r"\[\d+\]", "")) if label == "PROD" else m["whole"]  # noqa: E731, B023
        out.append(F.transform(F.filter(hits, test) if test else hits, lambda m: F.struct(m["pos"].alias("start"), (m["pos"] + F.length(m["whole"])).alias("end"), F.lit(label).alias("label"), shown(m).alias("text"))))  # noqa: B023
    d = docs.where("length(text) > 0").select(key, "text").distinct().select(key, F.explode(F.array_distinct(F.concat(*out))).alias("h"))
    return d.select(key, F.col("h.start").cast("int").alias("start"), F.col("h.end").cast("int").alias("end"), "h.label", "h.text")


def document_mentions(docs: DataFrame, kb: DataFrame, key: str = "source_file", tagged: DataFrame | None = None) -> DataFrame:
    """(key, start, end, label, text, source): candidate mentions of every document: knowledge-base names, the document's own names, patterns, and a tagger's spans where given; without overlaps."""
    parts = [(dict_extract(docs, kb_lexicon(kb), key).withColumn("o", F.lit(0)), "kb_dict"), (own_extract(docs, own_names(docs, kb, key), key), "input_dict"), (regex_extract(docs, key).withColumn("o", F.lit(0)), "regex")]
    if tagged is not None:
        parts.append((tagged.select(key, "start", "end", "label", "text", F.lit(0).alias("o")), "ner"))
    u = reduce(lambda a, b: a.unionByName(b), [d.withColumn("source", F.lit(n)).withColumn("prio", F.lit(PRIORITY[n])).withColumn("turn", F.col("o") + TURN[n]).drop("o") for d, n in parts])
    return merge_spans(u.where(X.clean_entity(F.col("text"))), key)


def pattern_mentions(sents: DataFrame, *keys: str) -> DataFrame:
    """(keys..., label, name): pattern matches of each sentence that pass the cleaning predicate."""
    def labelled(label: str):
        return lambda m: F.struct(F.lit(label).alias("label"), m.alias("name"))
    per = [F.transform(F.regexp_extract_all("sent", F.lit(p), F.lit(0)), labelled({"ZH": "PER", "ACR": "ORG"}.get(k, k))) for k, p in PATTERNS.items()]
    m = sents.select(*keys, F.explode(F.concat(*per)).alias("m")).select(*keys, "m.label", "m.name")
    return m.where(X.clean_entity(F.col("name")))


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Greedy overlap resolution of (key, start, end, label, text, source, prio).

    Spans are taken by (start, end, turn, label), or highest priority first where no ``turn`` is given; a repeat of (start, end, label) drops; a span overlapping kept ones replaces them
    only if its rank (prio, plausible, min(length, 24)) beats every one of them. Overlap islands bound each
    fold, so no text is folded as a whole. Kept spans never overlap. Spans move once, before they are ranked.
    """
    s = spans.repartition(key).withColumn("rank", F.struct(F.col("prio"), X.plausible(F.col("text"), F.col("label")).cast("int"), F.least(F.col("end") - F.col("start"), F.lit(24))))
    w = Window.partitionBy(key).orderBy("start", "end", F.col("turn") if "turn" in spans.columns else F.desc("prio"), "label", "text")
    s = s.withColumn("o", F.row_number().over(w)).withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("o", "start", "end", "label", "text", "source", "rank")
    per = s.groupBy(key, "island").agg(F.sort_array(F.collect_list(item)).alias("all"))
    lap = lambda a, b: (a.start < b.end) & (b.start < a.end)
    kept = F.aggregate("all", F.slice(F.col("all"), 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: (k.start == x.start) & (k.end == x.end) & (k.label == x.label)), acc)
                       .when(F.forall(F.filter(acc, lambda k: lap(k, x)), lambda k: x["rank"] > k["rank"]), F.array_append(F.filter(acc, lambda k: ~lap(k, x)), x)).otherwise(acc))
    return per.select(key, F.explode(kept).alias("_kept")).select(key, *[F.col(f"_kept.{c}").alias(c) for c in ("start", "end", "label", "text", "source")])


def group_entities(m: DataFrame) -> DataFrame:
    """Mentions of a document grouped to entities: count, first name, distinct names in order, mean score; weak singletons drop (mean below 0.3)."""
    g = m.groupBy("source_file", F.coalesce("eid", "mention").alias("entity_key")).agg(
        F.count("*").alias("mention_count"), F.min_by("mention", F.struct("start", "mention_id")).alias("main_entity"), F.min_by("entity_type", F.struct("start", "mention_id")).alias("entity_type"),
        F.array_join(F.array_sort(F.collect_set("mention")), " | ").alias("mentions"), F.round(F.avg("score"), 8).alias("avg_score"))
    return g.where("mention_count > 1 OR avg_score >= 0.3")
