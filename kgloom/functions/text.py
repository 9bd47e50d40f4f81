"""Column functions over text: sentences, sections, cleaning predicates, labels, tags."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.packs import rules as R


_BLANK = " \t\n\x0b\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))  # the characters of R.BLANKS


def strip(c: Column) -> Column:
    """Cuts blanks of any kind at both ends; what lies between is not looked at."""
    return F.btrim(c, F.lit(_BLANK))


def _alt(words: list[str]) -> str:
    return "(?:" + "|".join("".join("\\" + c if c in ".*+?()[]{}|^$\\" else c for c in w) for w in words) + ")"


def any_start(c: Column, words: list[str]) -> Column:
    return c.rlike("^" + _alt(words))


def any_end(c: Column, words: list[str]) -> Column:
    return c.rlike(_alt(words) + "\\z")


def any_in(c: Column, words: list[str]) -> Column:
    return c.rlike(_alt(words))


def once(c: Column, f) -> Column:
    """``f`` of a value worked out once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def once_a_row(c: Column) -> Column:
    """A column that conditions on it don't work out again: Spark moves no filter below an explode and copies nothing out of it. One to a select."""
    return F.explode(F.array(c))


def running_starts(lengths: Column, chunk: int = 64) -> Column:
    """Sum of all lengths before each one. Summed in chunks, so that appending never copies a long array; ``lengths`` is worked out once."""
    def fold(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def chunked(own: Column) -> Column:
        numbers = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.ceil(F.size(own) / chunk).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        part = lambda k: F.slice(own, k * chunk + 1, chunk)
        totals = lambda ks: F.transform(ks, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x))
        return once(numbers, lambda ks: once(fold(totals(ks), F.lit(0)), lambda starts: F.flatten(F.transform(ks, lambda k: fold(part(k), starts[k])))))
    return once(lengths, lambda own: F.when(F.size(own) <= chunk, fold(own, F.lit(0))).otherwise(chunked(own)))


def sentences(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., sent_idx, s_start, s_end, sent): cut after each boundary, stripped, blank ones dropped.

    ``s_start`` is where the unstripped sentence begins, in code points. Offsets are summed within the row: no
    shuffle. Null and empty texts give no row.
    """
    p = docs.where("text IS NOT NULL").select(*keys, F.regexp_extract_all("text", F.lit(f"[^{R.BOUNDARIES}]*[{R.BOUNDARIES}]|[^{R.BOUNDARIES}]+$"), F.lit(0)).alias("_x"))
    p = p.withColumn("_n", F.transform("_x", F.length)).withColumn("_s", running_starts(F.col("_n"))).withColumn("_t", F.transform("_x", strip))
    kept = F.filter(F.arrays_zip(F.col("_s").alias("s"), F.col("_n").alias("n"), F.col("_t").alias("x")), lambda z: z["x"] != "")
    return p.select(*keys, F.posexplode(kept).alias("sent_idx", "p")).select(*keys, "sent_idx", F.col("p.s").alias("s_start"), (F.col("p.s") + F.col("p.n")).alias("s_end"), F.col("p.x").alias("sent"))


def sections(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., sec_idx, title, body): a heading is a stripped line of at most 20 characters without sentence marks; lines before any heading belong to 全文.

    The body joins non-blank lines with line breaks; sections without body are kept out.
    """
    stop = "[" + "".join("\\" + c if c in "()\"'" else c for c in R.HEADING_STOP) + "]"
    d = docs.where("text IS NOT NULL").select(*keys, F.transform(F.split("text", "\n"), strip).alias("_l"))
    head = F.filter(F.transform("_l", lambda x, i: F.when((x != "") & (F.length(x) <= 20) & ~x.rlike(stop), i + 1)), lambda i: i.isNotNull())
    d = d.withColumn("_h", F.concat(F.array(F.lit(0)), head, F.array(F.size("_l") + 1)))
    body = lambda i, j: F.array_join(F.filter(F.slice(F.col("_l"), i + 1, j - i - 1), lambda x: x != ""), "\n")
    parts = F.transform(F.sequence(F.lit(0), F.size("_h") - 2), lambda k: F.struct(F.when(k == 0, "全文").otherwise(F.col("_l")[F.col("_h")[k] - 1]).alias("t"), body(F.col("_h")[k], F.col("_h")[k + 1]).alias("b")))
    return d.select(*keys, F.posexplode(F.filter(parts, lambda s: s["b"] != "")).alias("sec_idx", "s")).select(*keys, "sec_idx", F.col("s.t").alias("title"), F.col("s.b").alias("body"))


def section_offsets(docs: DataFrame, key: str) -> DataFrame:
    """(key, sec_idx, title, start, end): where each section's body stands, found from the end of the one before; a body that stands nowhere as a whole (blank lines part it) is taken to begin there.

    Null texts give no row; a text without sections is one of its whole length.
    """
    t = docs.where("text IS NOT NULL").select(key, F.col("text").alias("_t")).distinct()
    g = sections(docs.select(key, "text").distinct(), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sec_idx", "title", "body"))).alias("_s"))  # the sections of a text are not longer than the text
    none = F.array(F.struct(F.lit(0).alias("sec_idx"), F.lit("全文").alias("title"), F.col("_t").alias("body")))
    j = t.join(g, key, "left").withColumn("_s", F.coalesce("_s", none))
    acc = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,t:string,s:int,e:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = F.call_function("locate", x["body"], F.col("_t"), a["at"] + 1)
        start = F.when(at > 0, at - 1).otherwise(a["at"])
        end = (start + F.length(x["body"])).cast("int")
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(x["sec_idx"].alias("i"), x["title"].alias("t"), start.cast("int").alias("s"), end.alias("e"))).alias("out"))
    return j.select(key, F.explode(F.aggregate("_s", acc, step, lambda a: a["out"])).alias("s")).select(key, F.col("s.i").alias("sec_idx"), F.col("s.t").alias("title"), F.col("s.s").alias("start"), F.col("s.e").alias("end"))


def canonical(c: Column) -> Column:
    """A spelling's canonical one, by the pack."""
    out = c
    for k, v in R.CANONICAL.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def clean_entity(c: Column) -> Column:
    """Whether a string may be an entity: the ordered rejects of the pack; an acronym is accepted before the long-text rejects. Null is none."""
    return once(strip(c), lambda x: once(canonical(x), _clean))


def _clean(t: Column) -> Column:
    n = F.length(t)
    return (F.when(t.isNull() | (n < 2) | (n > 60), False).when(t.isin(R.NOISE), False).when(any_in(t, R.ROLE_CUES) & ~any_start(t, R.TITLE_STARTS), False).when(t.isin(R.STOP + R.GENERIC), False)
            .when(any_start(t, R.BAD_STARTS), False).when(any_end(t, R.BAD_ENDS), False).when(any_in(t, R.BAD_INSIDE), False).when(t.rlike("[\\[\\]{}<>\"、。，；：！？“”‘’（）()']"), False).when(t.rlike("^[0-9]+$"), False)
            .when(t.rlike(R.ACRONYM), True).when((n > 10) & t.rlike(R.LONG_LINKS), False).when((n > 12) & t.rlike(R.LONG_LETTERS), False).when((n <= 4) & t.rlike("^[在于对被把将从向因][A-Za-z一-鿿]"), False).otherwise(True))


_PUNCT = "，。；：！？、“”‘’（）()\\[\\]{}<>\"' "
PREFIXES = f"^(?:(?:{'|'.join(R.AFFIX_STARTS)})[{R.BLANKS}]*)+([\\s\\S]{{2,}})$"
SUFFIXES = f"^([\\s\\S]{{2,}}?)(?:[{R.BLANKS}]*(?:{'|'.join(R.AFFIX_ENDS)}))+$"


def normal_term(c: Column) -> Column:
    """The term without context words at both ends, cut as often as they stand there while two characters stay, and without a leading preposition or 的; in canonical spelling."""
    t = F.regexp_replace(canonical(strip(c)), f"^[{_PUNCT}]+|[{_PUNCT}]+$", "")
    ends = lambda x: reduce(lambda a, b: a | b, [strip(x).endswith(e) for e in R.AFFIX_ENDS])  # noqa: E731 - without one SUFFIXES changes nothing
    t = once(F.regexp_replace(t, PREFIXES, "$1"), lambda x: strip(F.when(ends(x), F.regexp_replace(x, SUFFIXES, "$1")).otherwise(x)))
    t = F.regexp_replace(F.regexp_replace(t, "^[在于向对从被把]([一-鿿A-Za-z]{2,})", "$1"), "^的([一-鿿A-Za-z]{2,})", "$1")
    return once(t, canonical)


def match_text(c: Column) -> Column:
    """Form under which two texts are the same mention: normal term, runs of blanks one space, lower case; "" for null."""
    return F.lower(F.trim(F.regexp_replace(normal_term(F.coalesce(c, F.lit(""))), f"[{R.BLANKS}]+", " ")))


def plausible(c: Column, label: Column) -> Column:
    """Whether the shape of a name (its normal term) suits its label."""
    def shape(t: Column) -> Column:
        acr, han = t.rlike(R.ACRONYM), lambda k: t.rlike(f"^[一-鿿]{{2,{k}}}$")
        return clean_entity(t) & (F.when(label == "PER", ~acr & ~any_in(t, R.ROLE_CUES) & (t.contains("·") | t.rlike(R.LATIN_NAME) | han(4))).when(label == "ORG", acr | any_end(t, R.ORG_ENDS) | t.isin(R.KNOWN_ORGS))
                                  .when(label == "LOC", any_end(t, R.LOC_ENDS) | t.isin(R.KNOWN_PLACES) | han(8)).when(label == "PROD", F.length(t) >= 2).otherwise(True))
    return once(normal_term(c), shape)


def infer_label(c: Column, left: Column | None = None, right: Column | None = None) -> Column:
    """Ordered decision list on a name's normal term and the text around it; null where nothing speaks."""
    around = F.concat(F.coalesce(left, F.lit("")) if left is not None else F.lit(""), F.coalesce(right, F.lit("")) if right is not None else F.lit(""))

    def decide(t: Column) -> Column:
        acr = t.rlike(R.ACRONYM)
        return (F.when(t.isNull() | ~clean_entity(t), None).when(acr & any_in(around, R.PRODUCT_CONTEXT), "PROD").when(acr, "ORG").when(any_start(t, R.TITLE_STARTS) | (t.startswith("《") & t.endswith("》")), "PROD")
                .when(any_in(t, R.ROLE_CUES), "PROD").when(any_end(t, R.PROD_ENDS), "PROD").when(t.contains("·") | t.rlike(R.LATIN_NAME), "PER").when(t.rlike("^[一-鿿]{2,4}$") & any_in(around, R.PERSON_CONTEXT), "PER")
                .when(any_end(t, R.ORG_ENDS) | t.isin(R.KNOWN_ORGS), "ORG").when(any_end(t, R.LOC_ENDS) | t.isin(R.KNOWN_PLACES), "LOC").when(any_in(around, R.TITLE_CUES), "PROD"))
    return once(normal_term(c), decide)


def occurrences(text: Column, name: Column) -> Column:
    """All 0-based positions of ``name`` in ``text`` that do not overlap, found by splitting once: linear in the text."""
    parts = F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1)

    def placed(p: Column, n: Column) -> Column:
        starts = running_starts(F.transform(p, lambda x: F.length(x) + n))
        return F.transform(F.slice(starts, 2, F.size(p)), lambda s: s - n)
    return once(parts, lambda p: once(F.length(name), lambda n: placed(p, n)))


def matches(text: Column, pattern: str, group: int = 0, holds: list[str] | None = None) -> Column:
    """(pos, whole, got) of all matches of a pattern that matches no empty text: 0-based places, whole matches and one group. Linear in the text, which is cut up once, and only where something matches.

    ``holds``: strings of which every match has one; a text with none of them is not searched by the pattern.
    """
    none = F.array().cast("array<struct<pos:int,whole:string,got:string>>")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if holds:
        whole = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in holds]), whole).when(text.isNotNull(), F.array().cast("array<string>"))

    def zipped(w: Column) -> Column:
        got = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else w
        cut = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(w))

        def placed(parts: Column) -> Column:
            at = F.zip_with(running_starts(F.zip_with(parts, w, lambda p, x: p + F.length(x))), parts, lambda s, p: s + p)
            return F.transform(F.arrays_zip(at.alias("pos"), w.alias("whole"), got.alias("got")), lambda z: F.struct(z["pos"].alias("pos"), z["whole"].alias("whole"), z["got"].alias("got")))
        return once(cut, placed)
    return once(whole, lambda w: F.when(F.size(w) == 0, none).otherwise(zipped(w)))


def bio_tags(text: Column, spans: Column) -> Column:
    """One tag per character; spans outside the text are skipped, later spans overwrite earlier ones. An empty text has no tags."""
    ok = F.filter(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,label:string>>")), lambda s: (s.start >= 0) & (s.end <= F.length(text)) & (s.start < s.end))
    tag = lambda i: F.aggregate(ok, F.lit("O"), lambda a, s: F.when(i == s.start, F.concat(F.lit("B-"), s.label)).when((i > s.start) & (i < s.end), F.concat(F.lit("I-"), s.label)).otherwise(a))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(text) - 1), tag))


def mark_entities(text: Column, head: Column, tail: Column) -> Column:
    """Text with <H> </H> and <T> </T> set at four offsets (the later mark first, so offsets hold)."""
    def put(t: Column, at: Column, mark: str) -> Column:
        return F.concat(F.substring(t, F.lit(1), at), F.lit(mark), F.substring(t, at + 1, F.length(t)))
    a = put(put(put(put(text, tail["end"], "</T>"), tail["start"], "<T>"), head["end"], "</H>"), head["start"], "<H>")
    b = put(put(put(put(text, head["end"], "</H>"), head["start"], "<H>"), tail["end"], "</T>"), tail["start"], "<T>")
    return F.when(head["start"] <= tail["start"], a).otherwise(b)
