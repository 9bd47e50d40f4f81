"""Problem 3: several values packed in one field.

Delimiters are inferred per source (``source`` and column; here the columns alone, as a file holds some two rows) from the data itself. Each candidate is
scored on two things. Piece-count consistency: mean / (mean + spread) of how many pieces it parts a cell into, over the source's
cells that hold it outside quotation marks; lists have few and similar counts, running text has not. Piece type
regularity: the share of its pieces whose type (script, capitals, blanks, inner signs) is the type of at least ``KNOWN`` of
the values that nothing could part, in some column of that hand; "J." or "north of the river" is no name. A candidate is accepted when the product
reaches ``MIN_SCORE``, refused else. All accepted candidates of the source then part its cells together, since hands of different
habits worked on one cell. Everything runs JVM-side with regular expressions; the profile is one row per source and
candidate, a size fixed by the number of sources.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.sources.writers import materialise

CANDIDATES = {"pipe": "|", "wide_pipe": "｜", "semicolon": ";", "wide_semicolon": "；", "comma": ",", "wide_comma": "，", "list_comma": "、", "tab": "\t",
              "newline": "\n", "slash": "/"}
QUOTES = [('"', '"'), ("“", "”"), ("「", "」"), ("『", "』")]
FIELDS = ("mentions", "aliases", "section_titles", "merged_entities")
# share of the undivided values from which a type is known; score from which a delimiter is accepted
KNOWN, MIN_SCORE = 0.002, 0.5


def _cls(chars: str) -> str:
    return "".join("\\" + c if c in "|\\/[]^-" else c for c in chars)


# inside marks a doubled straight mark stands for one, and a typographic pair may be nested once
_INNER = [r'((?:[^"]|"")*)' if a == b else rf"((?:[^{a}{b}]|{a}[^{a}{b}]*{b})*)" for a, b in QUOTES]
QUOTED = "(?:" + "|".join(f"{a}{i}{b}" for (a, b), i in zip(QUOTES, _INNER)) + ")"


def value_regex(delims: list[str]) -> str:
    """One value: a piece wholly in quotation marks up to the next delimiter, else a run without delimiters. A slash parts only with a blank or an edge beside it."""
    plain = "".join(d for d in delims if d != "/")
    stop = f"[{_cls(plain)}]" if plain else "(?!)"
    slash = r"(?:(?<=[\s　 ]|^)/|/(?=[\s　 ]|$))" if "/" in delims else "(?!)"
    anyd = f"(?:{stop}|{slash})"
    return rf"(?U)\s*{QUOTED}\s*(?={anyd}|$)|(?:(?!{anyd}).)+".replace(".)+", r"[\s\S])+")


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unquote(c: Column) -> Column:
    """Cuts blanks, one pair of quotation marks around the whole value, and blanks again."""
    whole = "^" + QUOTED + "$"
    bare = F.regexp_replace(strip_blanks(c), whole, "".join(f"${i + 1}" for i in range(len(QUOTES))))
    return strip_blanks(F.when(strip_blanks(c).rlike('^"[\\s\\S]*"$'), F.regexp_replace(bare, '""', '"')).otherwise(bare))


def cells(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = FIELDS, source: Column | None = None) -> DataFrame:
    """Long form (row_id, field, source, cell) of the packed columns, null cells left out. ``source`` tells hands of different habits apart; without it a column is one source."""
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields])
    by = F.lit("") if source is None else F.coalesce(source.cast("string"), F.lit(""))
    return df.select(F.col(key).alias("row_id"), by.alias("source"), F.explode(stacked).alias("s")).select("row_id", "s.field", "source", "s.cell").where("cell IS NOT NULL")


def value_type(c: Column) -> Column:
    """The type of a value: quoted, digits, scripts with capitals; runs of capitalised words are one type, as are runs of ideographs."""
    t = F.regexp_replace(F.regexp_replace(c, r"\p{Cf}+", ""), r"[\p{Lu}\p{Lt}][\p{M}’']*", "A")
    t = F.regexp_replace(t, r"[\p{Ll}\p{M}’']+", "a")
    t = F.regexp_replace(F.regexp_replace(t, r"\p{Lo}+", "Z"), r"\p{N}+", "9")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?:\bA+a(?:[ -]?A+a)*\b)", "N"), r"a(?: a)+", "a")


_STRUCT = "struct<delimiter:string,pieces:int,type:string,at:int>"


def delimiter_profile(long: DataFrame, known: float = KNOWN) -> DataFrame:
    """(source, field, delimiter, cells, consistency, regularity, score): one row per source and candidate that occurs in it."""
    bare = F.regexp_replace("cell", rf'(?<![^|｜;；,，、/\t\n\s]){QUOTED}', "Q")  # quoted values count as one letter
    base = long.where(~F.col("cell").rlike(r'^\s*\[\s*"')).select("source", "field", bare.alias("b"))
    slash = r"(?U)(?<=^|\s)/|/(?=\s|$)"

    def scored(name: str, d: str) -> Column:
        has = F.col("b").rlike(r"(?U)(?:^|\s)/|/(?:\s|$)") if d == "/" else F.instr("b", d) > 0
        pieces = F.filter(F.transform(F.split("b", slash if d == "/" else "\\" + d if d in "|" else d), strip_blanks), lambda p: p != "")
        others = "[" + _cls("".join(x for x in CANDIDATES.values() if x not in ("/", d))) + "]"
        return F.when(has, F.transform(pieces, lambda p, i: F.struct(F.lit(name).alias("delimiter"), F.size(pieces).alias("pieces"), F.when(~p.rlike(others), value_type(p)).alias("type"), i.alias("at"))))
    empty = F.array().cast(f"array<{_STRUCT}>")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("delimiter"), F.lit(1).alias("pieces"), value_type(strip_blanks(F.col("b"))).alias("type"), F.lit(0).alias("at")))
    none = ~F.col("b").rlike("[" + _cls("".join(d for d in CANDIDATES.values() if d != "/")) + "]") & ~F.col("b").rlike(r"(?U)(?:^|\s)/|/(?:\s|$)")
    every = F.when(none, whole).otherwise(F.flatten(F.array(*[F.coalesce(scored(n, d), empty) for n, d in CANDIDATES.items()])))
    # a trailing delimiter parts nothing: such a cell speaks for the type, not for the count
    n = F.when((F.col("x.at") == 0) & (F.col("x.pieces") > 1), F.col("x.pieces").cast("double"))
    t = base.select("source", "field", F.explode(every).alias("x")).groupBy("source", "field", "x.delimiter", "x.type").agg(
        F.count("*").alias("n"), F.sum((F.col("x.at") == 0).cast("int")).alias("cells"), F.count(n).alias("k"), F.sum(n).alias("s1"), F.sum(n * n).alias("s2"))
    t = materialise(t, "types")  # a row per source, candidate and type; read four times below
    single = t.where("delimiter IS NULL").select("source", "field", "type", "n")
    most = single.groupBy("source", "field").agg(F.sum("n").alias("all"))
    types = single.join(most, ["source", "field"]).where(F.col("n") >= known * F.col("all")).select("source", "type", F.lit(1).alias("good")).distinct()
    j = t.where("delimiter IS NOT NULL").join(types, ["source", "type"], "left")
    p = j.groupBy("source", "field", "delimiter").agg(F.sum("cells").alias("cells"), F.sum("k").alias("k"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
                                                      (F.sum(F.when(F.col("good") == 1, F.col("n"))) / F.sum(F.when(F.col("type").isNotNull(), F.col("n")))).alias("regularity"))
    mean = F.col("s1") / F.col("k")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("k") - mean * mean, F.lit(0.0)))
    p = p.withColumn("consistency", F.coalesce(mean / (mean + spread), F.lit(1.0))).withColumn("regularity", F.coalesce("regularity", F.lit(0.0)))
    return p.select("source", "field", "delimiter", "cells", F.round("consistency", 6).alias("consistency"), F.round("regularity", 6).alias("regularity"), F.round(F.col("consistency") * F.col("regularity"), 6).alias("score"))


def split_packed(long: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(row_id, field, pos, value): one row per value of every cell, position from 0.

    Cells holding a JSON list of strings are read as such. Empty values take no position, repeated
    values stay, a null or blank cell gives no row. Row ids are taken as given: a repeated input row gives its values again.
    The pattern of a source is made from its accepted delimiters, so there are no more patterns than sets of delimiters.
    """
    p = (profile if profile is not None else delimiter_profile(long)).where(F.col("score") >= MIN_SCORE)
    sets = p.groupBy("source", "field").agg(F.array_join(F.sort_array(F.collect_set("delimiter")), " ").alias("_set"))  # at most the candidates
    kinds = [r[0] for r in sets.select("_set").distinct().collect()]  # sets of accepted delimiters: bounded by the candidates, some few in practice
    per = long.join(sets, ["source", "field"], "left")
    parts = reduce(lambda acc, k: F.when(F.col("_set") == k, F.regexp_extract_all("cell", F.lit(value_regex(sorted(CANDIDATES[n] for n in k.split(" ")))), F.lit(0))).otherwise(acc), sorted(kinds), F.array(F.col("cell")))
    listed = F.when(F.col("cell").rlike(r'(?U)^\s*\[.*\]\s*$'), F.from_json(strip_blanks(F.col("cell")), "array<string>"))
    values = F.filter(F.coalesce(F.transform(listed, strip_blanks), F.transform(parts, unquote)), lambda v: v.isNotNull() & (v != ""))
    return per.select("row_id", "field", F.posexplode(values).alias("pos", "value"))
