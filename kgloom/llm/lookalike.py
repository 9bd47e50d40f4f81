"""Problem 6: visually identical text with different characters.

Every letter belongs to a look class (o, Cyrillic о, Greek ο, Armenian օ); a class carries the scripts that own
such a letter. A token's resolved scripts are the intersection of its letters' script sets. One
script or more left: the token can be spelt wholly in the first of them in the order of ``SCRIPTS``. None left: the
token truly mixes scripts and each class is spelt by its first owner. As the sets belong to looks, not
to code points, two tokens of one look always get one spelling. What was detected is reported: ``mixed`` (a token's
letters come from several scripts), ``whole`` (from one script, but another one spells it alike and goes first), ``form``
(only other forms were brought together), ``same``. The remaining forms (full width, radicals, compatibility ideographs,
combining accents, blanks, dots, invisible characters) are normalised before.

Each distinct string is formed once, in the JVM where it holds nothing but ASCII, ideographs, accented Latin letters
and signs with a fixed counterpart, else in Arrow batches. From then on only 16-byte digests of writings and forms are shuffled.
Classes of equal writings are paired; their members are handed out in chunks, so no popular writing is one task.
"""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.sources.writers import materialise

# Letters of one look, in the order Latin, Cyrillic, Greek, Armenian, Cherokee; "-" where a script has none.
LOOKS = """
A А Α - Ꭺ
B В Β - Ᏼ
C С - - Ꮯ
D - - - Ꭰ
E Е Ε - Ꭼ
H Н Η - Ꮋ
I І Ι - -
J Ј - - Ꭻ
K К Κ - Ꮶ
L - - - Ꮮ
M М Μ - Ꮇ
N - Ν - -
O О Ο Օ -
P Р Ρ - Ꮲ
R - - - Ꭱ
S Ѕ - Տ Ꮪ
T Т Τ - Ꭲ
U - - Ս -
V - - - Ꮩ
W - - - Ꮃ
X Х Χ - -
Y Ү Υ - Ꮍ
Z - Ζ - Ꮓ
a а - - -
c с - - -
d ԁ - - -
e е - - -
g - - ց -
h һ - հ -
i і - - -
j ј - յ -
l ӏ - - -
n - - ո -
o о ο օ -
p р - - -
q ԛ - զ -
s ѕ - - -
u - - ս -
v - ν - -
w ԝ - - -
x х - - -
y у - - -
- Г Γ - -
- Л Λ - -
- Ф Φ - -
- П Π - -
"""
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
LOOK: dict[str, tuple[str, ...]] = {}
for _line in LOOKS.strip().split("\n"):
    _row = tuple(_line.split(" "))
    for _c in _row:
        if _c != "-":
            LOOK[_c] = _row
SIDE = {c: i for row in LOOK.values() for i, c in enumerate(row) if c != "-"}
DOTS = "·⋅∙‧•・･"  # fixed values: middle dots
QUOTES = {"‘": "'", "’": "'", "‛": "'", "ʼ": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-"}
_BEFORE = {ord(c): "·" for c in DOTS}
_AFTER = {ord(k): v for k, v in QUOTES.items()} | {c: None for c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x2800, 0x3164, 0xFEFF, 0xFFA0)}
_AFTER |= {c: None for a, b in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F)) for c in range(a, b + 1)}
_DOT, _TURNED = re.compile("[" + DOTS.replace("·", "") + "]"), re.compile("[" + "".join(map(chr, _AFTER)) + "]")  # whether there is anything to turn
_BLANK = re.compile(r"[\s ]+")
_FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13fd]")
_WORD = re.compile(r"[^\W\d_]+")


_PUNCT = "".join(chr(c) for c in range(0xFF01, 0xFF5F))  # full-width forms of ASCII, in its order
_FROM = _PUNCT + DOTS + "".join(QUOTES) + "\u3000\xa0" + "".join(chr(c) for c, v in _AFTER.items() if v is None)
_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "·" * len(DOTS) + "".join(QUOTES.values()) + "  "
_PLAIN = r"^[ -~\u4e00-\u9fff\t\n\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff、。《》「」『』【】—–·]*+\z"  # of a translated text
# rows of one writing that are handed out together: bounds a task's memory, changes no result
CHUNK = 20000


def _script(c: str) -> int | None:
    name = unicodedata.name(c, "")
    return next((i for i, s in enumerate(SCRIPTS) if name.startswith(s)), None)


@lru_cache(maxsize=1 << 16)
def _spell(token: str) -> tuple[str, str]:
    """(consistent spelling, what was detected) of one token."""
    word = unicodedata.normalize("NFD", token)
    sets, own, have = set(range(len(SCRIPTS))), set(), False
    for c in word:
        row = LOOK.get(c)
        if row:
            sets &= {i for i, x in enumerate(row) if x != "-"}
            own.add(SIDE[c])
            have = True
        elif unicodedata.category(c)[0] == "L":
            at = _script(c)
            own.add(at)
            sets &= {at}
    if not have:
        return token, "same"
    to = min(sets) if sets else None
    out = unicodedata.normalize("NFC", "".join(c if c not in LOOK else LOOK[c][to] if to is not None else next(x for x in LOOK[c] if x != "-") for c in word))
    return out, "mixed" if len(own) > 1 else "whole" if to is not None and own != {to} else "same"


def examined(text: str | None) -> tuple[str | None, str | None]:
    """(the one form of all strings that look like ``text``, what was detected): case, visible accents, spelling and order are kept.

    Null stays null; an empty, blank or wholly invisible text gives "". Runs of blanks become one
    space and blanks at the edges are cut, as their kind and width cannot be told by eye.
    """
    if text is None:
        return None, None
    if text.isascii():
        t = _BLANK.sub(" ", text).strip()
        return t, "same" if t == text else "form"
    t = unicodedata.normalize("NFKC", text.translate(_BEFORE) if _DOT.search(text) else text)
    t = t.translate(_AFTER) if _TURNED.search(t) else t
    t, kinds = unicodedata.normalize("NFC", _BLANK.sub(" ", t).strip()), set()
    if _FOREIGN.search(t):
        def one(m: re.Match) -> str:
            out, kind = _spell(m[0])
            kinds.add(kind)
            return out
        t = _WORD.sub(one, t)
    return t, "mixed" if "mixed" in kinds else "whole" if "whole" in kinds else "same" if t == text else "form"


def consistent(text: str | None) -> str | None:
    """The form ``examined`` gives."""
    return examined(text)[0]


FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("look", T.StringType())])


@F.pandas_udf(FORM)
def examined_form(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([examined(x) if isinstance(x, str) else (None, None) for x in texts], columns=["form", "look"])


def digest(c) -> F.Column:
    return F.unhex(F.md5(c))


def formed(strings: DataFrame) -> DataFrame:
    """Adds (form, look) to distinct strings (raw, ...); plain ones never leave the JVM."""
    s = strings.withColumn("_t", F.translate("raw", _FROM, _TO)).withColumn("_plain", F.col("_t").rlike(_PLAIN))
    s = s.withColumn("_u", examined_form(F.when(~F.col("_plain"), F.col("raw")))).withColumn("form", F.when(F.col("_plain"), F.trim(F.regexp_replace("_t", r"\s+", " "))).otherwise(F.col("_u.form")))
    return s.select(*strings.columns, "form", F.when(~F.col("_plain"), F.col("_u.look")).when(F.col("form") == F.col("raw"), "same").otherwise("form").alias("look"))


def rows_of(df: DataFrame, key: str, col: str) -> DataFrame:
    """(id, raw) with the id as a string; null texts and ids are left out."""
    return df.select(F.col(key).cast("string").alias("id"), F.col(col).alias("raw")).where("raw IS NOT NULL AND id IS NOT NULL")


def writings(columns: dict[str, DataFrame]) -> DataFrame:
    """(w, f, columns): the distinct strings of all columns as digests of writing and form, with the bits of the columns they stand in. Written once; looks of nothing are left out."""
    every = None
    for k, d in enumerate(columns.values()):
        one = d.select("raw", F.lit(1 << k).alias("column"))
        every = one if every is None else every.unionByName(one)
    u = every.groupBy("raw").agg(F.bit_or("column").alias("columns"))
    # no filter on the form here: it would be pushed below the grouping and form every row
    u = formed(u).select(digest("raw").alias("w"), F.when(F.col("form") != "", digest("form")).alias("f"), "columns")
    return materialise(u, "writings").where("f IS NOT NULL")


def _of(w: DataFrame, bit: int) -> DataFrame:
    return w.where(F.col("columns").bitwiseAND(bit) != 0).select("w", "f")


def class_pairs(w: DataFrame, bit: int) -> DataFrame:
    """(wa, wb): writings of one column that look the same. Only forms in several writings are paired."""
    c = _of(w, bit)
    c = c.join(c.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "f", "left_semi").select("w", "f")
    return c.toDF("wa", "f").join(c.toDF("wb", "f"), "f").where("wa < wb").select("wa", "wb")


def class_matches(w: DataFrame, bit: int, other: int) -> DataFrame:
    """(wa, wb): differing writings of two columns that look the same."""
    return _of(w, bit).toDF("wa", "f").join(_of(w, other).toDF("wb", "f"), "f").where("wa <> wb").select("wa", "wb")


def handed_out(columns: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """(field, a, b): ids of all rows of both writings of each pair (field, ca, wa, cb, wb), ca and cb being columns.

    Each column is read once, for the rows of paired writings. Chunks of one writing meet chunks of the other in separate groups.
    """
    pairs = materialise(pairs, "looks")
    wanted = pairs.select(F.col("ca").alias("c"), F.col("wa").alias("w")).unionByName(pairs.select(F.col("cb").alias("c"), F.col("wb").alias("w"))).distinct()
    every = None
    for name, d in columns.items():
        one = d.select(F.lit(name).alias("c"), digest("raw").alias("w"), "id")
        every = one if every is None else every.unionByName(one)
    m = materialise(every.join(wanted, ["c", "w"], "left_semi").distinct(), "members")
    n = materialise(m.groupBy("c", "w").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "sizes")
    m = m.join(n, ["c", "w"]).select("c", "w", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    every_part = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    p = pairs.join(n.toDF("ca", "wa", "na"), ["ca", "wa"]).join(n.toDF("cb", "wb", "nb"), ["cb", "wb"]).withColumn("pa", every_part("na")).withColumn("pb", every_part("nb"))
    a = p.select("field", "ca", "wa", "pa", "cb", "wb", "pb").join(m.select(F.col("c").alias("ca"), F.col("w").alias("wa"), F.col("id").alias("a"), F.col("part").alias("pa")), ["ca", "wa", "pa"])
    return a.join(m.select(F.col("c").alias("cb"), F.col("w").alias("wb"), F.col("id").alias("b"), F.col("part").alias("pb")), ["cb", "wb", "pb"]).select("field", "a", "b")


def _columns(kb: DataFrame, inputs: DataFrame, triples: DataFrame) -> dict[str, DataFrame]:
    return {"kb.name": rows_of(kb, "entity_id", "name"), "input.entity": rows_of(inputs, "cand_id", "entity"), "sentence": rows_of(triples, "triple_id", "sentence")}


def found(kb: DataFrame, inputs: DataFrame, triples: DataFrame) -> DataFrame:
    """All three columns of the graph tables. Repeated rows count once; empty tables give no rows."""
    c = _columns(kb, inputs, triples)
    w = writings(c)
    row = lambda p, field, a, b: p.select(F.lit(field).alias("field"), F.lit(a).alias("ca"), "wa", F.lit(b).alias("cb"), "wb")
    pairs = (row(class_pairs(w, 1), "kb.name", "kb.name", "kb.name").unionByName(row(class_matches(w, 2, 1), "input.entity", "input.entity", "kb.name"))
             .unionByName(row(class_pairs(w, 4), "sentence", "sentence", "sentence")))
    ids = handed_out(c, pairs).where("field = 'input.entity' OR a <> b")
    number = F.col("field") == "sentence"
    before = F.when(number, F.col("a").cast("bigint") < F.col("b").cast("bigint")).otherwise((F.col("field") == "input.entity") | (F.col("a") < F.col("b")))
    return ids.select("field", F.when(before, F.col("a")).otherwise(F.col("b")).alias("left_id"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("right_id")).distinct()


def forms(kb: DataFrame, inputs: DataFrame, triples: DataFrame) -> DataFrame:
    """(field, id, raw, form, look): the consistent form of every text that changes, and what was detected."""
    every = None
    for name, d in _columns(kb, inputs, triples).items():
        one = d.select(F.lit(name).alias("field"), "id", "raw").distinct()
        every = one if every is None else every.unionByName(one)
    new = materialise(formed(every.select("raw").distinct()), "forms").where("raw <> form").withColumn("w", digest("raw"))
    return every.withColumn("w", digest("raw")).drop("raw").join(new, "w").select("field", "id", "raw", "form", "look")
