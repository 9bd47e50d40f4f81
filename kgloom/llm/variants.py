"""Problem 2: variant spellings of names typed by people.

Noisy-channel attribution. Every spelling (names and aliases of the knowledge base, mentions) is parsed into
a core (surname, or the proper word of an organisation) and the rest (given names, initials, nicknames;
the kind of organisation). The parser undoes what people do by rule: order, titles, dots, initials,
nicknames, abbreviations, case, look-alikes. Typing errors are undone by attribution: each core is
attached to the spelling of maximum posterior among itself and the cores one edit away; candidates meet on one-letter-deletion keys.
The prior is how often a core is written anywhere. The likelihood that a core written m times gives this spelling by an edit is the rate of
that kind of edit (learnt from the spellings that one record of the knowledge base holds side by side) over the number of
such edits a core of that length allows; against it stands the chance that one of the known cores has this spelling of itself, from the entropy
of the script's letters (learnt from the cores). So long cores are attributed and short ones only where the counts speak for it. An
abbreviated form (initials, bare core, short form of a kind) is attached where one being alone gives it, that is with posterior 1.

A being is (type, script, core, first given name, further given names) or (type, script, core, kind).
Incomplete forms go to the only being they fit. Records that share a being in either script are
connected, also through third records, by iterated minimum labels.

Lexica (given names, their counterparts in the other script) are learnt from the knowledge base; a token enters on evidence of its own:
seen before at least ``LEAST`` different last tokens, more often before than last, and not one edit from a token seen with
``RARER`` times as many. Their size is that of a language's stock of given names, whatever the size of the base.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.lookalike import consistent
from kgloom.sources.writers import materialise

LEAST, RARER = 3, 10
# English short forms and the names they stand for
NICKNAMES = """abby abigail; abbie abigail; gail abigail; charlie charles; chuck charles; chas charles; dot dorothy; dottie dorothy; dolly dorothy; beth elizabeth; liz elizabeth; lizzie elizabeth; betty elizabeth;
eliza elizabeth; fred frederick; freddie frederick; freddy frederick; gaby gabrielle; gabby gabrielle; harry harold; hal harold; iggy ignatius; ig ignatius; joe joseph; joey joseph; kate katherine;
kathy katherine; katie katherine; kitty katherine; len leonard; lenny leonard; leo leonard; maggie margaret; meg margaret; peggy margaret; marge margaret; nat nathaniel; nate nathaniel; nathan nathaniel;
oz oswald; ozzie oswald; ozzy oswald; pat patricia; patty patricia; trish patricia; tricia patricia; bob robert; bobby robert; rob robert; robbie robert; bert robert; sam samuel; sammy samuel; tom thomas;
tommy thomas; vicky victoria; vicki victoria; tori victoria; bill william; billy william; will william; willie william; jack john; jim james; mike michael; dick richard; dave david; ed edward; ted edward; kate catherine"""
TITLES_LATIN = {"dr", "prof", "professor", "sir", "mr", "mrs", "ms", "miss", "lord", "dame", "lady", "doctor", "rev", "hon", "st", "phd", "jr", "sr", "the", "of", "for"}
TITLES_HAN = ("教授", "博士", "先生", "女士", "爵士", "院士", "老师", "夫人", "小姐", "同志", "大师", "勋爵", "工程师", "院长", "校长", "主任")
# Kinds of organisation; Latin words (with short forms), then endings in ideographs, longest first
KINDS = {
    "uni": ("university univ", "大学 大"),
    "tech": ("institute technology tech inst technol", "理工学院 理工大学 理工"),
    "res": ("research institute res inst", "研究所 研究院 研究 所"),
    "obs": ("observatory obs observ obsv", "天文台 台"),
    "lab": ("computing laboratory lab comp labs laboratories computer lab.", "计算实验室 计算所 计算室 实验室 室"),
    "soc": ("society soc", "学会 会"),
}
KIND_WORDS = {w for lat, _ in KINDS.values() for w in lat.split()}
HAN_ENDS = sorted(((e, k) for k, (_, han) in KINDS.items() for e in han.split()), key=lambda x: -len(x[0]))
HAN_STARTS = ("国立", "皇家", "原", "旧", "王立", "国家")
NICK: dict[str, set[str]] = {}
for _n in NICKNAMES.replace("\n", " ").split(";"):
    NICK.setdefault(_n.split()[0], set()).add(_n.split()[1])
_HAN = re.compile("[㐀-䶿一-鿿]")
_NICK_MARKS = re.compile(r'["“”「」«»]([^"“”「」«»]{1,12})["“”「」«»]|[(]([A-Za-z]{2,10})[)]')


def plain(s: str | None) -> str:
    """One writing, lower case, without accents."""
    s = unicodedata.normalize("NFD", consistent(s or "").casefold())
    return "".join(c for c in s if not unicodedata.combining(c))


def deletions(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1:] for i in range(len(w))}


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])


class Parser:
    """Parses spellings with a lexicon: given name (either script) -> its Latin name."""

    def __init__(self, given: dict[str, str]):
        self.given = given
        self.names = set(given.values())
        self.by_deletion: dict[str, set[str]] = {}
        for g in given:
            if len(g) >= (3 if _HAN.search(g) else 4):
                for d in deletions(g):
                    self.by_deletion.setdefault(d, set()).add(g)
        self.han = sorted((g for g in given if _HAN.search(g)), key=len, reverse=True)
        self.starts: dict[str, set[str]] = {}
        for g in self.han:
            for n in range(2, len(g)):
                self.starts.setdefault(g[:n], set()).add(g)

    def name_of(self, t: str) -> str | None:
        """The given name a token stands for; ``x.`` for an initial; None if it is none."""
        bare = t.rstrip(".")
        if len(bare) == 1 and bare.isascii() and bare.isalpha():
            return bare + "."
        nick = NICK.get(bare)
        if nick:
            return min(nick, key=lambda n: (n not in self.names, n))
        if bare in self.given:
            return self.given[bare]
        if _HAN.search(bare):
            long = {self.given[g] for g in self.starts.get(bare, ())}
            if len(long) == 1:
                return next(iter(long))
        if len(bare) >= (3 if _HAN.search(bare) else 4):
            hits = {self.given[g] for d in deletions(bare) for g in self.by_deletion.get(d, ()) if near(bare, g)}
            if len(hits) == 1:
                return next(iter(hits))
        return None

    def person(self, raw: str) -> tuple[str, str, str, str] | None:
        """(script, core, first, further) of a person's name; first is "" for a surname alone."""
        s = _NICK_MARKS.sub(" " if not _HAN.search(raw) else "·", plain(raw).replace("'", " "))
        han = bool(_HAN.search(s))
        if han:
            for t in TITLES_HAN:
                if s.strip().endswith(t) and len(s.strip()) > len(t) + 2:
                    s = s.strip()[:-len(t)]
                    break
        comma = re.split(r"\s*[,，、]\s*", s.strip(" ,，、"))
        if len(comma) == 2 and comma[1]:
            s = comma[1] + " " + comma[0]
        toks = [t for t in re.split(r"[\s·•・⋅\-_]+|(?<=[^\W\d_])\.(?=[^\s])|(?<=[㐀-鿿])\.", s) if t and t.strip(".")]
        toks = [t for t in toks if t.rstrip(".") not in TITLES_LATIN] or toks
        if han and len(toks) == 1:
            rest, out = toks[0], []
            m = re.match(r"([a-z])\.?(?=[㐀-鿿])", rest)
            if m:
                out.append(m[1] + ".")
                rest = rest[m.end():]
            while (g := next((g for g in self.han if rest.startswith(g) and len(rest) >= len(g) + 2), None)):
                out.append(g)
                rest = rest[len(g):]
            toks = out + [rest]
        names = [self.name_of(t) for t in toks]
        others = [i for i, n in enumerate(names) if n is None]
        if not others:
            full = [i for i, n in enumerate(names) if not n.endswith(".")]
            if len(toks) == 1 or not full:
                return None
            others = [full[-1]]
        at = others[-1] if len(others) == 1 or others[-1] == len(toks) - 1 else others[0]
        core = toks[at].strip(".")
        rest = [n if n else t for i, (n, t) in enumerate(zip(names, toks)) if i != at]
        if len(core) < 2:
            return None
        return ("han" if han and _HAN.search(core) else "latin", core, rest[0] if rest else "", " ".join(rest[1:]))

    def organisation(self, raw: str) -> tuple[str, str, str, str] | None:
        """(script, core, kind, "") of an organisation's name; kind is "" where none is named."""
        s = _NICK_MARKS.sub(r"\1", plain(raw))
        if _HAN.search(s):
            s = re.sub(r"[\s·,，、.]+", "", s)
            m = re.match(r"^(.+?)[(（](.+?)[)）]$", s)
            if m:
                s = m[2] + m[1]
            for p in HAN_STARTS:
                if s.startswith(p) and len(s) > len(p) + 3:
                    s = s[len(p):]
            for e, k in HAN_ENDS:
                if s.endswith(e) and len(s) >= len(e) + 2:
                    return "han", s[:-len(e)], k, ""
            return ("han", s, "", "") if len(s) >= 2 else None
        toks = [t for t in re.split(r"[\s,()\-_/]+", s) if t.strip(".")]
        bare = [t.strip(".") for t in toks]
        words = [t for t in bare if t not in TITLES_LATIN]
        core = max((t for t in words if t not in KIND_WORDS), key=len, default="")
        if len(core) < 4:
            return None
        have = {t for t in words if t != core}
        heads = "".join(t for t in words if len(t) == 1)
        kind = ("uni" if have & {"university", "univ"} else "obs" if have & {"observatory", "obs", "observ", "obsv"} else "soc" if have & {"society", "soc"} else
                "lab" if have & {"laboratory", "lab", "labs", "computing", "comp"} else "tech" if have & {"technology", "tech", "technol"} else
                "res" if have & {"research", "res"} else {"ri": "res", "it": "tech", "cl": "lab", "u": "uni", "o": "obs", "s": "soc"}.get(heads, ""))
        if not kind and have:
            kind = next((k for k, names in (("uni", ["university"]), ("obs", ["observatory"]), ("soc", ["society"]), ("lab", ["laboratory", "computing"]), ("tech", ["technology"]), ("res", ["research"]))
                         if any(near(t, n) for t in have for n in names)), "")
        return "latin", core, kind, ""


PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("script", "core", "first", "more")])


def parse(spellings: DataFrame, given: dict[str, str]) -> DataFrame:
    """Adds script, core, first, more to (type, raw); unparsable spellings drop out."""
    box: list = []

    def run(kinds: pd.Series, raws: pd.Series) -> pd.DataFrame:
        if not box:
            box.append(Parser(given))
        p = box[0]
        rows = [(p.person(r) if k == "PER" else p.organisation(r)) if isinstance(r, str) and r.strip() else None for k, r in zip(kinds, raws)]
        return pd.DataFrame([r or (None,) * 4 for r in rows], columns=["script", "core", "first", "more"])

    return spellings.withColumn("p", F.pandas_udf(run, PARSED)("type", "raw")).select("*", "p.*").drop("p").where("core IS NOT NULL")


def _deletion_keys(c: str):
    """Column of the spelling and all spellings with one letter less."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))))


def _one_edit(a: str, b: str):
    """The kind of the one edit between two spellings: swap, substitution, letter more or less; null if it takes more."""
    d = F.levenshtein(F.col(a), F.col(b))
    swap = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))  # shared deletion key: neighbours swapped
    return F.when(swap, "swap").when((d == 1) & (F.length(a) == F.length(b)), "other").when(d == 1, "length")


@F.pandas_udf(T.StringType())
def plain_udf(x: pd.Series) -> pd.Series:
    return pd.Series([plain(v) for v in x], dtype=object)


def lexicon(kb: DataFrame) -> dict[str, str]:
    """Given names of both scripts with their Latin name, from the knowledge base's persons."""
    per = kb.where("type = 'PER'").select("entity_id", F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("raw"))
    per = per.where(F.col("raw").rlike(r"^[\p{L}\p{M}]+(?:[ ·][\p{L}\p{M}]+){1,3}$")).distinct().select("entity_id", F.split(plain_udf("raw"), "[ ·]").alias("t")).withColumn("han", F.col("t")[0].rlike("[一-鿿]"))
    per = materialise(per.distinct(), "names")
    last = F.element_at("t", -1)
    seen = per.select("han", F.explode(F.slice("t", 1, F.size("t") - 1)).alias("g"), last.alias("core")).groupBy("han", "g").agg(F.count_distinct("core").alias("n"))
    at_end = per.select("han", last.alias("g"), F.explode(F.slice("t", 1, F.size("t") - 1)).alias("o")).groupBy("han", "g").agg(F.count_distinct("o").alias("k"))
    tok = seen.where((F.col("n") >= LEAST) & (F.length("g") > 1)).join(at_end, ["han", "g"], "left").where("n > coalesce(k, 0)").select("han", "g", "n")
    tok = materialise(tok, "tokens")
    keyed = tok.withColumn("key", F.explode(_deletion_keys("g")))
    often = keyed.select("han", "key", F.col("g").alias("o"), F.col("n").alias("m"))
    typos = keyed.join(often, ["han", "key"]).where((F.col("m") >= RARER * F.col("n")) & _one_edit("g", "o").isNotNull()).select("han", "g").distinct()
    frequent = [(r.han, r.g) for r in tok.join(typos, ["han", "g"], "left_anti").select("han", "g").collect() if r.g not in NICK]  # a language's given names
    latin = {g for h, g in frequent if not h}
    both = per.where("han").alias("a").join(per.where("NOT han").alias("b"), (F.col("a.entity_id") == F.col("b.entity_id")) & (F.size("a.t") == F.size("b.t")))
    both = both.select(F.explode(F.arrays_zip(F.col("a.t").alias("z"), F.col("b.t").alias("l"))).alias("x")).groupBy("x").agg(F.count("*").alias("n")).select(F.col("x.z").alias("z"), F.col("x.l").alias("l"), "n")
    both = both.where(F.col("z").isin([g for h, g in frequent if h]) & F.col("l").isin(sorted(latin))).groupBy("z").agg(F.max_by("l", F.struct("n", "l")).alias("l"))
    to = {r.z: r.l for r in both.collect()}
    return {g: (to.get(g, g) if h else g) for h, g in frequent}


def channel(spelt: DataFrame, cores: DataFrame) -> DataFrame:
    """(script, kind, rate, entropy, letters, known): a row per script and kind of edit.

    ``spelt`` (entity_id, type, script, core): what one record holds side by side; ``rate`` is the share of these cores that stand one such edit from
    another of their record (half an edit is added, so an unseen kind is rare, not impossible). ``entropy`` and ``letters`` of a script's cores; ``known`` distinct cores.
    """
    k = spelt.distinct().withColumn("key", F.explode(_deletion_keys("core")))
    pairs = k.join(k.withColumnRenamed("core", "other"), ["entity_id", "type", "script", "key"]).where("core < other").select("entity_id", "type", "script", "core", "other").distinct()
    pairs = pairs.withColumn("kind", _one_edit("core", "other")).where("kind IS NOT NULL").groupBy("script", "kind").agg(F.count("*").alias("edits"))
    all_ = spelt.distinct().groupBy("script").agg(F.count("*").alias("n"))
    f = cores.select("script", F.explode(F.split("core", "")).alias("c")).where("c <> ''").groupBy("script", "c").agg(F.count("*").alias("n"))
    h = f.join(f.groupBy("script").agg(F.sum("n").alias("all")), "script").groupBy("script").agg((-F.sum(F.col("n") / F.col("all") * F.log(F.col("n") / F.col("all")))).alias("entropy"), F.count("*").alias("letters"))
    known = cores.where("held").groupBy("script").agg(F.count("*").alias("known"))
    kinds = h.join(known, "script").select("*", F.explode(F.array(F.lit("swap"), F.lit("other"), F.lit("length"))).alias("kind"))
    return kinds.join(all_, "script").join(pairs, ["script", "kind"], "left").select("script", "kind", ((F.coalesce("edits", F.lit(0)) + 0.5) / (F.col("n") + 1)).alias("rate"), "entropy", "letters", "known")


def attributed(cores: DataFrame, noise: DataFrame) -> DataFrame:
    """(type, script, core, canon): each core of (type, script, core, n, held) attached to its maximum posterior among held cores one edit away and itself."""
    keyed = cores.where(F.length("core") >= 2).withColumn("key", F.explode(_deletion_keys("core")))
    a, b = keyed.alias("a"), keyed.where("held").alias("b")
    p = a.join(b, (F.col("a.type") == F.col("b.type")) & (F.col("a.script") == F.col("b.script")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.core") != F.col("b.core")))
    p = p.select("a.type", "a.script", "a.core", F.col("a.n").alias("n"), F.col("a.held").alias("held"), F.col("b.core").alias("other"), F.col("b.n").alias("m")).distinct()
    p = p.withColumn("kind", _one_edit("core", "other")).where("kind IS NOT NULL").join(noise, ["script", "kind"])
    edits = F.when(F.col("kind") == "swap", F.length("core") - 1).otherwise(F.length("core") * F.col("letters"))
    by_edit = F.log("m") + F.log("rate") - F.log(edits)
    of_itself = F.log("known") - F.length("core") * F.col("entropy")
    # a core the knowledge base lacks has no being of its own; of two it holds, the one written more often may be meant by the other
    p = p.where((by_edit > of_itself) & (~F.col("held") | (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("core")))))
    best = p.groupBy("type", "script", "core").agg(F.max_by("other", F.struct(by_edit, "other")).alias("other"))
    return cores.join(best, ["type", "script", "core"], "left").select("type", "script", "core", F.coalesce("other", "core").alias("canon"))


def resolved(forms: DataFrame) -> DataFrame:
    """Adds ``being`` to distinct forms (type, script, canon, first, more, held): the only being of the knowledge base a form fits, or null.

    Full forms (a first given name, or a kind) make beings where the knowledge base holds them; of these a form without
    further names takes the only one with the same first name. Initials and bare cores take the only being of their core that fits.
    """
    g = ["type", "script", "canon"]
    full = (F.col("first") != "") & ~F.col("first").endswith(".")
    made = forms.where(full & F.col("held")).select(*g, "first", F.when(F.col("more").rlike(r"\."), "").otherwise(F.col("more")).alias("more")).distinct()
    longest = made.groupBy(*g, "first").agg(F.collect_set("more").alias("mores"))  # combinations of given names, not rows
    some = F.filter("mores", lambda m: m != "")
    longest = longest.withColumn("mores", F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(""))))
    beings = longest.select(*g, F.explode(F.transform("mores", lambda m: F.struct(F.col("first").alias("first"), m.alias("more")))).alias("b"))
    beings = beings.groupBy(*g).agg(F.sort_array(F.collect_set("b")).alias("bs"))
    first, more = F.col("first"), F.col("more")

    def fits(b):
        head = F.when(first == "", True).when(first.endswith("."), F.substring(b["first"], 1, 1) == F.substring(first, 1, 1)).otherwise(b["first"] == first)
        initials = F.regexp_replace(more, r"([a-z])[^ ]*", "$1")
        rest = (more == "") | (b["more"] == "") | (b["more"] == more) | (more.rlike(r"\.") & (F.regexp_replace(b["more"], r"([a-z])[^ ]*", "$1") == F.regexp_replace(initials, r"\.", "")))
        return head & rest

    f = forms.join(beings, g).withColumn("ok", F.filter("bs", fits)).withColumn("same", F.filter("ok", lambda b: b["more"] == more))
    one = F.when(F.size("ok") == 1, F.col("ok")[0]).when((F.size("same") == 1) & (more != ""), F.col("same")[0])
    return f.withColumn("b", one).where("b IS NOT NULL").select(*g, "first", "more", F.concat_ws("|", *g, F.col("b.first"), F.col("b.more")).alias("being"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the undirected graph (a, b): iterated minimum labels with pointer jumping, each round written to the shared folder."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = materialise(labels, "labels")
        low = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        new = labels.join(low, labels.node == low.a, "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("to"))
        new = new.join(labels.select(F.col("node").alias("to"), F.col("label").alias("far")), "to", "left").select("node", F.col("label").alias("was"), F.least("to", F.coalesce("far", "to")).alias("label"))
        new = materialise(new, "labels")
        if new.where("was <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def linked_records(kb: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id_beings, mention_beings, classes).

    id_beings (entity_id, being) of all persons and organisations of the knowledge base, mention_beings
    (mention_id, being) of unlinked mentions, classes (being, label) where beings are connected through records.
    Null names, aliases and mentions give nothing; repeated rows count once; empty tables give empty results.
    """
    kinds = F.col("type").isin("PER", "ORG")
    named = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    k = kb.where(kinds).select("entity_id", "type", F.explode(named).alias("raw")).distinct()
    m = mentions.select("mention_id", F.col("entity_type").alias("type"), F.col("mention").alias("raw"), "entity_id").where(kinds & F.col("raw").isNotNull())
    counts = k.select("type", "raw").unionByName(m.select("type", "raw")).groupBy("type", "raw").agg(F.count("*").alias("n"))
    counts = counts.join(k.select("type", "raw").distinct().withColumn("held", F.lit(True)), ["type", "raw"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    parsed = materialise(parse(counts, lexicon(kb)), "spellings")
    cores = parsed.groupBy("type", "script", "core").agg(F.sum("n").alias("n"), F.max("held").alias("held"))
    side_by_side = k.join(parsed.where("held"), ["type", "raw"]).select("entity_id", "type", "script", "core")
    canon = attributed(cores, materialise(channel(side_by_side, cores), "channel"))
    spelt = parsed.join(canon, ["type", "script", "core"])
    forms = spelt.groupBy("type", "script", "canon", "first", "more").agg(F.max("held").alias("held"))
    being = resolved(forms)
    table = materialise(spelt.join(being, ["type", "script", "canon", "first", "more"]).select("type", "raw", "being", "first"), "beings")
    # a surname alone says nothing of who a record of the knowledge base is
    ids = materialise(k.join(table.where("first <> ''"), ["type", "raw"]).select("entity_id", "being").distinct(), "ids")
    free = m.where("entity_id IS NULL OR upper(regexp_replace(entity_id, '(?U)\\\\s', '')) IN ('', 'NIL')").select("mention_id", "type", "raw").distinct()
    mb = free.join(table, ["type", "raw"]).select("mention_id", "being").distinct()
    shared = ids.join(ids.groupBy("being").agg(F.count("*").alias("k")).where("k > 1").select("being"), "being", "left_semi")
    comps = connected(ids.join(shared.select("entity_id").distinct(), "entity_id", "left_semi").select(F.concat(F.lit("e:"), "entity_id").alias("a"), F.concat(F.lit("b:"), "being").alias("b")))
    return ids, mb, comps


def found(kb: DataFrame, mentions: DataFrame) -> DataFrame:
    """(left_id, right_id): pairs of ids of one being, and unlinked mentions with every id of the being they name."""
    ids, mb, comps = linked_records(kb, mentions)
    e = comps.where("node LIKE 'e:%'").select(F.substring("node", 3, 1 << 20).alias("entity_id"), "label")
    b = comps.where("node LIKE 'b:%'").select(F.substring("node", 3, 1 << 20).alias("being"), "label")
    x, y = e.toDF("left_id", "label"), e.toDF("right_id", "label")
    pairs = x.join(y, "label").where("left_id < right_id").select("left_id", "right_id")
    cls = F.coalesce("label", F.concat(F.lit("b:"), "being"))
    of_being = ids.select("being", "entity_id").join(b, "being", "left").select(cls.alias("cls"), "entity_id").unionByName(e.select(F.col("label").alias("cls"), "entity_id")).distinct()
    mention = mb.join(b, "being", "left").select("mention_id", cls.alias("cls")).distinct()
    return pairs.unionByName(mention.join(of_being, "cls").select(F.col("mention_id").cast("string").alias("left_id"), F.col("entity_id").alias("right_id"))).distinct()
