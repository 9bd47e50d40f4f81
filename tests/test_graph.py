"""Documents to graphs on small fixtures: every operator against what a plain loop or a reader would give."""
import random
import re

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import entities, evaluate, extract, graph, learn, link, relations, titles
from kgloom.operators import open_relations as R_
from kgloom.packs import rules as R
from kgloom.sources import readers, writers

MENTION = "mention_id long, source_file string, mention string, entity_type string, start int, end int, entity_id string, kb_name string, link_score double, source string"


def mentions_of(text, names, doc="d"):
    """All places of names (name, type, id) in a text, as rows."""
    out = []
    for name, kind, eid in names:
        at = text.find(name)
        while at >= 0:
            out.append((len(out), doc, name, kind, at, at + len(name), eid, name if eid else None, 0.9 if eid else 0.2, "kb_dict"))
            at = text.find(name, at + 1)
    return out


def found(spark, text, names, operator):
    docs = spark.createDataFrame([(1, "d", text, 0), (2, "e", None, 0), (3, "f", "", 0)], "doc_id long, source_file string, text string, ents int")
    m = spark.createDataFrame(mentions_of(text, names) + [(99, "d", None, "PER", 0, 1, "X", None, None, None)], MENTION)
    return {(r.relation_id[2:], r["head"], r["tail"], r.surface) for r in operator(docs, m).collect()}


def test_running_starts_and_occurrences(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab*") for _ in range(rng.randint(0, 300))) for _ in range(40)] + [None, ""]
    d = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts) for n in ("ab", "*a", "b")], "i int, t string, n string")
    for r in d.select("t", "n", X.occurrences(F.col("t"), F.col("n")).alias("o"), X.matches(F.col("t"), "a+b").alias("m")).collect():
        if r.t is not None:
            want, at = [], r.t.find(r.n)
            while at >= 0:
                want.append(at)
                at = r.t.find(r.n, at + len(r.n))
            assert r.o == want
            import re
            assert [(m.pos, m.whole) for m in r.m] == [(m.start(), m[0]) for m in re.finditer("a+b", r.t)]
    n = spark.range(1).select(X.running_starts(F.array(*[F.lit(i % 7) for i in range(200)])).alias("s")).first().s
    assert n == [sum(k % 7 for k in range(i)) for i in range(200)]


def test_matches_cut_a_text_once(spark):
    d = spark.createDataFrame([("甲大学·a b",), ("",), (None,), ("ab",)], "t string")
    m = d.select(X.matches(F.col("t"), "大学|·", holds=["大学", "·"]).alias("m"), X.matches(F.col("t"), "大学|·").alias("n"))
    assert [(r.m, r.n) for r in m.collect()] == [([(1, "大学", "大学"), (3, "·", "·")],) * 2, ([], []), (None, None), ([], [])]
    assert d.select(X.matches(F.col("t"), "大学|·").alias("m"))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    blanks = [" \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000", "\u200b\ufeff\x1c甲 "]
    s = spark.createDataFrame([(b, x + b + y) for b in blanks for x in ("", " 甲\n", "\x85") for y in ("", "乙", "\n\r")], "b string, t string")
    for r in s.select("t", X.strip(F.col("t")).alias("s"), F.regexp_replace("t", f"^[{R.BLANKS}]+|[{R.BLANKS}]+$", "").alias("want")).collect():
        assert r.s == r.want


def test_section_offsets_against_a_loop(spark):
    texts = ["标题一\n正文，在此。\n第二行，也是。\n标题二\n\n另一段，。", "只有标题", "没有标题的长长的一行文字，有标点。", "", None, "标题\n 前有空格，。\n\n后来，。"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {}
    for r in X.section_offsets(d, "doc_id").orderBy("doc_id", "sec_idx").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.start, r.end))
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        secs, title, body = [], "全文", []
        for line in [x.strip() for x in t.split("\n")] + [None]:
            if line is None or (line and len(line) <= 20 and not any(c in "，。！？；：“”\"'（）()" for c in line)):
                if body:
                    secs.append((title, "\n".join(body)))
                title, body = line, []
            elif line:
                body.append(line)
        want, at = [], 0
        for title, b in secs or [("全文", t)]:
            start = t.find(b, at)
            start = at if start < 0 else start
            at = start + len(b)
            want.append((title, start, at))
        assert got[i] == want


def test_mentions_in_sentences_and_sections(spark):
    docs = spark.createDataFrame([(1, "d", "A一。B二。\nC三。")], "doc_id long, source_file string, text string")
    m = spark.createDataFrame([(1, "d", 0, 2), (2, "d", 2, 4), (3, "d", 3, 6), (4, "d", 7, 9), (5, "x", 0, 1)], "mention_id long, source_file string, start int, end int")
    assert {(r.mention_id, r.sent_idx) for r in relations.in_sentences(docs, m).collect()} == {(1, 0), (3, 1), (4, 2)}
    text = "头\n甲，乙，。\n尾\n丙，丁，。"
    d = spark.createDataFrame([(1, "d", text)], "doc_id long, source_file string, text string")
    got = {r.mention_id: r.title for r in entities.in_sections(spark.createDataFrame([(i, "d", i, i + 1) for i in range(len(text))], "mention_id long, source_file string, start int, end int"), d).collect()}
    assert got[2] == "头" and got[0] is None and got[len(text) - 1] == "尾" and len(got) == len(text)


def test_own_names_and_patterns(spark):
    text = "他写了《密码论》（英语：On Secret Numbers of the King）。阿兰·图尔，见 John Smith，后在国立剑桥大学与ACME共事，提出ABC勋章。"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    kb = spark.createDataFrame([("E", "密码论", ["Cipher"], "PROD")], "entity_id string, name string, aliases array<string>, type string")
    got = {(r.name, r.label) for r in extract.own_names(d, kb, "doc_id").collect()}
    assert {("阿兰·图尔", "PER"), ("John Smith", "PER"), ("On Secret Numbers of the King", "PROD")} <= got and ("密码论", "PROD") not in got
    rx = {(r.text, r.label, r.start) for r in extract.regex_extract(d, "doc_id").collect()}
    assert ("John Smith", "PER", text.index("John")) in rx and ("On Secret Numbers of the King", "PROD", text.index("On ")) in rx
    spans = extract.document_mentions(d, kb, "doc_id").collect()
    assert all(r.text == text[r.start:r.end] for r in spans if "[" not in r.text) and all(a.end <= b.start or b.end <= a.start for a in spans for b in spans if a is not b)


def test_dict_extract_long_names_and_texts(spark):
    long = "非常" * 60 + "名"
    text = "前" * 1500 + long + "aab" * 700 + "aaaa"
    lex = spark.createDataFrame([(long, "PROD"), ("aa", "X"), ("ab", "Y"), ("b", "Z"), ("前" * 3, "W")], "name string, label string")
    got = {(r.start, r.end, r.text) for r in extract.dict_extract(spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0)], "k int, text string, a int"), lex, "k").collect()}
    want = {(i, i + len(n), n) for n in (long, "aa", "ab", "前" * 3) for i in range(len(text)) if text.startswith(n, i)}
    assert got == want


def test_dict_extract_moves_no_rows_per_place(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("伯特莱姆德 ") for _ in range(k))
    names = {("罗伯特·" + word(rng.randint(1, 6))).strip() for _ in range(400)} | {"罗伯", "特·", "罗伯特·伯特伯特" * 9, "\U0001f600b", "x"}
    lex = spark.createDataFrame([(n, k) for n in names for k in ("PER", "ORG")[:1 + len(n) % 2]], "name string, label string")
    texts = [(i, "".join(rng.choice(sorted(names)) + word(3) for _ in range(30))) for i in range(20)] + [(1, "罗伯特·伯罗"), (21, "罗"), (22, ""), (23, None), (24, "b\U0001f600b罗伯特·")]
    out = extract.dict_extract(spark.createDataFrame(texts * 2, "k int, text string"), lex, "k")
    want = [(k, i, i + len(n), lab, n) for k, t in set(texts) if t for n in names if len(n) > 1 for lab in ("PER", "ORG")[:1 + len(n) % 2] for i in range(len(t)) if t.startswith(n, i)]
    assert sorted(map(tuple, out.select("k", "start", "end", "label", "text").collect())) == sorted(want) and len(want) > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # no row for each place of a text
    assert extract.dict_extract(spark.createDataFrame(texts, "k int, text string"), lex.where("false"), "k").count() == 0


@pytest.mark.parametrize("name", ["error_breakdown", "missed_spurious", "ner_prf_micro", "merge_spans", "ner_prf", "overlap_detect"])
def test_span_queries_move_no_rows_per_place(spark, tmp_path, name):
    from kgloom.plans.graph_queries import QUERIES
    spark.createDataFrame([("A", "Rob Smith", ["R. Smith", "Rob"], "PER"), ("B", "East Hill", None, "LOC")], "entity_id string, name string, aliases array<string>, type string").write.parquet(str(tmp_path / "kb.parquet"))
    spark.createDataFrame([(1, "Rob Smith saw East Hill. Rob", [(0, 3, "PER"), (14, 23, "LOC")]), (2, None, None)], "sample_id long, text string, entities array<struct<start:int,end:int,label:string>>").write.parquet(str(tmp_path / "ner_train.parquet"))
    out = QUERIES[name](spark, str(tmp_path))
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count()


SPAN_QUERIES = ["error_breakdown", "missed_spurious", "ner_prf_micro", "merge_spans", "ner_prf", "overlap_detect"]


@pytest.mark.parametrize("name", SPAN_QUERIES)
def test_span_queries_leave_texts_where_they_lie(spark, tmp_path, name):
    from kgloom.plans.graph_queries import ORACLES, QUERIES
    from tests.compare import compare
    spark.createDataFrame([("A", "Rob Smith", ["R. Smith", "Rob"], "PER"), ("B", "East Hill", None, "LOC"), ("C", "Hill", ["Rob"], None), ("D", "East Hill", None, "ORG")], "entity_id string, name string, aliases array<string>, type string").write.parquet(str(tmp_path / "kb.parquet"))
    rows = [(1, "Rob Smith saw East Hill. Rob", [(0, 3, "PER"), (14, 23, "LOC"), (14, 23, "PER"), (19, 23, None)]), (2, None, None), (3, "Rob", None), (4, "Rob and Rob", [(0, 5, "PER")]), (4, "Rob or East Hill", [(7, 16, "LOC")]), (5, "no name", [(0, 2, "LOC")]), (6, "", [])]
    spark.createDataFrame(rows + rows[:1], "sample_id long, text string, entities array<struct<start:int,end:int,label:string>>").write.parquet(str(tmp_path / "ner_train.parquet"))
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[\w+#\w+, (text|whole)#", plan) and plan.count("MapInArrow run(") == 1  # no shuffle of texts, one search
    if name in ORACLES:
        assert compare(spark, str(tmp_path), name, QUERIES[name], ORACLES[name]) is None


def test_titles(spark):
    d = spark.createDataFrame([(1, "他发表《计算理论》（英语：Theory of Computing Machines）和“该书”，题为On Numbers of Kings and The Great Machine Test。"), (2, None)], "doc_id int, text string")
    t = d.select(titles.sentence_titles(F.col("text")).alias("t")).first().t
    assert t[0] == "计算理论" and "该书" not in t and "On Numbers of Kings" in t
    p = {r.alias: r.title for r in titles.title_pairs(d, "doc_id").collect()}
    assert p == {"Theory of Computing Machines": "计算理论", "Theory of": "计算理论", "Theory of Computing": "计算理论"}
    pairs = F.array(F.struct(F.lit(0).alias("pos"), F.lit("Theory of Computing Machines").alias("alias"), F.lit("计算理论").alias("title")))
    one = spark.range(1).select(*[titles.canonical_title(F.lit(x), pairs).alias(f"c{i}") for i, x in enumerate(("Theory of Computing Machines", "Theory of Comp", "Theory", " x "))]).first()
    assert tuple(one) == ("计算理论", "计算理论", "Theory", "x")


@pytest.mark.parametrize("text,names,want", [
    ("王明出生于北京市。", [("王明", "PER", "P"), ("北京市", "LOC", "L")], ("BORN_IN", "王明", "北京市", "出生")),
    ("王明考入东山大学。", [("王明", "PER", "P"), ("东山大学", "ORG", "O")], ("STUDIED_AT", "王明", "东山大学", "考入")),
    ("西山报社向王明道歉。", [("王明", "PER", "P"), ("西山报社", "ORG", "O")], ("APOLOGIZED_TO", "西山报社", "王明", "向...道歉")),
    ("东山学会的继任者是西山学会。", [("东山学会", "ORG", "A"), ("西山学会", "ORG", "B")], ("SUCCESSOR_OF", "西山学会", "东山学会", "继任者")),
    ("王明与李华一起散步。", [("王明", "PER", "P"), ("李华", "PER", "Q")], ("COLLABORATED_WITH", "王明", "李华", "一起")),
    ("东山学会研究员王明来了。", [("东山学会", "ORG", "A"), ("王明", "PER", "P")], ("WORKED_FOR", "王明", "东山学会", "ORG_ROLE_PER")),
    ("王明被授奖，任命为大勋章。", [("王明", "PER", "P"), ("大勋章", "PROD", "M")], ("AWARDED", "王明", "大勋章", "被...任命为"))])
def test_templates(spark, text, names, want):
    assert want in found(spark, text, names, lambda d, m: R_.structured(R_.sentence_rows(d, R_.entities(m))))


def test_producers_and_state(spark):
    names = [("王明", "PER", "P"), ("东山大学", "ORG", "O"), ("西山学会", "ORG", "S"), ("密码机", "PROD", "M"), ("某物", "PROD", None)]
    text = "王明考入东山大学。他设计密码机。后来毕业。王明在西山学会工作。他被誉为机器之父。"
    got = found(spark, text, names, lambda d, m: R_.open_relations(d, m, R.rules(spark)))
    assert {("GRADUATED_FROM", "王明", "东山大学", "毕业"), ("DESIGNED", "王明", "密码机", "设计"), ("WORKED_FOR", "王明", "西山学会", "在...工作"), ("REPUTED_AS", "王明", "机器之父", "被誉为")} <= got
    both = found(spark, text, names, lambda d, m: R_.payload(d, m, R.rules(spark)))
    assert {g[:3] for g in both} <= {g[:3] for g in got} and len({g[:3] for g in both}) == len(both)
    docs = spark.createDataFrame([(1, "d", text)], "doc_id long, source_file string, text string")
    m = spark.createDataFrame(mentions_of(text, names), MENTION)
    nodes = {r.node_id: (r.name, r.type) for r in R_.graph_nodes(R_.payload(docs, m, R.rules(spark)), R_.entities(m)).collect()}
    assert nodes["P"] == ("王明", "PER") and nodes["MENTION::机器之父"] == ("机器之父", "CONCEPT")
    assert R_.payload(docs.limit(0), m.limit(0), R.rules(spark)).count() == 0


def test_rejects(spark):
    rows = [("R_CRACKED", "甲", "a", "Bombe", "b", "破译", "x", False), ("R_CRACKED", "甲", "a", "密码", "b", "破译", "x", True), ("R_WROTE", "甲", "a", "某书", None, "写了", "写了某书", False), ("R_WROTE", "甲", "a", "某书", None, "写了", "写了《某书》", True),
            ("R_COLLABORATED_WITH", "甲", "a", "乙", "b", "合作", "根据说法合作", False), ("R_CONVICTED", "甲", "a", "乙", "b", "定罪", "乙被定罪", False), ("R_CONVICTED", "甲", "a", "乙", "b", "被控", "被控", True)]
    d = spark.createDataFrame(rows, "relation_id string, head string, head_id string, tail string, tail_id string, surface string, sentence string, ok boolean")
    assert [tuple(r) for r in R_.keep(d).collect()] == [r for r in rows if r[-1]]


def test_linker_against_difflib(spark):
    from difflib import SequenceMatcher
    kb = spark.createDataFrame([("A", "Rob Smith", ["R. Smith"], "PER", "a writer of tide tables"), ("B", "Rob Smyth", None, "PER", None), ("C", None, None, "ORG", None), ("D", "东山大学", ["East Hill University"], "ORG", "大学")],
                               "entity_id string, name string, aliases array<string>, type string, description string")
    m = spark.createDataFrame([(1, "Rob Smith", "PER", "d", 1), (2, "Rob Smiths", "X", "d", 1), (3, "东山", "ORG", "d", 1), (4, None, None, "d", 1), (5, "zz", "PER", None, 1), (6, "东山大学", "LOC", "x", 1), (1, "Rob Smith", "PER", "d", 1)], "mention_id long, mention string, entity_type string, source_file string, q int")
    docs = spark.createDataFrame([("d", "Rob Smith is a writer of tide tables."), ("y", None)], "source_file string, text string")
    got = {r.mention_id: r for r in link.link_mentions(m, docs, kb).collect()}
    assert len(got) == 6 and got[1].entity_id == "A" and got[2].entity_id == "A" and got[3].entity_id is None and got[6].entity_id == "D" and got[6].entity_type == "ORG" and got[4].link_score == 0
    assert 0.65 <= got[1].link_score <= 1 and got[2].link_score < got[1].link_score
    s = link._surface(__import__("pandas").Series(["Rob Smiths"]), __import__("pandas").Series([["Rob Smith", "x"]]))
    assert abs(s[0] - SequenceMatcher(None, "Rob Smiths", "Rob Smith").ratio()) < 1e-9


def test_linker_makes_no_row_per_gram_and_equals_a_loop(spark, monkeypatch):
    from collections import Counter
    from difflib import SequenceMatcher
    from math import log, sqrt
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcd 山é\U0001f600") for _ in range(k)).strip() or "ab"
    base = [(f"E{i:02}", word(6), [word(4)] if i % 3 else None, "PER", word(20) if i % 4 else None) for i in range(40)]
    docs = [(f"d{i % 9}", (word(90) + "  " + base[i][1]) if i != 5 else None) for i in range(12)]  # three files have two texts
    ms = [(k, rng.choice(base)[1] if k % 2 else word(5), "X", f"d{k % 11}" if k % 13 else None) for k in range(60)]
    kb = spark.createDataFrame(base, "entity_id string, name string, aliases array<string>, type string, description string")
    asked = spark.createDataFrame(ms + ms[:3], "mention_id long, mention string, entity_type string, source_file string")
    texts = spark.createDataFrame(docs, "source_file string, text string")
    monkeypatch.setattr(link, "grams", None)  # neither names nor documents become a row per gram
    runs = []
    for q, m, r, c, chars in ((32768, 196608, 50000, 200000, 1 << 18), (9, 17, 13, 11, 100)):
        for k, v in (("QUERY_BLOCK", q), ("MENTION_BLOCK", m), ("RECORD_BLOCK", r), ("CONTEXT_BLOCK", c), ("CHARS", chars)):
            monkeypatch.setattr(link, k, v)
        runs.append({x.mention_id: x.link_score for x in link.link_mentions(asked, texts, kb).collect()})
    assert runs[0] == runs[1] and len(runs[0]) == 60

    def counted(t, n):
        t = re.sub(r"\s\s+", " ", t.lower())
        return Counter(t[i:i + k] for k in range(1, n + 1) for i in range(len(t) - k + 1))

    def space(rows, n):
        g = {e: counted(t, n) for e, t in rows.items() if t}
        df = Counter(x for c in g.values() for x in c)
        idf = {x: log((1 + len(g)) / (1 + v)) + 1 for x, v in df.items()}

        def vector(c):
            w = {x: k * idf[x] for x, k in c.items() if x in idf}
            norm = sqrt(sum(v * v for v in w.values()))
            return {x: v / norm for x, v in w.items()}
        return {e: vector(c) for e, c in g.items()}, vector
    cos = lambda a, b: round(sum(v * b.get(x, 0.0) for x, v in a.items()), 6)
    names = {e: [n, *(a or [])] for e, n, a, _, _ in base}
    by_name, name = space({e: " ".join(v) for e, v in names.items()}, 3)
    by_text, text = space({e: n + (" " + d if d else "") for e, n, _, _, d in base}, 2)
    whole = {f: text(sum((counted(t, 2) for g, t in docs if g == f and t), Counter())) for f, _ in docs}
    for k, q, _, f in ms:
        if f is None:
            assert runs[0][k] == 0
            continue
        best = sorted(((cos(name(counted(q, 3)), v), e) for e, v in by_name.items()), reverse=True)[:5]
        want = max(0.65 * max(1.0 if q == b else SequenceMatcher(None, q, b).ratio() for b in names[e]) + 0.35 * cos(whole.get(f, {}), by_text[e]) for _, e in best)
        assert abs(runs[0][k] - want) < 3e-6, (k, q, f)


def test_candidates_against_a_loop(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 9)))
    kb = link.kb_rows(spark.createDataFrame([(f"E{i:02}", word() + "a", [word()], "PER") for i in range(30)], "entity_id string, name string, aliases array<string>, type string"))
    q = spark.createDataFrame([(w,) for w in {word().strip() for _ in range(25)} if w], "q string")
    one = {(r.q, r.rank): (r.entity_id, round(r.sim, 4)) for r in link.candidates(q, kb, 5).collect()}
    monkeypatch.setattr(link, "QUERY_BLOCK", 7)
    monkeypatch.setattr(link, "RECORD_BLOCK", 11)
    assert one == {(r.q, r.rank): (r.entity_id, round(r.sim, 4)) for r in link.candidates(q, kb, 5).collect()} and len(one) == 5 * q.count()


def test_candidates_in_uncoalesced_partitions(spark, monkeypatch):
    monkeypatch.setattr(link, "QUERY_BLOCK", 5)
    monkeypatch.setattr(link, "RECORD_BLOCK", 9)
    kb = link.kb_rows(spark.createDataFrame([(f"E{i:02}", f"name {i * i}", None, "PER") for i in range(30)], "entity_id string, name string, aliases array<string>, type string"))
    q = spark.createDataFrame([(f"name {i * i}",) for i in range(30)], "q string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = link.candidates(q, kb, 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.q, r.entity_id) for r in got if r["rank"] == 1} == {(f"name {i * i}", f"E{i:02}") for i in range(30)} and len(got) == 60


@pytest.mark.parametrize("common", [0.02, -1.0, 1.0])
def test_pruned_candidates_equal_all_pairs(spark, monkeypatch, common):
    import inspect
    import numpy as np
    import pyarrow as pa
    assert "pa.Table" in str(inspect.signature(link._best_of_block(3)))  # numbers of a block, no row of text for each gram
    rng = np.random.default_rng(4)
    monkeypatch.setattr(link, "COMMON", common)
    records, asked = [], []
    for out, count in ((records, 500), (asked, 80)):
        for _ in range(count):
            codes = sorted({int(x) for x in np.minimum(rng.zipf(1.3, rng.integers(0, 14)), 400)} | ({1, 2, 3} if count == 500 else set()))
            w = rng.random(len(codes)) + 0.01
            out.append((codes, (w / np.sqrt((w * w).sum())).tolist() if len(codes) else []))
    table = lambda rows, name: pa.table({name: [f"{name}{k:03}" for k in range(len(rows))], "codes": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "ws": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    got = link._best_of_block(3)(table(asked, "q"), table(records, "entity_id")).to_pylist()
    want = []
    for k, (c, w) in enumerate(asked):
        own = dict(zip(c, w))
        sims = [(round(sum(own.get(g, 0.0) * x for g, x in zip(rc, rw)), 6), f"entity_id{i:03}") for i, (rc, rw) in enumerate(records)]
        want += [(f"q{k:03}", e, s) for s, e in sorted(sims, reverse=True)[:3]]
    assert [(r["q"], r["entity_id"]) for r in got] == [x[:2] for x in want] and all(abs(r["sim"] - x[2]) < 2e-6 for r, x in zip(got, want))


def test_grouped_entities(spark):
    docs = spark.createDataFrame([("d", "头\n甲乙，丙。\n尾\n甲，。")], "source_file string, text string")
    m = spark.createDataFrame([(1, "d", "甲", "PER", 2, 3, " e1", "甲乙", "甲乙", 0.5, "ner"), (2, "d", "甲", "PER", 10, 11, "E1", "甲乙", "甲乙", 0.7, "ner"), (3, "d", "丙", "LOC", 5, 6, None, None, "丙", 0.1, "ner"), (4, "d", "乙", "LOC", 3, 4, "NIL", None, "乙", 0.1, "kb_dict"), (1, "d", "甲", "PER", 2, 3, " e1", "甲乙", "甲乙", 0.5, "ner")],
                              "mention_id long, source_file string, mention string, entity_type string, start int, end int, entity_id string, kb_name string, normalized_entity string, link_score double, source string")
    got = {r.normalized_entity: r for r in entities.grouped(m, docs).collect()}
    assert set(got) == {"E1", "乙"} and got["E1"].mention_count == 2 and got["E1"].section_titles == "头 | 尾" and got["E1"].disambiguation_basis == "entity_id=E1; mentions=2; avg_link_score=0.6000"


def test_merge_spans_against_a_loop(spark):
    rng = random.Random(9)
    rows = []
    for k in range(30):
        for _ in range(12):
            a = rng.randint(0, 20)
            b = a + rng.randint(2, 6)
            rows.append((k, a, b, rng.choice(["PER", "ORG"]), "x" * (b - a), rng.choice(["kb_dict", "ner", "regex"])))
    rows = [(*r, {"kb_dict": 3, "ner": 0, "regex": 2}[r[5]], {"ner": 0, "kb_dict": 1, "regex": 2}[r[5]]) for r in dict.fromkeys(rows)]
    d = spark.createDataFrame(rows, "k int, start int, end int, label string, text string, source string, prio int, turn int")
    got = {(r.k, r.start, r.end, r.label, r.source) for r in extract.merge_spans(d, "k").collect()}
    want = set()
    for k in range(30):
        kept = []
        for r in sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2], r[7], r[3], r[4])):
            if any(x[1:4] == r[1:4] for x in kept):
                continue
            laps = [x for x in kept if x[1] < r[2] and r[1] < x[2]]
            if all((r[6], r[2] - r[1]) > (x[6], x[2] - x[1]) for x in laps):
                kept = [x for x in kept if x not in laps] + [r]
        want |= {(r[0], r[1], r[2], r[3], r[5]) for r in kept}
    assert got == want


def test_breadth_first_over_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(9)] + [("x", "y")], "hk string, tk string")
    got = {r.node: r.dist for r in graph.distances(e, spark.createDataFrame([("n00",)], "node string")).collect()}
    assert got == {f"n{i:02}": i for i in range(10)}


def test_classifier_and_tagger_on_held_out_records(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("赵钱孙李周吴郑王") for _ in range(2))

    def re_row(i):
        verb, label = rng.choice([("就读于", "STUDIED_AT"), ("住在", "LIVED_IN"), ("路过", "NO_REL")])
        a, b = name(), name()
        return i, "s", a + verb + b + "。", (0, 2, "PER"), (2 + len(verb), 4 + len(verb), "ORG"), label
    span = "struct<start:int,end:int,label:string>"
    rows = spark.createDataFrame([re_row(i) for i in range(160)], f"sample_id long, source string, text string, head {span}, tail {span}, label string")
    p = learn.relation_classifier(rows.where("sample_id < 120"), rows.where("sample_id >= 120")).collect()
    assert len(p) == 40 and sum(r.gold == r.pred for r in p) >= 36
    ner = []
    for i in range(60):
        a, b = name(), name()
        ner.append((i, f"昨天{a}先生去了{b}市。", [(2, 4, "PER"), (8, 10, "LOC")]))
    d = spark.createDataFrame(ner, f"sample_id long, text string, entities array<{span}>")
    got = learn.tag(d.where("sample_id >= 40"), learn.fit_tagger(d.where("sample_id < 40"), rows=40, epochs=3))
    m = {r.label: r.f1 for r in evaluate.prf(evaluate.gold_spans(d.where("sample_id >= 40")), got, "label").collect()}
    assert m["PER"] > 0.9 and m["LOC"] > 0.9


def test_classifier_is_fitted_on_all_rows(spark):
    span = "struct<start:int,end:int,label:string>"
    ids = [r.id for r in spark.range(4100).orderBy(F.xxhash64("id"), "id").collect()]
    rare = set(ids[4000:])  # beyond what a bounded sample in hash order held
    rows = spark.createDataFrame([(i, ("甲谢乙" if i in rare else "甲见乙" if i % 2 else "甲识乙") + "子丑寅卯"[i % 4], (0, 1, "PER"), (2, 3, "PER"), "RARE" if i in rare else "AB"[i % 2]) for i in ids], f"sample_id long, text string, head {span}, tail {span}, label string")
    p = learn.relation_classifier(rows, rows).groupBy("gold", "pred").count().collect()
    assert {(r.gold, r.pred) for r in p} == {("RARE", "RARE"), ("A", "A"), ("B", "B")} and sum(r["count"] for r in p) == 4100


def test_scores_in_batches_equal_the_pipeline(spark):
    rng = random.Random(5)
    span = "struct<start:int,end:int,label:string>"
    word = lambda n: "".join(rng.choice("aé学·𝒳😀Z ") for _ in range(n))
    rows = spark.createDataFrame([(i, word(2) + "见识"[i % 2] + word(rng.randint(1, 40)), (0, 1, "PER"), (2, 3, "PER"), "AB"[i % 2]) for i in range(60)], f"sample_id long, text string, head {span}, tail {span}, label string")
    model = learn.fit_relations(rows)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(["", "a", "é学", None] + [word(rng.randint(1, 80)) for _ in range(40)])], "i int, t string")
    want = learn._predicted(model, t.where("t IS NOT NULL").withColumn("grams", learn._grams())).select("i", "pred", "score").collect()
    got = {r.i: (r.pred, r.score) for r in learn.predict(t, model, "t").collect()}
    assert got[3][0] == "NO_REL" and len(got) == 44
    assert all(got[r.i][0] == r.pred and abs(got[r.i][1] - r.score) < 2e-6 for r in want) and len(want) == 43


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "kb.jsonl").write_text('{"entity_id": "E", "name": "n", "aliases": ["a"], "type": "PER", "description": "d"}\n\n{"entity_id": "F"}\n', encoding="utf-8")
    kb = readers.read_jsonl(spark, str(tmp_path / "kb.jsonl"), readers.KB)
    assert [(r.entity_id, r.name) for r in kb.orderBy("entity_id").collect()] == [("E", "n"), ("F", None)]
    writers.write_jsonl(kb, str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out"), readers.KB).count() == 2
    writers.write_csv(kb, str(tmp_path / "csv"), ["entity_id", "name"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["entity_id", "name"]


def test_a_stream_of_documents_equals_the_batch(spark, tmp_path):
    from kgloom.streaming import micro_batch
    for k, rows in enumerate(([(1, "Alan Smith met ACME. John Doe too."), (2, None)], [(3, "阿兰·图尔，见 John Doe。"), (4, "")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run goes on from the checkpoint and adds nothing
        micro_batch.run_to_table(micro_batch.stream_mentions(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    batch = extract.pattern_mentions(X.sentences(spark.read.parquet(str(tmp_path / "in")), "doc_id"), "doc_id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.select("doc_id", "label", "name").collect())) and batch.count() >= 4
