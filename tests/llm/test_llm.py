import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import canonical, lookalike, mixing, mojibake, overlap, tokenizer, variants


def test_look_alikes():
    c = lookalike.consistent
    assert c("Sοfifalpizοr") == "Sofifalpizor" and c("Ｒｏｂ​ert X") == "Robert X" and c("é") == "é" and c(None) is None and c("​") == ""
    assert c("Москва") == "Москва" and c("A") != c("a") and c("é") != c("e")


def test_detection():
    e = lookalike.examined
    assert e("Sοfi")[1] == "mixed" and e("Рор") == ("Pop", "whole") and e("Ꭺp") == ("Ap", "mixed") and e("Ｒob")[1] == "form" and e("Rob") == ("Rob", "same") and e(None) == (None, None)


def test_forms_in_the_jvm_equal_python(spark):
    rng = random.Random(5)
    letters = "aB é\u3000 \u200b·•’“，！Ａ中文。《》\t-–\u200d\ufeffñ?оΑս…\u0301Ꭺ"
    d = spark.createDataFrame([("".join(rng.choice(letters[:-7] if i % 2 else letters) for _ in range(rng.randint(0, 12))),) for i in range(600)], "raw string").distinct()
    assert all((r.form, r.look) == lookalike.examined(r.raw) for r in lookalike.formed(d).collect())


def test_look_pairs(spark, monkeypatch):
    names = [("E1", "Rob X", 1), ("E2", "Rοb X", 1), ("E2", "Rοb X", 1), ("E3", "Rob X", 1), ("E4", None, 1), ("E5", "", 1), (None, "Rοb X", 1), ("E6", "Ｒob X", 1), ("E7", "rob X", 1)]
    kb = spark.createDataFrame(names, "entity_id string, name string, form int")
    inp = spark.createDataFrame([(1, "Rob  X", 0), (1, "Rob  X", 0), (2, "Rob X", 0), (3, None, 0)], "cand_id long, entity string, w int")
    tri = spark.createDataFrame([(10, "一⼀", 0), (9, "一一", 0), (8, "一一", 0), (7, None, 0)], "triple_id long, sentence string, f int")
    want = {(a, b) for a, x, _ in names for b, y, _ in names if a and b and x and y and a < b and x != y and lookalike.consistent(x) == lookalike.consistent(y)}
    for chunk in (20000, 1):
        monkeypatch.setattr(lookalike, "CHUNK", chunk)
        got = {(r.field, r.left_id, r.right_id) for r in lookalike.found(kb, inp, tri).collect()}
        assert {(a, b) for f, a, b in got if f == "kb.name"} == want and {(a, b) for f, a, b in got if f == "sentence"} == {("9", "10"), ("8", "10")}
        assert {(a, b) for f, a, b in got if f == "input.entity"} == {("1", e) for e in ("E1", "E2", "E3", "E6")} | {("2", e) for e in ("E2", "E6")}
    assert lookalike.found(kb.limit(0), inp.limit(0), tri.limit(0)).count() == 0
    assert {(r.field, r.id, r.look) for r in lookalike.forms(kb, inp, tri).collect()} == {("kb.name", "E2", "mixed"), ("kb.name", "E6", "form"), ("input.entity", "1", "form"), ("sentence", "10", "form")}


def test_tokenizer_equals_plain_merging():
    ranks = tokenizer.read_ranks()
    e = tokenizer.TrieEncoder(ranks)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n'sthe12é中国人龍契士のПри😀") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "  ", "a" * 3000]
    ids, ends = e.encode_batch(texts)
    at = 0
    for t, end in zip(texts, ends):
        want = [i for w in e.cut.findall(t or "") for i in e.merge(w.encode())]
        assert ids[at:end].tolist() == want
        at = end


def test_repair():
    s = "1907年10月，凯瑟琳·泰勒穆奈努在学生的坚持下放弃了铁路信号的图纸。"
    for bad in (s.encode().decode("mac_roman"), s.encode("gb18030").decode("latin-1"), "".join(mojibake._TABLES["cp1252"][b] for b in s.encode())):
        assert mojibake.repair(bad) == (s, True, True)
    assert mojibake.repair("It‚Äôs said")[0] == "It’s said"
    for sound in (None, "", "Âmbar nº 7 — 5 £", "größer, müßige Gespräche", "FUNDAÇÃO SÃO BRÁULIO", "родился в месте", "Wіllіаm", s, "🧮"):
        assert mojibake.repair(sound) == (sound, False, True)
    assert mojibake.repair("a � b")[1:] == (True, False)


def test_overlaps(spark):
    t = "威廉在学生的坚持下放弃了铁路信号的图纸，于是公开了航海钟的校准表。"
    tr = spark.createDataFrame([("ner", 1, t, 0), ("ner", 2, t, 0), ("ner", 3, "完全不同的一段文字，说的是别的事情和别的人。", 0), ("ner", 4, None, 0), ("ner", 5, "", 0)], "task string, sample_id long, text string, cls int")
    ev = spark.createDataFrame([("ner", 9, "【待核】" + t.replace("于", "於").replace("图", "圖"), 0), ("re", 8, t, 0), ("ner", 7, "", 0)], "task string, sample_id long, text string, h int")
    assert {(r.train_id, r.eval_id) for r in overlap.overlaps(tr, ev).collect()} == {(1, 9), (2, 9)}
    assert overlap.overlaps(tr.limit(0), ev).count() == 0


def plain_overlaps(train, evals, same=overlap.SAME):
    """All pairs, compared one by one with exact counts."""
    def grams(x):
        w = overlap.words(x).split()
        return {tuple(w[i:i + overlap.WORDS]) for i in range(max(len(w) - overlap.WORDS + 1, 1))} if w else set()
    df = collections.Counter(g for x in {overlap.words(x) for x in evals if x} for g in grams(x))

    def weights(gs):
        q = max(sorted(df[g] for g in gs)[int((len(gs) - 1) * overlap.QUANTILE)], 1)
        w = {g: 1 / (1 + max(df[g], 1) / (overlap.SPREAD * q)) for g in gs}
        return {g: x / sum(w.values()) for g, x in w.items()}
    ws = [[weights(g) if (g := grams(x)) else {} for x in xs] for xs in (train, evals)]
    return {(i, j) for i, a in enumerate(ws[0]) for j, b in enumerate(ws[1]) if a and b and min(sum(a[g] for g in a.keys() & b.keys()), sum(b[g] for g in a.keys() & b.keys())) >= same}


def test_overlaps_lose_nothing(spark):
    """Typing errors break five grams each, stock phrases and near copies abound; what a plain loop accepts must come out, with salting and without."""
    rng = random.Random(3)
    stock = ["这项工作在寒冷的冬季换来一间更大的工作室", "the report was moved to a harbour store that winter", "全部算稿凭借匿名捐款引出了更难的问题"]
    letters = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 60))) + rng.choice(stock) for _ in range(40)]
    typo = lambda x, p: "".join(rng.choice(letters) if rng.random() < p else c for c in x)
    train = [typo(x, p) for x in base for p in (0, 0.03, 0.08)] + ["", None, "。", base[0]]
    evals = [typo(x, p) for x in base for p in (0, 0.05, 0.15)] + [typo(base[1], 0.02) for _ in range(40)] + [base[0].replace("这", "這"), None, " "]
    want = plain_overlaps(train, evals)
    frame = lambda xs: spark.createDataFrame([("ner", i, x, 1) for i, x in enumerate(xs)], "task string, sample_id long, text string, cls int")
    for together in (overlap.TOGETHER, 3):
        got = {(r.train_id, r.eval_id) for r in overlap.overlaps(frame(train), frame(evals), together=together).collect()}
        assert len(want) > 200 and want <= got and len(got - want) <= 0.01 * len(want)  # a count is rounded to an eighth of a power of two
    assert overlap.overlaps(frame(train).limit(0), frame(evals).limit(0)).count() == 0


def test_name_parser():
    p = variants.Parser({"robert": "robert", "罗伯特": "robert", "dorothy": "dorothy", "gabrielle": "gabrielle"})
    assert p.person("Viwanzapetel R.") == ("latin", "viwanzapetel", "r.", "")
    assert p.person("苏汉丁耶辛，罗伯特") == ("han", "苏汉丁耶辛", "robert", "") and p.person("罗伯特威蒂耶卢乔") == ("han", "威蒂耶卢乔", "robert", "")
    assert p.person('Dorothy "Dot" Rossörbonime')[:3] == ("latin", "rossorbonime", "dorothy") and p.person("Gaby Kidadoborva")[2] == "gabrielle" and p.person("") is None
    assert p.organisation("computing lab of polnayanjelve") == ("latin", "polnayanjelve", "lab", "") and p.organisation("天文台（阿杰查梅扬）") == ("han", "阿杰查梅扬", "obs", "")
    assert variants.near("abcd", "abdc") and variants.near("abc", "ab") and not variants.near("abcd", "badc")


def test_lexicon_goes_by_evidence_of_each_token(spark):
    """A given name of five in 6000 names is one (a share of all names would refuse it); a surname, a rare token and a typing error of a frequent name are none."""
    rng = random.Random(4)
    word = lambda n=4: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n)).title()
    rows = [f"{g} {word()}" for g in ("Robert", "Harold") for _ in range(3000)] + [f"Oswyna {word()}" for _ in range(5)] + [f"Robret {word()}" for _ in range(4)] + [f"Lonely {word()}"]
    rows += [f"{g} Rossbon" for g in ("Robert", "Harold", "Oswyna")] + [f"Rossbon {g}" for g in ("Robert", "Harold")]
    kb = spark.createDataFrame([(f"E{i}", "PER", r, None) for i, r in enumerate(rows)] + [("E", "PER", None, ["Harold"])], "entity_id string, type string, name string, aliases array<string>")
    got = variants.lexicon(kb)
    assert {"robert", "harold", "oswyna"} <= set(got) and not {"robret", "lonely", "rossbon"} & set(got)


def test_attribution_weighs_edits_against_chance(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))
    names = {word(5) for _ in range(400)} | {"sanderbilo", "ken"}
    rows = [("PER", "latin", x, 30, True) for x in names] + [("PER", "latin", "sandrebilo", 2, True), ("PER", "latin", "sanderbilop", 1, False), ("PER", "latin", "kon", 2, True), ("PER", "latin", "kem", 1, True)]
    cores = spark.createDataFrame(rows, "type string, script string, core string, n long, held boolean")
    spelt = spark.createDataFrame([(f"E{i}", "PER", "latin", x) for i, x in enumerate(sorted(names))] + [("E1", "PER", "latin", sorted(names)[1] + "x")], "entity_id string, type string, script string, core string")
    got = {r.core: r.canon for r in variants.attributed(cores, variants.channel(spelt, cores)).collect()}
    assert got["sandrebilo"] == got["sanderbilop"] == "sanderbilo" and got["kon"] == "kon" and got["kem"] == "kem" and len(got) == len(rows)


def test_connected(spark):
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(9)] + [("x", "y"), ("x", "y")], "a string, b string")
    got = {r.node: r.label for r in variants.connected(e).collect()}
    assert {got[f"n{i:02}"] for i in range(10)} == {"n00"} and got["y"] == "x"


def test_canonical(spark):
    refs = spark.createDataFrame([(i, f"{n}镇", f"{m} Town", "LOC", 0) for i, (n, m) in enumerate([("皮阿戈波格", "Rubahendehi"), ("利廷比恩普", "Monvedagasa"), ("卡基劳阿班", "Zipokogisan"), ("乔恩本胡卢", "Segabukena"), ("伊佩霍汉卢", "Zuroskijelna")], 1)], "ref_id int, name string, name_en string, category string, v int")
    m = spark.createDataFrame([(1, "x", "旧皮阿戈波格镇", "manual_entry"), (2, "Town of Rubahendhei", " ", "manual_entry"), (3, "x", "unknown", "manual_entry"), (4, "Rubahendehi Town", None, "other"), (5, None, None, "manual_entry"), (5, None, None, "manual_entry")],
                              "mention_id long, mention string, kb_name string, disambiguation_method string")
    kb = spark.createDataFrame([("E", None, ["“利廷比恩普镇”", None]), ("F", "n", ["皮阿戈波格镇"])], "entity_id string, name string, aliases array<string>")
    got = {(r.field, r.row_id, r.pos): r.ref_id for r in canonical.map_values(m, kb, refs).collect()}
    assert got == {("kb_name", "1", 0): 1, ("mention", "2", 0): 1, ("kb_name", "3", 0): 0, ("mention", "5", 0): 0, ("aliases", "E", 0): 2, ("aliases", "E", 1): 0}


def test_kind_words_go_by_share_of_the_list(spark):
    """In a long list a word may stand in many entries without being a kind."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)).title()
    rows = [(i, None, f"{'North ' if i % 100 == 0 else ''}{word()} {('Town', 'Castle')[i % 2]}") for i in range(1200)]
    refs = spark.createDataFrame(rows, "ref_id int, name string, name_en string")
    m = spark.createDataFrame([(1, "x", rows[7][2].lower(), "manual_entry")], "mention_id long, mention string, kb_name string, disambiguation_method string")
    kb = spark.createDataFrame([], "entity_id string, name string, aliases array<string>")
    assert [r.ref_id for r in canonical.map_values(m, kb, refs).collect()] == [7]
    assert {r.w for r in spark.sql("SELECT w FROM kind_words").collect()} == {"town", "castle"}


def test_mixing_draws_and_permutation():
    rows = [{"source": s, "take": k, "n_blocks": 7} for s, k in (("a", 5000), ("b", 300), ("c", 1))]
    d = mixing.shard_draws(rows)
    assert {s: sum(g for _, t, g in d if t == s) for s in "abc"} == {"a": 5000, "b": 300, "c": 1} and len({sum(g for k, _, g in d if k == n) for n in range(64)}) <= 2
    for n in (1, 2, 3, 17, 1000, 4097):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n)) and (n < 100 or (p != mixing.permuted(np.arange(n), n, 6)).mean() > 0.9)
    step = np.diff(mixing.permuted(np.arange(4097), 4097, 5))
    assert len(set(step.tolist())) > 2000  # no fixed stride


def test_slots(spark):
    rows = [{"source": "a", "take": 25, "n_blocks": 10}, {"source": "b", "take": 4, "n_blocks": 4}]
    got = collections.Counter((r.source, r.block) for r in mixing.slots(spark, rows, shards=3, piece=2).collect())
    assert sum(n for (s, _), n in got.items() if s == "a") == 25 and all(2 <= got["a", b] <= 3 for b in range(10)) and all(got["b", b] == 1 for b in range(4))


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "words of a document " * (3 + i % 7), "a" if i % 3 else "b" if i % 2 else None) for i in range(200)] + [(900, None, "a"), (901, "", "b")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(docs, t, block=16).collect()
    cap = {"a": 1, "b": 3}
    assert rows and all(r.repeats <= cap[r.source] for r in rows)
    used = {s: sum(r.tokens_used for r in rows if r.source == s) for s in cap}
    sh = {r.source: r for r in mixing.shares(docs, t, block=16).collect()}
    assert {s: sh[s].tokens_drawn for s in cap} == used and abs(sh["a"].actual_share - 0.5) < 0.02
    assert mixing.mix(docs.limit(0), t).count() == 0


def test_lost_bytes_are_not_restored():
    """UTF-8 read in a one-byte encoding, then one character of it lost, wherever that is: the original cannot be had."""
    zh = "1907年10月，凯瑟琳·泰勒穆奈努在学生的坚持下放弃了铁路信号的图纸。"
    ru = "Осенью 1900 года Norojanhensa поступил в университет и переписал таблицу приливов."
    fr = "Après 1975, l’institut créa une chaire ; Sanbilorvehi préféra la théorie et déjà rédigé à Genève."
    for text, encodings in ((zh, ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8-r")), (ru, ("cp1251", "latin-1", "cp1252")), (fr, ("latin-1", "cp1252", "cp1251"))):
        for e in encodings:
            bad = "".join(mojibake._TABLES[e][b] for b in text.encode())
            assert mojibake.repair(bad) == (text, True, True), (e, text)
            for i in [i for i, c in enumerate(bad) if c >= "\x80"]:
                got, garbled, restored = mojibake.repair(bad[:i] + bad[i + 1:])
                assert garbled and not restored, (e, i, got)
