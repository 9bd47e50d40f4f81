import os

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.operators import evaluate, extract, orphans, packed, relations

D = "/root/testdata/sf0.001"


def test_packed_values(spark):
    d = spark.createDataFrame([(1, 'A ;"Sam ""S"" B" ;“X；Y“Z”W”；"a, b"', None, " | 「a、b」\t\"c", "a b", "x"), (2, '["x, y", "z"]', "  ", "“q” | r;s", '"" | ""', None)],
                              "row_id int, mentions string, aliases string, section_titles string, merged_entities string, value string")
    prof = spark.createDataFrame([("", f, n, 1.0) for f in packed.FIELDS for n in packed.CANDIDATES], "source string, field string, delimiter string, score double")
    got = [(r.row_id, r.field, r.pos, r.value) for r in packed.split_packed(packed.cells(d), prof).orderBy("row_id", "field", "pos").collect()]
    assert got == [(1, "mentions", 0, "A"), (1, "mentions", 1, 'Sam "S" B'), (1, "mentions", 2, "X；Y“Z”W"), (1, "mentions", 3, "a, b"), (1, "merged_entities", 0, "a b"), (1, "section_titles", 0, "a、b"), (1, "section_titles", 1, '"c'),
                   (2, "mentions", 0, "x, y"), (2, "mentions", 1, "z"), (2, "section_titles", 0, "q"), (2, "section_titles", 1, "r"), (2, "section_titles", 2, "s")]
    assert packed.split_packed(packed.cells(d.limit(0)), prof).count() == 0


def test_delimiters_are_inferred_and_refused(spark):
    """Commas inside values are no delimiter for the hand that writes so, but are one for the hand that lists with them; running text has too many counts."""
    towns = ["Lisbon", "Porto", "Braga", "Faro", "Castelo Branco"]
    rows = [(f"a{i}", "a", f"{towns[i % 5]} | {towns[(i + 1) % 5]}, north of the river | Faro |") for i in range(30)] + [(f"s{i}", h, t) for i, t in enumerate(towns) for h in "ab"]
    rows += [(f"b{i}", "b", ", ".join(towns[j % 5] for j in range(i, i + 2 + i % 2))) for i in range(30)] + [("n", None, None), ("q", "a", '"x | y"'), ("e", "a", " ")]
    d = spark.createDataFrame(rows, "row_id string, hand string, mentions string").selectExpr("*", *[f"CAST(NULL AS STRING) AS {f}" for f in packed.FIELDS[1:]])
    long = packed.cells(d, source=F.col("hand"))
    score = {(r.source, r.delimiter): r.score for r in packed.delimiter_profile(long).collect()}
    assert score["a", "pipe"] >= packed.MIN_SCORE > score["a", "comma"] and score["b", "comma"] >= packed.MIN_SCORE
    got = {}
    for r in packed.split_packed(long).collect():
        got.setdefault(r.row_id, {})[r.pos] = r.value
    assert got["a0"] == {0: "Lisbon", 1: "Porto, north of the river", 2: "Faro"} and got["b0"] == {0: "Lisbon", 1: "Porto"} and got["q"] == {0: "x | y"} and "e" not in got and "n" not in got
    prose = spark.createDataFrame([(i, "That winter he left" + ", seen from the hill" * ((i * 7) % 13) + ".") for i in range(40)], "row_id int, mentions string").selectExpr("*", *[f"CAST(NULL AS STRING) AS {f}" for f in packed.FIELDS[1:]])
    assert all(r.score < packed.MIN_SCORE for r in packed.delimiter_profile(packed.cells(prose)).collect())


def test_orphans(spark):
    p = orphans.parents(spark.sql("SELECT * FROM VALUES ('A', TIMESTAMP_NTZ'2020-01-01', TIMESTAMP_NTZ'2021-01-01'), ('a ', TIMESTAMP_NTZ'2022-01-01', null), (null, null, null) t(id, b, e)"), "p", "id", "b", "e")
    r = spark.sql("SELECT * FROM VALUES (1, ' a', TIMESTAMP_NTZ'2020-06-01'), (2, 'A', TIMESTAMP_NTZ'2021-01-01'), (3, 'A', TIMESTAMP_NTZ'2019-01-01'), (4, 'B', TIMESTAMP_NTZ'2020-01-01'), (5, 'nil', TIMESTAMP_NTZ'2020-01-01'), "
                  "(6, null, TIMESTAMP_NTZ'2020-01-01'), (7, 'A', TIMESTAMP_NTZ'2022-01-01'), (8, 'A', null), (9, 'B', null), (4, 'B', TIMESTAMP_NTZ'2020-01-01') t(n, id, t)")
    got = {(x.row_id, x.reason) for x in orphans.orphan_references(orphans.references(r, "x", "id", "n", "t", "p"), p).collect()}
    assert got == {("2", "deleted"), ("3", "late"), ("4", "missing"), ("9", "missing")}


def test_sentences_and_terms(spark):
    d = spark.createDataFrame([(1, "一。 b!c"), (2, ""), (3, None), (4, "no end")], "doc_id int, text string")
    assert [(r.doc_id, r.s_start, r.s_end, r.sent) for r in X.sentences(d, "doc_id").orderBy("doc_id", "sent_idx").collect()] == [(1, 0, 2, "一。"), (1, 2, 5, "b!"), (1, 5, 6, "c"), (4, 0, 6, "no end")]
    t = spark.createDataFrame([("数学家教授图灵上",), ("，王明。",), (None,)], "x string").select(X.normal_term(F.col("x")).alias("y")).collect()
    assert [r.y for r in t] == ["图灵", "王明", None]


def test_merge_spans_never_overlap(spark):
    rows = [(1, 0, 4, "PER", "abcd", "d", 1), (1, 2, 6, "PER", "cdef", "d", 3), (1, 6, 8, "LOC", "gh", "d", 0), (1, 6, 8, "LOC", "gh", "r", 0), (2, 0, 3, "ORG", "xyz", "d", 0)]
    got = extract.merge_spans(spark.createDataFrame(rows, "k int, start int, end int, label string, text string, source string, prio int"), "k")
    assert {(r.k, r.start, r.end) for r in got.collect()} == {(1, 2, 6), (1, 6, 8), (2, 0, 3)}


def test_bio_round_trip_and_prune(spark):
    d = spark.createDataFrame([(1, "abcdef", [(0, 2, "A"), (2, 4, "A"), (9, 12, "B")])], "sample_id int, text string, entities array<struct<start:int,end:int,label:string>>")
    tags = d.select("sample_id", F.posexplode(X.bio_tags(F.col("text"), F.col("entities"))).alias("i", "tag"))
    assert {(r.start, r.end, r.label) for r in evaluate.decode_bio(tags).collect()} == {(0, 2, "A"), (2, 4, "A")}
    e = relations.edges(spark.createDataFrame([(1, "h", None, "R", "ab", None, 0.5, "s", "x"), (2, "h", "", "R", "abc", "NIL", 0.4, "s", "x")], "triple_id long, head string, head_id string, relation string, tail string, tail_id string, confidence double, source string, sentence string"))
    assert [r.triple_id for r in relations.prune_subsumed(e).collect()] == [2]


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", ["sentence_split", "section_detect", "kb_lexicon", "pair_rule_match", "trigger_window_best", "edge_subsumption_prune", "ner_prf", "p5_found"])
def test_equals_sql(spark, name):
    import __spark_entry__ as E
    from tests.compare import compare
    assert compare(spark, D, name, E.queries()[name], E.oracle_sql()[name]) is None
