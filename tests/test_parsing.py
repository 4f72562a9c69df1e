"""Answer parsers on hand-made rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillrank.functions import parsing as P


def over(spark, f, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(rows, "i long, t string").orderBy("i").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


LISTS = [
    ("[BI]a[EI][BI] b [EI]", ["a", "b"], "ok", []), (None, [], "empty", []), ("[BI]a[EI][BI]b", ["a"], "malformed", ["mismatched_tag_count", "truncated_final_item"]),
    ("a[EI]", [], "malformed", ["end_tag_without_begin_tag", "mismatched_tag_count"]), ("[BI]item_1[EI][BI]x[EI]", ["x"], "ok", ["placeholder_items_dropped"]),
    ("[BI] [EI][BI]x[EI]", ["x"], "ok", ["empty_items"]), ("a; b", ["a", "b"], "fallback_split", ["missing_tags"]), (";", [], "malformed", ["missing_tags", "no_items_found"]),
]


def test_parse_list(spark):
    got = over(spark, P.parse_list, [r[0] for r in LISTS])
    assert [(g["items"], g["status"], g["warnings"]) for g in got] == [(i, s, w) for _, i, s, w in LISTS]


def test_candidates(spark):
    assert over(spark, P.clean_candidate, ["1. 53BP1", "53BP1", "- \"x\"", "\"x\",", "[BE]1:2000[EE]", "Answer: y;", None]) == ["53BP1", "53BP1", "x", "x\"", "1:2000", "y", ""]
    assert over(spark, P.factoid_candidates, ["[BE]a[EE] z [BE]a[EE][BE]b[EE]", "1. one 2. two", "plain", "", None]) == [["a", "b"], ["one", "two"], ["plain"], [], []]


def test_single_answers(spark):
    texts = ["Answer: [BE] x  y [EE]", "[BE]a[EE][BE]b[EE]", "Answer: plain (p)", "Answer: [BE]open", "nothing", "Answer: a\nb", None]
    assert over(spark, P.single_answer, texts) == ["x y", None, None, None, None, None, None]
    got = [tuple(r) for r in over(spark, P.recover_answer, texts)]
    assert got == [("x y", "strict_tagged"), (None, "unrecoverable"), ("plain (p)", "single_answer_line"), ("open", "single_answer_line"), *[(None, "unrecoverable")] * 3]


@pytest.mark.parametrize("a, b, want", [("IL-6", "il-6 ", "exact"), ("the gene.", "Gene", "boundary_variant"), ("a", "b", "mismatch")])
def test_match_type(spark, a, b, want):
    assert spark.range(1).select(P.match_type(F.lit(a), F.lit(b)).alias("x")).first().x == want


def test_support_and_relevance(spark):
    t = spark.createDataFrame([(["alpha beta", "bet", "gamma", ""], ["x alpha beta y", "alpha", "beta gamma"])], "a array<string>, s array<string>")
    assert t.select(P.supported(F.col("a"), F.col("s")).alias("x")).first().x == ["alpha beta", "gamma"]
    assert spark.range(1).select(P.relevance(F.lit("A b c"), F.lit("a z"), F.lit("b")).alias("x")).first().x == 2.5


def test_seeds(spark):
    x = spark.range(1).select(P.draw_seed(F.lit("q"), F.lit(2)).alias("x")).first().x
    assert x == int.from_bytes(hashlib.sha256(b"3407:q:2").digest()[:4], "big")
