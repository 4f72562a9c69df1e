"""Row audits against planted cases."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions import audits as A

AUDIT = "c string, r string, x string, g array<string>, d string, n int"


@pytest.mark.parametrize("row, failed, flags, disposition", [
    (("the red acute fever", "acute fever", "had the red acute fever.", ["fever"], "too_short", 1), [], ["very_short_answer"], "manual_review_high_risk"),
    (("big red apple", "big red apple tree", "a big red apple tree", ["x"], "too_long", 1), [], [], "manual_review_standard"),
    (("big red apple", "big red apple with 2", "a big red apple with 2", [], "too_long", 2), [], ["semantic_modifier_at_boundary", "numeric_boundary", "multi_token_boundary_change"], "manual_review_high_risk"),
    (("big red apple", "old blue big (red) apple", "nothing", ["old blue big red apple"], "too_long", 0), ["chosen_in_source_context", "rejected_in_source_context", "rejected_does_not_match_any_gold_alias"], ["abbreviation_or_parenthetical_boundary"], "reject_formal"),
    (("a b c", "a b c", "a b c", None, "too_long", None), ["strict_directional_span_relation"], [], "reject_formal")])
def test_span_audit(spark, row, failed, flags, disposition):
    got = spark.createDataFrame([row], AUDIT).select(A.span_audit(*map(F.col, "crxgdn")).alias("a")).first().a
    assert (got.failed, got.flags, got.disposition) == (failed, flags, disposition)


def test_alias_relation(spark):
    rows = [("Ａspirin ", ["x", "aspirin"]), ("low dose aspirin", ["dose", "aspirin"]), ("as", ["aspirin"]), ("red blood", ["blood cell"]), ("q", ["zz"]), ("ab", ["ba"]), ("q", []), ("q", None)]
    got = [tuple(r.a) for r in spark.createDataFrame(rows, "c string, g array<string>").select(A.alias_relation("c", "g").alias("a")).collect()]
    assert got == [
        ("aspirin", "same_weak_surface", "same_length"), ("aspirin", "gold_inside_candidate", "candidate_longer"), ("aspirin", "candidate_inside_gold", "candidate_shorter_same_token_count"),
        ("blood cell", "shared_literal_tokens", "same_length" if len("red blood") == len("blood cell") else "candidate_shorter_same_token_count"),
        ("zz", "zero_literal_token_overlap", "candidate_shorter_same_token_count"), ("ba", "zero_literal_token_overlap", "same_length"), (None,) * 3, (None,) * 3]


@pytest.mark.parametrize("row, reasons", [
    (("about 5 mg", ["5 mg"], "synonym", "", "", True), ["introduced_numeric_approximation"]),
    (("5-7 days", ["5 to 8 days"], "synonym", "", "", True), ["changed_numeric_range"]),
    (("5-7 days", ["5 to 8 months"], "synonym", "", "", True), []),
    (("imatinib mesylate", ["imatinib"], "synonym", "it is a prodrug of x", "", True), ["introduced_salt_form", "prodrug_active_moiety_change"]),
    (("sodium", ["Na"], "synonym", "", "", True), []),
    (("human TP53", ["TP53"], "abbreviation_expansion", "", "", True), []),
    (("refractory human asthma", ["asthma"], "synonym", "not narrower, more specific", "", True), ["introduced_species_qualifier", "introduced_scope_qualifier", "verifier_admits_scope_or_specificity_change", "verifier_rationalizes_added_scope"]),
    ((" ".join(map(str, "abcdefghijklm")), ["z"], "synonym", None, None, True), ["descriptive_expansion_not_concise_surface"]),
    (("Human x", ["human  X"], "", "", "deterministic_case", None), ["input_not_validated", "duplicates_official_alias"]),
    ((None, None, None, None, None, None), ["input_not_validated", "empty_answer"])])
def test_variant_reasons(spark, row, reasons):
    df = spark.createDataFrame([row], "a string, g array<string>, r string, b string, t string, v boolean")
    assert df.select(A.variant_reasons(*map(F.col, "agrbtv")).alias("x")).first().x == reasons


def test_reliable(spark):
    sure = (True, "high", [], "correct", "supported", "equivalent", "valid", [("s", "a long quote")])
    changed = lambda **k: tuple(k.get(n, v) for n, v in zip(("ok", "conf", "issues", "corr", "supp", "eq", "rel", "ev"), sure))
    cases = [([sure], True), ([], True), (None, False), ([sure, changed(conf="low")], False), ([changed(issues=["x"])], False), ([changed(corr="incorrect")], False), ([changed(ok=None)], False),
             ([changed(ev=[])], False), ([changed(ev=[("s", "a long")])], False), ([changed(ev=[("t", "a long quote")])], False), ([changed(ok=False, corr="incorrect", supp="unsupported", ev=[])], False),
             ([changed(ok=False, corr="incorrect", supp="contradicted", ev=None)], True), ([changed(eq=None)], False)]
    kind = "array<struct<official_accepted:boolean,confidence:string,issues:array<string>,correctness:string,support:string,equivalence:string,relation_valid:string,evidence:array<struct<snippet_id:string,quote:string>>>>"
    df = spark.createDataFrame([(i, c, {"s": "here is a long quote."}, "r", None) for i, (c, _) in enumerate(cases)], f"i int, c {kind}, s map<string,string>, r string, x string")
    got = {r.i: r.ok for r in df.select("i", A.reliable(*map(F.col, "csrx")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}
    assert not any(r.ok for r in df.select(A.reliable(F.col("c"), F.col("s"), F.lit(""), F.col("x")).alias("ok")).collect())


def test_score_line(spark):
    ten = "1 .5 2e-1 -4 5. 6 7 8 9 10"
    cases = [(f"log 3\n{ten}\r\nend", [1, 0.5, 0.2, -4, 5, 6, 7, 8, 9, 10]), ("1 2 3 4 5\n6 7 8 9 10", list(range(1, 11))), ("1 2 3", None), ("", None), (None, None), (f"{ten}\n{ten} 11", [1, 0.5, 0.2, -4, 5, 6, 7, 8, 9, 10])]
    df = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(cases)], "i int, o string")
    assert [r.s for r in df.select("i", A.score_line(F.col("o")).alias("s")).orderBy("i").collect()] == [w for _, w in cases]


def test_completion_mask(spark):
    rows = [([1, 2, 3, 2, 3, 4], [2, 3], [0, 0, 0, 0, 0, 1]), ([1, 2], [2, 3], [1, 1]), ([5, 9, 1], [7], [0, 0, 1]), ([], [1], []), ([1, 1], [], [1, 1]), ([4, 4, 4], [4, 4], [0, 0, 0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a array<int>, t array<int>")
    assert [r.m for r in df.select("i", A.completion_mask(F.col("a"), F.col("t"), F.array(F.lit(9))).alias("m")).orderBy("i").collect()] == [w for *_, w in rows]
