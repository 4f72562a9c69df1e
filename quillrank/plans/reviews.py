"""Catalog entries for audits of single rows.  Their DuckDB SQL is a second formulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audits as A
from .views import for_duckdb, run_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = for_duckdb(sql)
        return f

    return add


def view(spark, sf_dir, sql):
    return run_sql(spark, sf_dir, sql)


_VARIANT = "select p_partkey, p_name as alias, case p_partkey % 6 when 0 then concat('about ', cast(p_size as string), ' mg ', p_name) when 1 then concat('human ', p_name) when 2 then concat('refractory  ', p_name) when 3 then concat(p_name, ' sodium') when 4 then upper(p_name) else concat(p_name, ' b') end as answer, case when p_partkey % 4 = 0 then 'abbreviation_expansion' else 'synonym' end as relation, case when p_partkey % 5 = 0 then 'it is more specific' when p_partkey % 5 = 1 then 'This does not narrow it' end as basis, case when p_partkey % 7 = 0 then 'deterministic_case' end as route, p_partkey % 11 <> 0 as validated from part"


@entry("filter_variant_reasons", f"""with v as ({_VARIANT}), f as (select *, p_partkey % 6 as k, coalesce(route, '') = '' as judged from v)
select p_partkey, concat_ws(',', case when not validated then 'input_not_validated' end, case when k = 4 then 'duplicates_official_alias' end,
case when judged and k = 0 then 'introduced_numeric_approximation' end, case when judged and k = 3 then 'introduced_salt_form' end,
case when judged and k = 1 and relation = 'synonym' then 'introduced_species_qualifier' end, case when judged and k = 2 and relation = 'synonym' then 'introduced_scope_qualifier' end,
case when judged and p_partkey % 5 = 0 then 'verifier_admits_scope_or_specificity_change' end, case when judged and p_partkey % 5 = 1 and k <> 4 then 'verifier_rationalizes_added_scope' end) as reasons from f""")
def filter_variant_reasons(spark, sf_dir):
    """FLT14: variants of part names with planted qualifiers."""
    reasons = A.variant_reasons(F.col("answer"), F.array("alias"), F.col("relation"), F.col("basis"), F.col("route"), F.col("validated"))
    return view(spark, sf_dir, _VARIANT).select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


_SPANS = "select p_partkey, p_name as chosen, case when p_partkey % 3 = 0 then concat(p_name, ' with water') when p_partkey % 3 = 1 then concat('old ', p_name, ' 7') else p_brand end as rejected, concat('seen: ', p_name, case when p_partkey % 4 = 0 then ' with water' else '' end) as context, p_partkey % 3 as k, cast(case when p_partkey % 3 = 2 then 0 else 2 end as int) as delta from part"


@entry("spans_audit", f"""with s as (select *, len(string_split(chosen, ' ')) as words, p_partkey % 4 = 0 as full_ from ({_SPANS})),
f as (select *, concat_ws(',', case when not (k = 0 and full_) then 'rejected_in_source_context' end, case when k = 2 then 'strict_directional_span_relation' end) as failed,
concat_ws(',', case when k = 0 then 'semantic_modifier_at_boundary' end, case when k in (1, 2) then 'numeric_boundary' end, case when words <= 2 or k = 2 then 'very_short_answer' end, case when k < 2 then 'multi_token_boundary_change' end) as flags from s)
select p_partkey, failed, flags, case when failed <> '' then 'reject_formal' when flags <> '' then 'manual_review_high_risk' else 'manual_review_standard' end as disposition from f""")
def spans_audit(spark, sf_dir):
    """STR20: longer spans with planted modifiers and numbers."""
    audit = A.span_audit(F.col("chosen"), F.col("rejected"), F.col("context"), F.array("chosen"), F.lit("too_long"), F.col("delta"))
    rows = view(spark, sf_dir, _SPANS).select("p_partkey", audit.alias("a"))
    return rows.select("p_partkey", F.array_join("a.failed", ",").alias("failed"), F.array_join("a.flags", ",").alias("flags"), "a.disposition")


@entry("spans_alias_relation")
def spans_alias_relation(spark, sf_dir):
    """STR21: each part name beside its type and its own name's first words."""
    rows = view(spark, sf_dir, "select p_partkey, p_name, array(p_type, concat_ws(' ', slice(split(p_name, ' '), 1, p_partkey % 3 + 1))) as aliases from part")
    return rows.select("p_partkey", A.alias_relation("p_name", "aliases").alias("a")).select("p_partkey", "a.alias", "a.relation", "a.direction")


_DECISION = "select question_id, response_id, item_ord, tie, surface, group_id is not null as supported, hit, tie % 9 = 0 as unsure from matched"


@entry("filter_reliable", f"select question_id, response_id, response_id % 13 <> 0 and bool_and(not unsure and hit = supported and supported and length(surface) >= 8) as reliable from ({_DECISION}) group by question_id, response_id")
def filter_reliable(spark, sf_dir):
    """FLT15: unmatched answers have no evidence, and a surface under eight characters is no quote."""
    quote = F.when(F.col("supported"), F.array(F.struct(F.lit("s").alias("snippet_id"), F.col("surface").alias("quote"))))
    # an accepted repeat contradicts its label here, so that the consistency check has work to do
    decision = F.struct(
        F.col("supported").alias("official_accepted"), F.when(F.col("unsure"), "low").otherwise("high").alias("confidence"), F.array().cast("array<string>").alias("issues"),
        F.when(F.col("hit"), "correct").otherwise("incorrect").alias("correctness"), F.when(F.col("supported"), "supported").otherwise("unsupported").alias("support"),
        F.lit("equivalent").alias("equivalence"), F.lit("valid").alias("relation_valid"), quote.alias("evidence"))
    rows = view(spark, sf_dir, _DECISION).groupBy("question_id", "response_id").agg(F.collect_list(decision).alias("c"), F.concat_ws("; ", F.sort_array(F.collect_list("surface"))).alias("t"))
    ok = A.reliable(F.col("c"), F.create_map(F.lit("s"), F.col("t")), F.lit("r"), F.when(F.col("response_id") % 13 == 0, "ceiling"))
    return rows.select("question_id", "response_id", ok.alias("reliable"))


_LOG = "select o_custkey as question_id, concat_ws(' ', " + ", ".join(f"cast(count(*) + {i} as string)" for i in range(9)) + ", '1.5e1') as line, count(*) as n from orders group by o_custkey"


@entry("metric_score_line", f"select question_id, case when question_id % 4 = 0 then null else cast(9 * n + 36 + 15 as double) end as total from ({_LOG})")
def metric_score_line(spark, sf_dir):
    """MET10: a scorer's log with its line of ten numbers, or without."""
    log = F.when(F.col("question_id") % 4 == 0, "no scores, 3 files").otherwise(F.concat(F.lit("read 12 files\n"), F.col("line"), F.lit(" \ndone in 3 s")))
    rows = view(spark, sf_dir, _LOG).select("question_id", A.score_line(log).alias("s"))
    return rows.select("question_id", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"))


@entry("sft_completion_mask", "with t as (select conv_id, turn, string_split(coalesce(text, ''), ' ') as w from conversations), p as (select *, list_max(list_filter(range(1, len(w) + 1), lambda i: w[i] = w[2])) as last from t) select conv_id, turn, cast(len(w) as bigint) as tokens, cast(len(w) - coalesce(last, 0) as bigint) as trained from p")
def sft_completion_mask(spark, sf_dir):
    """SFT13: what follows the last place of a turn's second word."""
    rows = view(spark, sf_dir, "select conv_id, turn, split(coalesce(text, ''), ' ', -1) as w from conversations")
    mask = A.completion_mask(F.col("w"), F.slice("w", 2, 1))
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("trained"))
