"""The query catalog: one entry for each operator of the blueprint's section 2 that is covered, named family_operator.

QUERIES holds functions of (spark, sf_dir), built from the operators; ORACLE holds DuckDB SQL, a second formulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..operators import kernels as K
from ..operators import ranking as R
from ..streaming.events import arm_counts
from . import answers, inputs, orchestration, relational, reviews
from .views import for_duckdb, run_sql

S = T.SPACE.replace("'", "''")
N0 = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{S}', ' ', 'g'))"
N3 = lambda c: rf"trim(regexp_replace(lower(regexp_replace({N0(c)}, '\[/?[A-Z]{{2,3}}\]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark, sf_dir, name):
    return run_sql(spark, sf_dir, f"select * from {name}")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def entry(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = for_duckdb(sql)
        return f

    return add


@entry("pairs_whole_response", "select * from (select question_id, chosen_id, rejected_id, chosen_rank, rejected_rank, round(chosen_f1, 9) as chosen_f1, round(rejected_f1, 9) as rejected_f1, gain, row_number() over (partition by question_id order by gain desc, chosen_rank, rejected_rank) as pair_rank from pairs) where pair_rank <= 5")
def pairs_whole_response(spark, sf_dir):
    """PAR01, JON01, JON07, WIN01, WIN04, WIN14."""
    pairs = R.whole_response_pairs(R.set_metrics(view(spark, sf_dir, "resp_items"), view(spark, sf_dir, "gold_groups")))
    return pairs.select("question_id", F.col("chosen_response_id").alias("chosen_id"), F.col("rejected_response_id").alias("rejected_id"), "chosen_rank", "rejected_rank", F.round("chosen_f1", 9).alias("chosen_f1"), F.round("rejected_f1", 9).alias("rejected_f1"), "gain", "pair_rank")


@entry("match_greedy_set_f1", "select question_id, response_id, cast(tp as bigint) as tp, n_pred, n_gold, round(p, 9) as p, round(r, 9) as r, round(f1, 9) as f1, round(1 - p, 9) as invalid_addition, round(1 - r, 9) as valid_omission from metrics")
def match_greedy_set_f1(spark, sf_dir):
    """JON19, MET01, AGG03."""
    m = R.set_metrics(view(spark, sf_dir, "resp_items"), view(spark, sf_dir, "gold_groups"))
    return m.select("question_id", "response_id", "tp", "n_pred", "n_gold", *[F.round(c, 9).alias(c) for c in ("p", "r", "f1")], F.round(1 - F.col("p"), 9).alias("invalid_addition"), F.round(1 - F.col("r"), 9).alias("valid_omission"))


def _rr(spark, sf_dir, selector):
    ranked = R.ordered(R.pool(view(spark, sf_dir, "bank_rank")), *R.SELECTORS[selector]())
    gold = view(spark, sf_dir, "gold_answer")
    return R.reciprocal_ranks(ranked.join(gold, "question_id"), gold.select("question_id"), F.col("answer") == F.col("gold"))


_SUMMARY = "select count(*) as questions, round(avg(case when first_rank <= 5 then cast(1 as double) / first_rank else 0 end), 6) as mrr, round(avg(case when first_rank <= 1 then cast(1 as double) else 0 end), 6) as coverage_1, round(avg(case when first_rank <= 5 then cast(1 as double) else 0 end), 6) as coverage_5, round(avg(case when first_rank <= 10 then cast(1 as double) else 0 end), 6) as coverage_10, round(avg(case when first_rank is not null then cast(1 as double) else 0 end), 6) as pool_coverage from "
for _name, _order in (("model_vote", "votes desc, best_rank"), ("rank_vote", "round(rank_vote, 9) desc, best_rank"), ("sample_frequency", "round(frequency, 9) desc, best_rank")):
    _sql = f"with o as (select *, row_number() over (partition by question_id order by {_order}, sha<<answer>>, answer) as k from pooled), w as (select q.question_id, min(case when o.answer = q.gold then k end) as first_rank from gold_answer q left join o on o.question_id = q.question_id group by q.question_id) {_SUMMARY} w"
    entry(f"fuse_{_name}_mrr", _sql)(lambda spark, sf_dir, s=_name: R.ranking_summary(_rr(spark, sf_dir, s)))  # ENS03, ENS04, MET03, MET04, MET05, WIN06

_RR = "with t as (select question_id, answer, min(src_rank) as best_rank from per_model group by question_id, answer), u as (select t.question_id, t.answer, best_rank, min(model) as m from t join per_model s on s.question_id = t.question_id and s.answer = t.answer and s.src_rank = best_rank group by t.question_id, t.answer, best_rank)"


@entry("fuse_round_robin", f"{_RR} select question_id, answer, rk as position from (select *, row_number() over (partition by question_id order by best_rank, m, sha<<answer>>, answer) as rk from u) where rk <= 5")
def fuse_round_robin(spark, sf_dir):
    """WIN09, ENS04, SRT06: each source's next answer in turn, answers once."""
    ranked = R.ordered(R.pool(view(spark, sf_dir, "bank_rank")), *R.SELECTORS["round_robin"]())
    return ranked.where("rank <= 5").select("question_id", "answer", F.col("rank").alias("position"))


@entry("audit_pair_first_reason", "select coalesce(reason, 'kept') as reason, count(*) as pairs from (select case when not gain >= 0.2 then 'delta_f1' when not chosen_r >= rejected_r then 'delta_recall' when not abs(chosen_n - rejected_n) <= 4 then 'entity_gap' when not chosen_n <= 2 * rejected_n then 'entity_ratio' end as reason from pairs) group by 1")
def audit_pair_first_reason(spark, sf_dir):
    """FLT01: one pass yields the kept rows and the audit."""
    pairs = view(spark, sf_dir, "pairs")
    reason = R.first_reason((F.col("gain") >= 0.2, "delta_f1"), (F.col("chosen_r") >= F.col("rejected_r"), "delta_recall"), (F.abs(F.col("chosen_n") - F.col("rejected_n")) <= 4, "entity_gap"), (F.col("chosen_n") <= 2 * F.col("rejected_n"), "entity_ratio"))
    return pairs.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("pairs"))


@entry("text_clean", f"select doc_id, length({N0('text')}) as n0_chars, sha256({N0('text')}) as n0_sha256, sha256(lower({N0('text')})) as n2_sha256, sha256({N3('text')}) as n3_sha256 from documents")
def text_clean(spark, sf_dir):
    """STR01, STR02, SRC26: keys N0, N2 and N3 of whole texts."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.clean_text(c)).cast("long").alias("n0_chars"), F.sha2(T.clean_text(c), 256).alias("n0_sha256"), F.sha2(T.official_key(c), 256).alias("n2_sha256"), F.sha2(T.loose_key(c), 256).alias("n3_sha256"))


@entry("text_compact_key", r"select conv_id, turn, regexp_replace(lower(replace(replace(replace(regexp_replace(coalesce(text, ''), '\[/?[A-Z]{2,3}\]', '', 'g'), '™', 'tm'), '®', 'r'), 'µ', 'u')), '[^a-z0-9]', '', 'g') as key from conversations")
def text_compact_key(spark, sf_dir):
    """N6 of STR28."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.compact_key(F.col("text")).alias("key"))


@entry("text_typography_key", rf"select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower({N0('p_name')}), '[‐‑‒–—−]', '-', 'g'), '([a-z])-([a-z])', '\1 \2', 'g'), '\.$', '') as key from part")
def text_typography_key(spark, sf_dir):
    """STR31."""
    return table(spark, sf_dir, "part").select("p_partkey", T.typography_key(F.col("p_name")).alias("key"))


@entry("text_truncate", r"select doc_id, case when length(text) > 200 then regexp_replace(substring(text, 1, 182), '[\s]+$', '') || ' ... [TRUNCATED]' else text end as preview from documents")
def text_truncate(spark, sf_dir):
    """PRJ07, PRJ22."""
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("preview"))


@entry("text_style", f"select conv_id, turn, case when regexp_matches(text, '\\[BI\\]') then 'list' when regexp_matches(text, '\\[BE\\]') then 'factoid' when starts_with(lower({N0('text')}), 'yes') or starts_with(lower({N0('text')}), 'no') then 'yesno' else 'other' end as style, case when starts_with(lower({N0('text')}), 'yes') then 'yes' when starts_with(lower({N0('text')}), 'no') then 'no' end as yes_no from conversations")
def text_style(spark, sf_dir):
    """STR12, MET11."""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_style(c).alias("style"), T.yes_no(c).alias("yes_no"))


@entry("text_serialize_parse", "select question_id, response_id, count(*) as n_items, count(distinct surface) as n_distinct, string_agg(surface, '|' order by item_ord, tie) as items from resp_items group by question_id, response_id")
def text_serialize_parse(spark, sf_dir):
    """PRJ16, STR04, ARR01: items written with tags and read back."""
    items = view(spark, sf_dir, "resp_items").groupBy("question_id", "response_id").agg(F.sort_array(F.collect_list(F.struct("item_ord", "tie", "surface"))).alias("s"))
    parsed = items.select("question_id", "response_id", T.tagged_items(T.serialize_items(F.col("s.surface"))).alias("i"))
    return parsed.select("question_id", "response_id", F.size("i").cast("long").alias("n_items"), F.size(T.ordered_distinct(F.col("i"))).cast("long").alias("n_distinct"), F.array_join("i", "|").alias("items"))


@entry("agg_count_buckets", "select case when n = 0 then '0' when n <= 5 then '1-5' when n <= 10 then '6-10' when n <= 20 then '11-20' when n <= 50 then '21-50' when n <= 100 then '51-100' else '>100' end as bucket, count(*) as questions from (select question_id, count(*) as n from resp_items group by question_id) group by 1")
def agg_count_buckets(spark, sf_dir):
    """AGG13."""
    n = view(spark, sf_dir, "resp_items").groupBy("question_id").agg(F.count("*").alias("n"))
    return n.groupBy(T.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("questions"))


@entry("stats_wilson", "with s as (select arm, count(*) as n, sum(case when score > 50 then 1 else 0 end) as k from event_arm group by arm), c as (select arm, n, cast(k as double) / n as p, 1.959963984540054e0 as z from s) select arm, n, round((p + z * z / (2e0 * n) - z * sqrt(p * (1 - p) / n + z * z / (4e0 * n * n))) / (1 + z * z / n), 6) as low, round((p + z * z / (2e0 * n) + z * sqrt(p * (1 - p) / n + z * z / (4e0 * n * n))) / (1 + z * z / n), 6) as high from c")
def stats_wilson(spark, sf_dir):
    """ENS16, AGG32."""
    s = view(spark, sf_dir, "event_arm").groupBy("arm").agg(F.count("*").alias("n"), F.sum((F.col("score") > 50).cast("double")).alias("k"))
    low, high = R.wilson(F.col("k"), F.col("n"))
    return s.select("arm", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@entry("split_stratified_exact", "with q as (select c_custkey as id, c_mktsegment as stratum from customer), n as (select stratum, count(*) as n, floor(count(*) * 0.15e0) as f from q group by stratum), u as (select *, floor(sum(n) over () * 0.15e0 + 0.5e0) - sum(f) over () as extra, row_number() over (order by round(n * 0.15e0 - f, 9) desc, stratum) as turn from n), p as (select q.*, row_number() over (partition by stratum order by sha<<concat_ws(':', '17', cast(id as string))>>, id) as place from q) select id, p.stratum, place <= f + case when turn <= extra then 1 else 0 end as held from p join u on u.stratum = p.stratum")
def split_stratified_exact(spark, sf_dir):
    """SPL01, SPL05, SPL09, SRT05."""
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    return R.largest_remainder(q, "id", "stratum", 0.15, "17").select("id", "stratum", "held")


@entry("stream_arm_counts", "select date_trunc('hour', ts) as start, event_type as arm, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_arm_counts(spark, sf_dir):
    """Extension: the batch form of the streaming counts."""
    return arm_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


_KEYS = "with k as (select question_id, response_id, string_agg(item_key, '|' order by item_key) as items from resp_sets group by question_id, response_id), kp as (select p.*, a.items as chosen_key, b.items as rejected_key from pairs p join k a on a.question_id = p.question_id and a.response_id = p.chosen_id join k b on b.question_id = p.question_id and b.response_id = p.rejected_id)"


def _set_keys(spark, sf_dir):
    return view(spark, sf_dir, "resp_sets").groupBy("question_id", "response_id").agg(F.array_join(F.sort_array(F.collect_set("item_key")), "|").alias("items"))


def _keyed_pairs(spark, sf_dir):
    keys = _set_keys(spark, sf_dir)
    out = view(spark, sf_dir, "pairs")
    for side in ("chosen", "rejected"):
        out = out.join(keys.select("question_id", F.col("response_id").alias(f"{side}_id"), F.col("items").alias(f"{side}_key")), ["question_id", f"{side}_id"])
    return out


@entry("agg_duplicate_pairs", f"{_KEYS} select cast(coalesce(sum(n - 1), 0) as bigint) as duplicates, count(*) as distinct_pairs from (select count(*) as n from kp group by question_id, chosen_key, rejected_key)")
def agg_duplicate_pairs(spark, sf_dir):
    """AGG06, SET07."""
    n = _keyed_pairs(spark, sf_dir).groupBy("question_id", "chosen_key", "rejected_key").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("distinct_pairs"))


@entry("agg_contradictions", f"{_KEYS} select count(*) as contradictions from kp a where exists (select 1 from kp b where b.question_id = a.question_id and b.chosen_key = a.rejected_key and b.rejected_key = a.chosen_key and (b.chosen_rank < a.chosen_rank or (b.chosen_rank = a.chosen_rank and b.rejected_rank < a.rejected_rank)))")
def agg_contradictions(spark, sf_dir):
    """AGG07: the reversed key stands earlier."""
    a = _keyed_pairs(spark, sf_dir)
    b = a.select("question_id", F.col("chosen_key").alias("rejected_key"), F.col("rejected_key").alias("chosen_key"), F.struct("chosen_rank", "rejected_rank").alias("earlier"))
    first = b.groupBy("question_id", "chosen_key", "rejected_key").agg(F.min("earlier").alias("earlier"))
    return a.join(first, ["question_id", "chosen_key", "rejected_key"]).where(F.col("earlier") < F.struct("chosen_rank", "rejected_rank")).agg(F.count("*").alias("contradictions"))


@entry("window_dedupe_best", f"{_KEYS} select question_id, response_id from (select r.question_id, r.response_id, row_number() over (partition by r.question_id, items order by rk) as rn from ranked r join k on k.question_id = r.question_id and k.response_id = r.response_id) where rn = 1")
def window_dedupe_best(spark, sf_dir):
    """WIN03, SET16: the best-ranked response of each exact set."""
    ranked = view(spark, sf_dir, "ranked").join(_set_keys(spark, sf_dir), ["question_id", "response_id"])
    return ranked.groupBy("question_id", "items").agg(F.min_by("response_id", "rk").alias("response_id")).select("question_id", "response_id")


@entry("split_hash_fold", "select c_custkey, cast('0x' || substring(sha256(cast(c_custkey as string)), 1, 8) as bigint) % 5 as fold, cast('0x' || substring(sha256(concat_ws(':', '3407', cast(c_custkey as string), '0')), 1, 8) as bigint) as seed from customer")
def split_hash_fold(spark, sf_dir):
    """SPL10, SPL14."""
    return table(spark, sf_dir, "customer").select("c_custkey", P.hash_fold(F.col("c_custkey")).alias("fold"), P.draw_seed(F.col("c_custkey"), F.lit(0)).alias("seed"))


@entry("sort_global_cap", "select question_id, chosen_id, rejected_id from (select *, row_number() over (order by gain desc, chosen_id, rejected_id) as rn, count(*) over () as n from pairs) where rn <= greatest(1, round(0.1e0 * n))")
def sort_global_cap(spark, sf_dir):
    """SRT01, SRT02, SRT04: the largest tenth of all gains, by 4096 steps of the gain."""
    pairs = view(spark, sf_dir, "pairs").select("question_id", "chosen_id", "rejected_id", "gain")
    ranked = R.global_rank(pairs, -F.floor(F.col("gain") * 4096), F.col("gain").desc(), "chosen_id", "rejected_id")
    most = pairs.agg(F.greatest(F.lit(1.0), F.round(F.count("*") * 0.1)).alias("most"))  # one row
    return ranked.join(most, F.col("rn") <= F.col("most")).select("question_id", "chosen_id", "rejected_id")


@entry("split_balance_classes", "select arm, ord from (select *, min(n) over () as target from (select arm, ord, count(*) over (partition by arm) as n, row_number() over (partition by arm order by sha<<cast(ord as string)>>) as rn from event_arm)) where rn <= target")
def split_balance_classes(spark, sf_dir):
    """SPL07: as many rows of each class as the smallest has, first by hash."""
    rows = view(spark, sf_dir, "event_arm").select("arm", "ord")
    least = rows.groupBy("arm").count().agg(F.min("count").alias("target"))  # one row
    ranked = R.hash_rank(rows, F.sha2(F.col("ord").cast("string"), 256), within=("arm",))
    return ranked.join(least, F.col("rn") <= F.col("target")).select("arm", "ord")


@entry("sort_longest_first", "select doc_id, rn from (select doc_id, row_number() over (order by length(text) desc, doc_id) as rn from documents)")
def sort_longest_first(spark, sf_dir):
    """SRT09: by 64 steps for each doubling of the length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("length"))
    step = -F.floor(64 * F.log2(F.col("length") + F.lit(1)))
    return R.global_rank(docs, step, F.col("length").desc(), "doc_id").select("doc_id", "rn")


@entry("split_by_question", "with h as (select question_id, row_number() over (order by sha<<concat_ws(':', '3', cast(question_id as string))>>) as rn, count(*) over () as n from (select distinct question_id from gold_groups)) select g.question_id, g.alias_key, rn <= greatest(1, least(n - 1, round(n * 0.2e0))) as dev from gold_groups g join h on h.question_id = g.question_id")
def split_by_question(spark, sf_dir):
    """SPL02, SPL04, SPL05."""
    gold = view(spark, sf_dir, "gold_groups")
    q = gold.select("question_id").distinct()
    dev = F.col("rn") <= F.greatest(F.lit(1), F.least(F.col("n") - 1, F.round(F.col("n") * 0.2)))
    ranked = R.hash_rank(q, R.hash_order("3", "question_id")).join(q.agg(F.count("*").alias("n")))  # one row
    return gold.join(ranked.select("question_id", dev.alias("dev")), "question_id").select("question_id", "alias_key", "dev")


@entry("window_boundary_audit", "select question_id, chosen_id, rejected_id from (select *, row_number() over (order by gain, chosen_id, rejected_id) as near, row_number() over (order by sha<<concat_ws(':', cast(chosen_id as string), cast(rejected_id as string))>>) as rnd from pairs) where near <= 20 or rnd <= 20")
def window_boundary_audit(spark, sf_dir):
    """WIN18: the 20 smallest gains, and 20 by hash."""
    pairs = view(spark, sf_dir, "pairs").select("question_id", "chosen_id", "rejected_id", "gain")
    hashed = F.sha2(F.concat_ws(":", F.col("chosen_id").cast("string"), F.col("rejected_id").cast("string")), 256)
    return pairs.orderBy("gain", "chosen_id", "rejected_id").limit(20).union(pairs.orderBy(hashed).limit(20)).drop("gain").distinct()


def match_best_assignment(spark, sf_dir):
    """JON18: items to gold groups one to one, the heaviest matching."""
    pairs = view(spark, sf_dir, "matched").where("group_id is not null").selectExpr("question_id", "response_id", "item_ord", "group_id", "cast(100 - item_ord as double) as weight")
    return K.assign(pairs, ["question_id", "response_id"], "item_ord", "group_id", "weight")


def cluster_complete_link(spark, sf_dir):
    """SET08, SET10, SET17, STR23: near-duplicate surfaces of a question."""
    surfaces = view(spark, sf_dir, "fused").select("question_id", "rk", "answer")
    return K.complete_link(surfaces, "question_id", "rk", "answer")


def rank_diversify(spark, sf_dir):
    """WIN19, ENS20."""
    signed = view(spark, sf_dir, "fused").select("question_id", "rk", F.split("answer", " ")[0].alias("signature"))
    return K.diversify(signed, "question_id", "rk", "signature")


def stats_paired_bootstrap(spark, sf_dir):
    """ENS14, ENS15."""
    means = view(spark, sf_dir, "arm_means").groupBy("question_id").pivot("arm", ["click", "purchase"]).agg(F.first("mean_score"))
    return K.paired_bootstrap(means.select("question_id", (F.col("click") - F.col("purchase")).alias("delta")), "delta")


#: Sequential kernels: tests hold them against brute force.
for _f in (match_best_assignment, cluster_complete_link, rank_diversify, stats_paired_bootstrap):
    QUERIES[_f.__name__] = _f

QUERIES |= answers.QUERIES | reviews.QUERIES | relational.QUERIES | inputs.QUERIES | orchestration.QUERIES
ORACLE |= answers.ORACLE | reviews.ORACLE | relational.ORACLE | inputs.ORACLE | orchestration.ORACLE
