"""Catalog entries of relational operators.

Each entry is built from functions on DataFrames (operators/tables.py, ranking.py, preferences.py); its DuckDB SQL is a second
formulation of the same result over the same derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preferences as P
from ..operators import ranking as R
from ..operators import tables as Q
from ..sources import files
from . import answers
from .views import TABLES, for_duckdb, run_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


class Tables:
    """t(name): a driver's table or a derived view."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name):
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return run_sql(self.spark, self.sf_dir, f"select * from {name}")


def entry(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        ORACLE[name] = for_duckdb(sql)
        return f

    return add


def _metrics(t):
    return R.set_metrics(t("resp_items"), t("gold_groups"))


def _ranked(t):
    return Q.numbered(_metrics(t), ["question_id"], *R.response_rank(), name="rk")


def _fused(t):
    return R.ordered(R.pool(t("bank_rank")), *R.SELECTORS["rank_vote"]())


def _gold_answer(t):
    return t("bank_rank").where("draw = 1").groupBy("question_id").agg(F.min("answer").alias("gold"))


def _rr(t):
    gold = _gold_answer(t)
    return R.reciprocal_ranks(_fused(t).join(gold, "question_id"), gold.select("question_id"), F.col("answer") == F.col("gold"))


def _said(t):
    """(question_id, item_key, n): in how many responses an item stands."""
    return t("resp_items").groupBy("question_id", "item_key").agg(F.countDistinct("response_id").alias("n"))


@entry("scan_first_key", """select question_id, item_key, response_id, dup from (select question_id, item_key, response_id, count(*) over (partition by question_id, item_key) as dup, row_number() over (partition by question_id, item_key order by response_id, item_ord, tie) as rn from resp_items) where rn = 1""")
def scan_first_key(t):
    """SRC08, SET09, SET14, WIN21."""
    return Q.first_with_count(t("resp_items"), ["question_id", "item_key"], ["response_id", "item_ord", "tie"]).drop("item_ord", "tie")


@entry("scan_score_lookup_last", """select question_id, arm, score from (select *, row_number() over (partition by question_id, arm order by ord desc) as rn from event_arm) where rn = 1""")
def scan_score_lookup_last(t):
    """SRC16, JON02."""
    return Q.last_value(t("event_arm"), ["question_id", "arm"], "score", "ord")


@entry("scan_union_provenance", """select concat_ws('::', src, cast(id as string)) as response_id, src from (select 'orders' as src, o_orderkey as id from orders union all select 'customers' as src, c_custkey as id from customer)""")
def scan_union_provenance(t):
    """SRC17, SRC18, SRC23, SET01."""
    return files.union_sources({"orders": t("orders").select(F.col("o_orderkey").alias("response_id")), "customers": t("customer").select(F.col("c_custkey").alias("response_id"))}, "src")


@entry("scan_known_questions", """select i.response_id, count(*) as n from resp_items i where exists (select 1 from gold_groups g where g.question_id = i.question_id) group by i.response_id""")
def scan_known_questions(t):
    """SRC12, JON13."""
    return Q.known(t("resp_items"), t("gold_groups"), "question_id").groupBy("response_id").agg(F.count("*").alias("n"))


@entry("scan_journal_pending", """select c_custkey as question_id from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def scan_journal_pending(t):
    """SRC20, JON14, SET04."""
    return files.pending(t("customer").select(F.col("c_custkey").alias("question_id")), t("orders").select(F.col("o_custkey").alias("question_id")), "question_id")


@entry("scan_row_hash", """select n_nationkey, sha<<concat_ws('|', cast(n_nationkey as string), n_name, cast(n_regionkey as string))>> as row_sha256 from nation""")
def scan_row_hash(t):
    """SRC26, ORC08."""
    return Q.content_hash(t("nation"), ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "row_sha256")


@entry("project_alias_rows", """select concat(cast(question_id as string), '__alias_', lpad(cast(group_id as string), 2, '0'), '_of_', lpad(cast(count(*) over (partition by question_id) as string), 2, '0')) as id, question_id, alias_key from gold_groups""")
def project_alias_rows(t):
    """PRJ14, PRJ11, PRJ12."""
    return Q.alias_rows(t("gold_groups")).select("id", "question_id", "alias_key")


@entry("project_first_alias", """select question_id, alias_key as canonical from gold_groups where group_id = 1""")
def project_first_alias(t):
    """PRJ10, PRJ15."""
    return t("gold_groups").groupBy("question_id").agg(F.min_by("alias_key", "group_id").alias("canonical"))


@entry("project_whitelist", """select question_id, answer from bank_rank""")
def project_whitelist(t):
    """PRJ23."""
    return Q.whitelisted(t("bank_rank"), ["question_id", "answer"])


@entry("project_submission", """select question_id, rk as position, answer from fused where rk <= 5""")
def project_submission(t):
    """PRJ20, SRT06."""
    return _fused(t).where("rank <= 5").select("question_id", F.col("rank").alias("position"), "answer")


@entry("project_standard_row", """select question_id, response_id, checkpoint, cast(tp as bigint) as tp, cast(n_pred - tp as bigint) as fp, cast(n_gold - tp as bigint) as fn, round(p, 9) as p, round(r, 9) as r, round(f1, 9) as f1, n_pred as entity_count from metrics""")
def project_standard_row(t):
    """PRJ21."""
    m = _metrics(t).withColumns({c: F.round(c, 9) for c in ("p", "r", "f1")})
    return m.select("question_id", "response_id", "checkpoint", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), "p", "r", "f1", F.col("n_pred").alias("entity_count"))


@entry("filter_bank_rows", """select coalesce(reason, 'kept') as reason, count(*) as n from (select case when draw is null then 'sample_id_missing' when draw < 2 or draw > 6 then 'sample_id_range' when length(answer) > 40 then 'parser_status' end as reason from bank_rank) t group by coalesce(reason, 'kept')""")
def filter_bank_rows(t):
    """FLT02, AGG08."""
    return Q.reason_counts(t("bank_rank"), R.first_reason((F.col("draw").isNotNull(), "sample_id_missing"), (F.col("draw").between(2, 6), "sample_id_range"), (F.length("answer") <= 40, "parser_status")))


@entry("filter_types", """select event_id, event_type from events where event_type in ('click', 'purchase', 'view')""")
def filter_types(t):
    """FLT03."""
    return t("events").where(F.col("event_type").isin("click", "purchase", "view")).select("event_id", "event_type")


@entry("filter_eligible", """select question_id, response_id, case when n_pred > 6 then 'too_large' when tp = 0 then 'no_match' end as exclusion from metrics""")
def filter_eligible(t):
    """FLT04."""
    return _metrics(t).select("question_id", "response_id", R.first_reason((F.col("n_pred") <= 6, "too_large"), (F.col("tp") > 0, "no_match")).alias("exclusion"))


@entry("filter_gold_coverage", """select g.question_id, round(avg(case when i.item_key is not null then cast(1 as double) else 0 end), 9) as coverage from gold_groups g left join (select distinct question_id, item_key from resp_items where checkpoint = 'c0') i on i.question_id = g.question_id and i.item_key = g.alias_key group by g.question_id having avg(case when i.item_key is not null then cast(1 as double) else 0 end) >= 0.5""")
def filter_gold_coverage(t):
    """FLT10, AGG31."""
    return Q.alias_coverage(t("gold_groups"), t("resp_items").where("checkpoint = 'c0'"), 0.5).withColumn("coverage", F.round("coverage", 9))


@entry("filter_protected", """select doc_id, n_chars from documents d where n_chars between 80 and 6000 and not exists (select 1 from labels l where l.toxic = 1 and l.doc_id = d.doc_id)""")
def filter_protected(t):
    """FLT20."""
    return Q.unknown(t("documents").where("n_chars between 80 and 6000"), t("labels").where("toxic = 1"), "doc_id").select("doc_id", "n_chars")


@entry("filter_membership", """select s.question_id, m.model, b.question_id is not null as present from (select distinct question_id from bank_rank) s join (select distinct model from bank_rank) m on m.model is not null left join (select distinct question_id, model from bank_rank) b on b.question_id = s.question_id and b.model = m.model""")
def filter_membership(t):
    """FLT21, SET04."""
    return Q.membership(t("bank_rank"), "question_id", "model")


@entry("filter_failures_kept", """select c_custkey as question_id, coalesce(n, 0) as responses from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) o on o_custkey = c_custkey""")
def filter_failures_kept(t):
    """FLT22, MET04."""
    return Q.with_counts(t("customer").select(F.col("c_custkey").alias("question_id")), t("orders").select(F.col("o_custkey").alias("question_id")), "question_id", "responses")


@entry("filter_quality_vector", """select response_id, count(*) as items, cast(sum(case when hit then 1 else 0 end) as bigint) as accepted, cast(sum(case when group_id is null then 1 else 0 end) as bigint) as incorrect, cast(sum(case when group_id is not null and not hit then 1 else 0 end) as bigint) as repeated from matched group by response_id""")
def filter_quality_vector(t):
    """FLT16."""
    told = R.greedy_match(t("resp_items"), t("gold_groups"))
    return told.groupBy("response_id").agg(F.count("*").alias("items"), F.count_if("matched").alias("accepted"), F.count_if(F.col("group_id").isNull()).alias("incorrect"), F.count_if(F.col("group_id").isNotNull() & ~F.col("matched")).alias("repeated"))


@entry("filter_alignment", """with m as (select avg(gain) as g, stddev_pop(gain) as gs, avg(abs(chosen_n - rejected_n)) as e, stddev_pop(abs(chosen_n - rejected_n)) as es from pairs) select question_id, chosen_id, rejected_id, round(score, 6) as score from (select *, row_number() over (partition by question_id order by round(score, 6) desc, chosen_id, rejected_id) as rn from (select *, (gain - g) / gs - (abs(chosen_n - rejected_n) - e) / es as score from pairs join m on true)) where rn <= 2""")
def filter_alignment(t):
    """FLT13, ENS19."""
    scored = Q.standard_scores(t("pairs"), {"benefit": F.col("gain"), "cost": F.abs(F.col("chosen_n") - F.col("rejected_n"))})
    scored = scored.withColumn("score", F.round(F.col("benefit") - F.col("cost"), 6))
    return Q.first_of(scored, ["question_id"], F.desc("score"), "chosen_id", "rejected_id", n=2).select("question_id", "chosen_id", "rejected_id", "score")


@entry("join_bank_questions", """select o_custkey as question_id, checkpoint, count(distinct response_id) as responses from resp_items join orders on o_orderkey = response_id group by o_custkey, checkpoint""")
def join_bank_questions(t):
    """JON01."""
    asked = t("orders").select(F.col("o_orderkey").alias("response_id"), F.col("o_custkey").alias("question_id"))
    return t("resp_items").drop("question_id").join(asked, "response_id").groupBy("question_id", "checkpoint").agg(F.countDistinct("response_id").alias("responses"))


@entry("join_score_margin", """select p.question_id, chosen_id, rejected_id, round(c.o_totalprice - r.o_totalprice, 2) as margin from pairs p join orders c on c.o_orderkey = chosen_id join orders r on r.o_orderkey = rejected_id""")
def join_score_margin(t):
    """JON03, JON04, JON06."""
    return Q.margins(t("pairs"), t("orders"), "o_orderkey", "o_totalprice").select("question_id", "chosen_id", "rejected_id", F.round("margin", 2).alias("margin"))


@entry("join_positional", """select a.question_id, a.rk, a.answer as first_answer, b.response_id from fused a join ranked b on a.question_id = b.question_id and a.rk = b.rk where a.rk <= 3""")
def join_positional(t):
    """JON05."""
    a = _fused(t).where("rank <= 3").select("question_id", F.col("rank").alias("rk"), F.col("answer").alias("first_answer"))
    return a.join(_ranked(t).select("question_id", "rk", "response_id"), ["question_id", "rk"])


@entry("join_pareto", """select question_id, count(*) as dominated from (select a.question_id, a.response_id as x, b.response_id as y from ranked a join ranked b on a.question_id = b.question_id and a.response_id <> b.response_id where a.p >= b.p and a.r >= b.r and (a.p > b.p or a.r > b.r)) group by question_id""")
def join_pareto(t):
    """JON08, PAR20."""
    return Q.dominated(_metrics(t), "question_id", ["p", "r"])


@entry("join_permutations", """select a.question_id, a.response_id as x, b.response_id as y from ranked a join ranked b on a.question_id = b.question_id and a.response_id <> b.response_id where a.tp > b.tp and a.n_pred <= b.n_pred""")
def join_permutations(t):
    """JON09, JON10."""
    return Q.better_pairs(_metrics(t), "question_id", "response_id", "tp", "n_pred")


@entry("join_hard_negatives", """with neg as (select question_id, item_key, n, row_number() over (partition by question_id order by n desc, item_key) as rn from (select question_id, item_key, count(*) as n from matched where group_id is null group by question_id, item_key)) select g.question_id, g.alias_key as positive, item_key as negative, rn from gold_groups g join neg on neg.question_id = g.question_id where rn <= 3""")
def join_hard_negatives(t):
    """JON11, JON10, WIN07, PAR14."""
    wrong = R.greedy_match(t("resp_items"), t("gold_groups")).where("group_id is null")
    return Q.hard_negatives(t("gold_groups"), wrong, "question_id", "item_key").select("question_id", F.col("alias_key").alias("positive"), "negative", "rn")


@entry("join_best_match", """select question_id, shorter, longer from (select a.question_id, a.response_id as shorter, b.response_id as longer, row_number() over (partition by a.question_id order by abs(a.f1 - b.f1), abs(a.r - b.r), b.n_pred - a.n_pred, a.response_id, b.response_id) as rn from ranked a join ranked b on a.question_id = b.question_id and a.n_pred < b.n_pred) where rn = 1""")
def join_best_match(t):
    """JON12, WIN08."""
    return Q.nearest_longer(_metrics(t), "question_id", "response_id", "n_pred", ["f1", "r"])


@entry("join_outer_compare", """with a as (select question_id, count(distinct answer) as n from bank_rank where model = 'm0' group by question_id), b as (select question_id, count(distinct answer) as n from bank_rank where model = 'm1' group by question_id) select coalesce(a.question_id, b.question_id) as question_id, a.n as left_n, b.n as right_n from a full outer join b on a.question_id = b.question_id where a.n is distinct from b.n""")
def join_outer_compare(t):
    """JON15."""
    n = lambda model: t("bank_rank").where(F.col("model") == model).groupBy("question_id").agg(F.countDistinct("answer").alias("n"))
    return Q.outer_differences(n("m0"), n("m1"), "question_id", "n")


@entry("join_paired_transitions", """with s as (select question_id, max(case when arm = 'click' then mean_score end) as a, max(case when arm = 'view' then mean_score end) as b from arm_means group by question_id) select case when a > 50 and b > 50 then 'both' when a > 50 then 'lost' when b > 50 then 'gained' else 'neither' end as outcome, count(*) as questions from s where a is not null and b is not null group by 1""")
def join_paired_transitions(t):
    """JON16, JON17, ENS18."""
    means = t("event_arm").groupBy("question_id", "arm").agg(F.avg("score").alias("mean"))
    s = Q.arm_values(means, "question_id", "arm", F.col("mean"), {"a": "click", "b": "view"}).dropna()
    return s.groupBy(Q.transitions(F.col("a") > 50, F.col("b") > 50).alias("outcome")).agg(F.count("*").alias("questions"))


@entry("join_upsert", """select coalesce(a.question_id, b.question_id) as question_id, coalesce(a.alias_key, b.item_key) as item_key, case when a.alias_key is null then 'inserted' when b.item_key is null then 'kept' else 'updated' end as action from gold_groups a full outer join (select distinct question_id, item_key from resp_items where checkpoint = 'c1') b on a.question_id = b.question_id and a.alias_key = b.item_key""")
def join_upsert(t):
    """JON21."""
    return Q.upsert(t("gold_groups").withColumnRenamed("alias_key", "item_key"), t("resp_items").where("checkpoint = 'c1'"), ["question_id", "item_key"])


@entry("join_gold_exact", """select distinct i.question_id, i.item_key, g.group_id is not null as exact from resp_items i left join gold_groups g on g.question_id = i.question_id and g.alias_key = i.item_key""")
def join_gold_exact(t):
    """JON23, UDF01."""
    gold = t("gold_groups").select("question_id", F.col("alias_key").alias("item_key"), F.lit(True).alias("exact")).distinct()
    return t("resp_items").select("question_id", "item_key").distinct().join(gold, ["question_id", "item_key"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


@entry("join_cluster_lookup", """select question_id, response_id, count(distinct coalesce('gold:' || cast(group_id as string), 'surface:' || item_key)) as clusters, count(distinct group_id) as aligned from matched group by question_id, response_id""")
def join_cluster_lookup(t):
    """JON22, MET02."""
    told = R.greedy_match(t("resp_items"), t("gold_groups"))
    cluster = F.when(F.col("group_id").isNull(), F.concat(F.lit("surface:"), "item_key")).otherwise(F.concat(F.lit("gold:"), F.col("group_id").cast("string")))
    return told.groupBy("question_id", "response_id").agg(F.countDistinct(cluster).alias("clusters"), F.countDistinct("group_id").alias("aligned"))


@entry("agg_numeric_summary", """select arm, count(score) as n, round(avg(score), 6) as mean, round(median(score), 6) as median, min(score) as low, max(score) as high from event_arm group by arm""")
def agg_numeric_summary(t):
    """AGG01, AGG24."""
    return Q.numeric_summary(t("event_arm"), "arm", "score")


@entry("agg_distinct_questions", """select checkpoint, count(*) as responses, count(distinct question_id) as questions from metrics group by checkpoint""")
def agg_distinct_questions(t):
    """AGG04, AGG05."""
    return _metrics(t).groupBy("checkpoint").agg(F.count("*").alias("responses"), F.countDistinct("question_id").alias("questions"))


@entry("agg_omission_recoverable", """select g.question_id, count(*) as missing, cast(sum(case when s.item_key is not null then 1 else 0 end) as bigint) as recoverable from gold_groups g join (select question_id, response_id from ranked where rk = 1) b on b.question_id = g.question_id left join (select distinct question_id, item_key from resp_items) s on s.question_id = g.question_id and s.item_key = g.alias_key where not exists (select 1 from resp_sets x where x.response_id = b.response_id and x.question_id = g.question_id and x.item_key = g.alias_key) group by g.question_id""")
def agg_omission_recoverable(t):
    """AGG10."""
    sets = t("resp_items").select("question_id", "response_id", "item_key").distinct()
    best = Q.known(sets, _ranked(t).where("rk = 1"), ["question_id", "response_id"])
    return Q.omissions(t("gold_groups"), best, sets)


@entry("agg_bank_diversity", """with t as (select question_id, response_id, list_distinct(list(item_key)) as l, string_agg(item_key, '|' order by item_key) as k from resp_sets group by question_id, response_id), u as (select question_id, count(*) as units, count(distinct k) as distinct_sets from t group by question_id), x as (select a.question_id, len(list_intersect(a.l, b.l)) as both_, len(list_distinct(list_concat(a.l, b.l))) as any_ from t a join t b on a.question_id = b.question_id and a.response_id < b.response_id), y as (select question_id, round(avg(cast(both_ as double) / any_), 9) as jaccard, cast(sum(any_ - both_) as bigint) as set_edits from x group by question_id) select u.question_id, units, distinct_sets, units * (units - 1) // 2 as pairs, jaccard, coalesce(set_edits, 0) as set_edits from u left join y on y.question_id = u.question_id""")
def agg_bank_diversity(t):
    """AGG11, SET05, SET06."""
    return Q.bank_diversity(t("resp_items"), "question_id", "response_id", "item_key")


@entry("agg_pair_stats", """select count(*) as pairs, round(avg(chosen_n), 6) as chosen_n, round(avg(rejected_n), 6) as rejected_n, round(avg(gain), 6) as gain, cast(sum(case when chosen_f1 <= rejected_f1 then 1 else 0 end) as bigint) as violations from pairs""")
def agg_pair_stats(t):
    """AGG12, AGG09."""
    n = lambda c: F.round(F.avg(c), 6).alias(c)
    return t("pairs").agg(F.count("*").alias("pairs"), n("chosen_n"), n("rejected_n"), n("gain"), F.count_if(F.col("chosen_f1") <= F.col("rejected_f1")).alias("violations"))


@entry("agg_numeric_bins", """select case when score <= 10 then 'le_10' when score <= 50 then 'le_50' when score <= 90 then 'le_90' else 'gt_90' end as bin, count(*) as n from event_arm group by 1""")
def agg_numeric_bins(t):
    """AGG14."""
    return t("event_arm").groupBy(Q.bins(F.col("score"), [(10, "le_10"), (50, "le_50"), (90, "le_90")], "gt_90").alias("bin")).agg(F.count("*").alias("n"))


@entry("agg_micro_macro", """with q as (select arm, question_id, count(*) as n, sum(case when score > 50 then 1 else 0 end) as k from event_arm group by arm, question_id) select arm, round(cast(sum(k) as double) / sum(n), 6) as micro, round(avg(cast(k as double) / n), 6) as macro from q group by arm""")
def agg_micro_macro(t):
    """AGG15, AGG16."""
    return Q.micro_macro(t("event_arm"), "arm", "question_id", F.col("score") > 50)


@entry("agg_probe_summary", """select checkpoint, n_pred, count(*) as n, round(avg(f1), 6) as f1 from metrics group by checkpoint, n_pred""")
def agg_probe_summary(t):
    """AGG17, AGG16."""
    return _metrics(t).groupBy("checkpoint", "n_pred").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"))


@entry("agg_surface_stats", """select question_id, item_key, count(*) as n, count(distinct response_id) as responses, count(distinct checkpoint) as sources, min(response_id) as first_response from resp_items group by question_id, item_key""")
def agg_surface_stats(t):
    """AGG18, AGG19."""
    return t("resp_items").groupBy("question_id", "item_key").agg(F.count("*").alias("n"), F.countDistinct("response_id").alias("responses"), F.countDistinct("checkpoint").alias("sources"), F.min("response_id").alias("first_response"))


@entry("agg_sample_frequency", """select question_id, item_key, n from (select question_id, item_key, count(distinct response_id) as n from resp_items group by question_id, item_key) where n >= 2""")
def agg_sample_frequency(t):
    """AGG21, SET02."""
    return _said(t).where("n >= 2")


@entry("agg_pool_merge", """select question_id, answer, votes, best_rank, round(rank_vote, 9) as rank_vote, round(frequency, 9) as frequency from pooled""")
def agg_pool_merge(t):
    """AGG22, AGG23, SET13."""
    return R.pool(t("bank_rank")).select("question_id", "answer", "votes", "best_rank", F.round("rank_vote", 9).alias("rank_vote"), F.round("frequency", 9).alias("frequency"))


@entry("agg_generation_quality", """select model, count(*) as draws, cast(sum(case when n >= 10 then 1 else 0 end) as bigint) as at_ceiling, round(avg(n), 6) as candidates from (select question_id, model, draw, count(distinct answer) as n from bank_rank group by question_id, model, draw) group by model""")
def agg_generation_quality(t):
    """AGG25."""
    per = t("bank_rank").groupBy("question_id", "model", "draw").agg(F.countDistinct("answer").alias("n"))
    return per.groupBy("model").agg(F.count("*").alias("draws"), F.count_if(F.col("n") >= 10).alias("at_ceiling"), F.round(F.avg("n"), 6).alias("candidates"))


@entry("agg_usage", """select role, count(*) as calls, cast(sum(length(text)) as bigint) as chars, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^ ]+'))) as bigint) as tokens from conversations group by role""")
def agg_usage(t):
    """AGG27, AGG28, STR46."""
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ ]+"))
    return t("conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(tokens.cast("long")).alias("tokens"))


@entry("agg_selector_stats", """select question_id, pos, n - pos as neg, pos * (n - pos) as comparisons from (select f.question_id, count(*) as n, cast(sum(case when answer = gold then 1 else 0 end) as bigint) as pos from fused f join gold_answer g on g.question_id = f.question_id group by f.question_id)""")
def agg_selector_stats(t):
    """AGG30, SPL15."""
    told = R.pool(t("bank_rank")).join(_gold_answer(t), "question_id")
    per = told.groupBy("question_id").agg(F.count_if(F.col("answer") == F.col("gold")).alias("pos"), F.count_if(F.col("answer") != F.col("gold")).alias("neg"))
    return per.withColumn("comparisons", F.col("pos") * F.col("neg"))


@entry("metric_recall_curve", """select k, cast(sum(case when first_rank <= k then 1 else 0 end) as bigint) as covered, count(*) as questions from rr cross join (select unnest(range(1, 11)) as k) group by k""")
def metric_recall_curve(t):
    """MET06."""
    return Q.recall_curve(_rr(t), 10)


@entry("metric_partition", """select case when first_rank = 1 then 'first' when first_rank <= 5 then 'top5' when first_rank is not null then 'below' else 'absent' end as place, count(*) as questions from rr group by 1""")
def metric_partition(t):
    """MET06, MET15."""
    place = F.when(F.col("first_rank") == 1, "first").when(F.col("first_rank") <= 5, "top5").when(F.col("first_rank").isNotNull(), "below").otherwise("absent")
    return _rr(t).groupBy(place.alias("place")).agg(F.count("*").alias("questions"))


@entry("metric_rank_contiguity", """select count(*) as bad from (select question_id, count(*) as n, max(rk) as last, count(distinct rk) as d from fused group by question_id) where n <> last or d <> n""")
def metric_rank_contiguity(t):
    """MET08, MET07."""
    per = _fused(t).groupBy("question_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.countDistinct("rank").alias("d"))
    return per.where((F.col("n") != F.col("last")) | (F.col("d") != F.col("n"))).agg(F.count("*").alias("bad"))


@entry("metric_official", """with m as (select checkpoint as kind, avg(f1) as f1, count(*) as n from metrics group by checkpoint) select round(avg(f1), 6) as macro, round(sum(f1 * n) / sum(n), 6) as weighted from m""")
def metric_official(t):
    """MET09."""
    kinds = _metrics(t).groupBy("checkpoint").agg(F.avg("f1").alias("f1"), F.count("*").alias("n"))
    return kinds.agg(F.round(F.avg("f1"), 6).alias("macro"), F.round(F.sum(F.col("f1") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@entry("metric_draw_prefix", """select d.k, count(distinct b.question_id) as covered from (select distinct draw as k from bank_rank) d join bank_rank b on b.draw <= d.k join gold_answer g on g.question_id = b.question_id and g.gold = b.answer group by d.k""")
def metric_draw_prefix(t):
    """MET12, MET16."""
    hits = t("bank_rank").join(_gold_answer(t), "question_id").where("answer = gold")
    return Q.prefix_coverage(hits, t("bank_rank"), "question_id", "draw")


@entry("metric_batches", """select checkpoint, question_id % 10 as batch, round(avg(f1), 6) as f1 from metrics group by checkpoint, question_id % 10""")
def metric_batches(t):
    """MET13."""
    return _metrics(t).groupBy("checkpoint", (F.col("question_id") % 10).alias("batch")).agg(F.round(F.avg("f1"), 6).alias("f1"))


@entry("metric_reward", """select question_id, response_id, round(0.5e0 * f1 + 0.3e0 * r + 0.2e0 * p - 0.1e0 * abs(n_pred - n_gold) / greatest(n_pred, n_gold), 9) as reward from metrics""")
def metric_reward(t):
    """MET17."""
    gap = F.abs(F.col("n_pred") - F.col("n_gold")) / F.greatest("n_pred", "n_gold")
    return _metrics(t).select("question_id", "response_id", F.round(0.5 * F.col("f1") + 0.3 * F.col("r") + 0.2 * F.col("p") - 0.1 * gap, 9).alias("reward"))


@entry("window_response_rank", """select question_id, response_id, rk from ranked""")
def window_response_rank(t):
    """WIN01, SRT01."""
    return _ranked(t).select("question_id", "response_id", "rk")


@entry("window_score_rank", """select question_id, response_id, row_number() over (partition by question_id order by o_totalprice desc, f1 desc, p desc, r desc, n_pred, response_id) as rk from metrics join orders on o_orderkey = response_id""")
def window_score_rank(t):
    """WIN02."""
    scored = _metrics(t).join(t("orders").select(F.col("o_orderkey").alias("response_id"), "o_totalprice"), "response_id")
    return Q.numbered(scored, ["question_id"], F.desc("o_totalprice"), *R.response_rank(), name="rk").select("question_id", "response_id", "rk")


@entry("window_pair_cap", """select question_id, chosen_id, rejected_id from (select *, row_number() over (partition by question_id order by gain desc, chosen_rank, rejected_rank) as rn from (select *, row_number() over (partition by question_id, least(chosen_id, rejected_id), greatest(chosen_id, rejected_id) order by gain desc, chosen_rank) as once from pairs) where once = 1) where rn <= 3""")
def window_pair_cap(t):
    """WIN04, WIN14."""
    p = t("pairs").withColumns({"low": F.least("chosen_id", "rejected_id"), "high": F.greatest("chosen_id", "rejected_id")})
    once = Q.first_of(p, ["question_id", "low", "high"], F.desc("gain"), "chosen_rank")
    return Q.first_of(once, ["question_id"], F.desc("gain"), "chosen_rank", "rejected_rank", n=3).select("question_id", "chosen_id", "rejected_id")


@entry("window_generation_order", """select question_id, answer, row_number() over (partition by question_id order by first_draw nulls last, answer) as rk from (select question_id, answer, min(draw) as first_draw from bank_rank group by question_id, answer)""")
def window_generation_order(t):
    """WIN05."""
    first = t("bank_rank").groupBy("question_id", "answer").agg(F.min("draw").alias("first"))
    return Q.numbered(first, ["question_id"], F.asc_nulls_last("first"), "answer", name="rk").drop("first")


@entry("window_construction_robin", """select question_id, checkpoint, response_id from (select *, row_number() over (partition by question_id order by turn, checkpoint) as pos from (select *, row_number() over (partition by question_id, checkpoint order by f1 desc, response_id) as turn from metrics)) where pos <= 4""")
def window_construction_robin(t):
    """WIN10, WIN11, PAR22."""
    turns = Q.numbered(_metrics(t), ["question_id", "checkpoint"], F.desc("f1"), "response_id", name="turn")
    return Q.first_of(turns, ["question_id"], "turn", "checkpoint", n=4).select("question_id", "checkpoint", "response_id")


@entry("window_balanced_sample", """select question_id, response_id, turn from (select question_id, response_id, row_number() over (partition by question_id order by sha<<concat_ws(':', '5', cast(response_id as string))>>, response_id) as turn from metrics) where turn <= 2""")
def window_balanced_sample(t):
    """WIN12, SRT05, SPL08."""
    return Q.first_of(_metrics(t), ["question_id"], R.hash_order("5", "response_id"), "response_id", n=2, name="turn").select("question_id", "response_id", "turn")


@entry("window_best_epoch", """select checkpoint, n_pred as epoch, f1 from (select checkpoint, n_pred, round(avg(f1), 9) as f1, row_number() over (partition by checkpoint order by round(avg(f1), 9) desc, n_pred) as rn from metrics group by checkpoint, n_pred) where rn = 1""")
def window_best_epoch(t):
    """WIN16."""
    mean = _metrics(t).groupBy("checkpoint", F.col("n_pred").alias("epoch")).agg(F.round(F.avg("f1"), 9).alias("f1"))
    return mean.groupBy("checkpoint").agg(F.max(F.struct("f1", -F.col("epoch"))).alias("b")).select("checkpoint", (-F.col("b.col2")).alias("epoch"), "b.f1")


@entry("window_rank_blend", """select question_id, answer, row_number() over (partition by question_id order by round(0.4e0 / a + 0.6e0 / b, 12) desc, answer) as rk from (select question_id, answer, row_number() over (partition by question_id order by round(rank_vote, 9) desc, answer) as a, row_number() over (partition by question_id order by votes desc, best_rank, answer) as b from pooled)""")
def window_rank_blend(t):
    """WIN20."""
    pool = R.pool(t("bank_rank"))
    both = Q.numbered(Q.numbered(pool, ["question_id"], F.round("rank_vote", 9).desc(), "answer", name="a"), ["question_id"], F.desc("votes"), "best_rank", "answer", name="b")
    return Q.numbered(both, ["question_id"], F.round(0.4 / F.col("a") + 0.6 / F.col("b"), 12).desc(), "answer", name="rk").select("question_id", "answer", "rk")


@entry("window_self_consistency", """select question_id, item_key from (select question_id, item_key, row_number() over (partition by question_id order by count(*) desc, min(response_id), item_key) as rn from resp_items group by question_id, item_key) where rn = 1""")
def window_self_consistency(t):
    """WIN22, WIN21."""
    votes = t("resp_items").groupBy("question_id", "item_key").agg(F.count("*").alias("n"), F.min("response_id").alias("first"))
    return votes.groupBy("question_id").agg(F.min(F.struct(-F.col("n"), "first", "item_key")).alias("b")).select("question_id", "b.item_key")


@entry("sort_distinct_window", """select question_id from (select question_id, min(ord) as first from bank_rank group by question_id) order by first, question_id limit 40 offset 20""")
def sort_distinct_window(t):
    """SRT03."""
    first = t("bank_rank").groupBy("question_id").agg(F.min("ord").alias("first"))
    return first.orderBy("first", "question_id").offset(20).limit(40).select("question_id")


@entry("sort_form_priority", """select question_id, arm, ord from (select *, row_number() over (partition by question_id order by case arm when 'purchase' then 0 when 'click' then 1 else 2 end, ord) as rn from event_arm) where rn <= 3""")
def sort_form_priority(t):
    """SRT07, SRT08."""
    priority = F.when(F.col("arm") == "purchase", 0).when(F.col("arm") == "click", 1).otherwise(2)
    return Q.first_of(t("event_arm"), ["question_id"], priority, "ord", n=3).select("question_id", "arm", "ord")


@entry("set_union_dedupe", """select question_id, item_key, count(distinct checkpoint) as origins from resp_items group by question_id, item_key""")
def set_union_dedupe(t):
    """SET01, SET15."""
    return t("resp_items").groupBy("question_id", "item_key").agg(F.countDistinct("checkpoint").alias("origins"))


@entry("set_frequency_fallback", """with f as (select question_id, item_key, count(distinct response_id) as n from resp_items group by question_id, item_key), m as (select question_id, max(n) as most from f group by question_id) select f.question_id, f.item_key from f join m on m.question_id = f.question_id where n >= 3 or most < 3""")
def set_frequency_fallback(t):
    """SET02, ENS01."""
    return Q.frequent_or_all(_said(t), "question_id", "n", 3).select("question_id", "item_key")


@entry("set_leakage", """with q as (select question_id, row_number() over (order by sha<<concat_ws(':', '7', cast(question_id as string))>>, question_id) as rn, count(*) over () as n from (select distinct question_id from gold_groups)), s as (select question_id, case when rn <= floor(n * 0.1e0) then 'test' when rn <= floor(n * 0.2e0) then 'dev' else 'train' end as part from q union select question_id, 'extra' as part from gold_answer where question_id % 7 = 3) select question_id, string_agg(part, '|' order by part) as parts from s group by question_id having count(*) > 1""")
def set_leakage(t):
    """SET03, FLT19."""
    split = answers.split_nested(t.spark, t.sf_dir)
    parts = {name: split.where(F.col("split") == name) for name in ("train", "dev", "test")}
    extra = t("bank_rank").where("draw = 1 and question_id % 7 = 3")  # a planted source that overlaps the splits
    return Q.shared_between({**parts, "extra": extra}, "question_id").withColumn("parts", F.array_join("parts", "|"))


@entry("set_exact_duplicates", """select min(doc_id) as first_id, count(*) as copies from documents group by text""")
def set_exact_duplicates(t):
    """SET09, SET13."""
    return t("documents").groupBy(F.sha2("text", 256).alias("text")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).drop("text")


@entry("array_min_ranks", """select question_id, answer, model, src_rank as min_rank from per_model""")
def array_min_ranks(t):
    """ARR10, ARR11."""
    return t("bank_rank").groupBy("question_id", "answer", "model").agg(F.min("draw").alias("min_rank"))


@entry("array_window_merge", """select conv_id, turn - w as window_id, count(*) as turns from (select c.conv_id, c.turn, v.w from conversations c join (select 0 as w union all select 1 as w) v on c.turn >= v.w) group by conv_id, turn - w""")
def array_window_merge(t):
    """ARR12, ARR13."""
    return Q.half_overlapping(t("conversations"), "conv_id", "turn", 2).groupBy("conv_id", "window_id").agg(F.count("*").alias("turns"))


@entry("split_pool_weights", """with p as (select question_id, answer, cast(1 as double) / count(*) over (partition by question_id) as w from pooled) select question_id, answer, round(w / mean, 9) as weight from p join (select avg(w) as mean from p) m on true""")
def split_pool_weights(t):
    """SPL16."""
    pool = R.pool(t("bank_rank")).select("question_id", "answer")
    w = pool.join(pool.groupBy("question_id").agg((1.0 / F.count("*")).alias("w")), "question_id")
    mean = w.agg(F.avg("w").alias("mean"))  # one row
    return w.join(F.broadcast(mean)).select("question_id", "answer", F.round(F.col("w") / F.col("mean"), 9).alias("weight"))


@entry("ensemble_weighted_vote", """select question_id, answer, round(sum(case model when 'm0' then 0.5e0 when 'm1' then 0.3e0 else 0.2e0 end), 9) as weight from per_model group by question_id, answer having sum(case model when 'm0' then 0.5e0 when 'm1' then 0.3e0 else 0.2e0 end) >= 0.45e0""")
def ensemble_weighted_vote(t):
    """ENS01."""
    weight = F.when(F.col("model") == "m0", 0.5).when(F.col("model") == "m1", 0.3).otherwise(0.2)
    votes = t("bank_rank").select("question_id", "answer", "model").distinct().groupBy("question_id", "answer").agg(F.round(F.sum(weight), 9).alias("weight"))
    return votes.where("weight >= 0.45")


@entry("ensemble_threshold_sweep", """select t, count(*) as answers, cast(sum(case when answer = gold then 1 else 0 end) as bigint) as tp from (select p.question_id, answer, votes, gold from pooled p join gold_answer g on g.question_id = p.question_id) join (select 1 as t union all select 2 as t union all select 3 as t) on votes >= t group by t""")
def ensemble_threshold_sweep(t):
    """ENS02."""
    told = R.pool(t("bank_rank")).join(_gold_answer(t), "question_id")
    at = told.select(F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.col("votes").cast("int")))).alias("t"), (F.col("answer") == F.col("gold")).alias("right"))
    return at.groupBy("t").agg(F.count("*").alias("answers"), F.count_if("right").alias("tp"))


@entry("ensemble_counterfactual", """select model, count(*) as only_here from (select p.question_id, p.model, count(*) over (partition by p.question_id) as n from per_model p join gold_answer g on g.question_id = p.question_id and g.gold = p.answer) where n = 1 group by model""")
def ensemble_counterfactual(t):
    """ENS12, ENS13."""
    right = t("bank_rank").join(_gold_answer(t), "question_id").where("answer = gold")
    one = right.groupBy("question_id").agg(F.min("model").alias("model"), F.max("model").alias("last")).where("model = last")
    return one.groupBy("model").agg(F.count("*").alias("only_here"))


@entry("stats_mcnemar", """with s as (select question_id, max(case when arm = 'click' and score > 50 then 1 else 0 end) as a, max(case when arm = 'purchase' and score > 50 then 1 else 0 end) as b from event_arm group by question_id) select cast(sum(case when a = 0 and b = 1 then 1 else 0 end) as bigint) as gained, cast(sum(case when a = 1 and b = 0 then 1 else 0 end) as bigint) as lost, cast(sum(a * b) as bigint) as both_right, cast(sum((1 - a) * (1 - b)) as bigint) as neither from s""")
def stats_mcnemar(t):
    """ENS17."""
    s = Q.arm_values(t("event_arm"), "question_id", "arm", (F.col("score") > 50).cast("int"), {"a": "click", "b": "purchase"}).fillna(0)
    n = lambda c: F.count_if(c)
    a, b = F.col("a") == 1, F.col("b") == 1
    return s.agg(n(~a & b).alias("gained"), n(a & ~b).alias("lost"), n(a & b).alias("both_right"), n(~a & ~b).alias("neither"))


@entry("stats_zscore", """select arm, ord, round(case when sd = 0 then 0 else (score - mu) / sd end, 6) as z from (select *, avg(score) over (partition by arm) as mu, stddev_pop(score) over (partition by arm) as sd from event_arm)""")
def stats_zscore(t):
    """ENS19."""
    return Q.scores_within(t("event_arm"), "arm", "score").select("arm", "ord", F.round("z", 6).alias("z"))


@entry("stats_sigmoid", """select question_id, chosen_id, rejected_id, round(ln(1 + exp(-gain)), 9) as dpo_loss, round(1 / (1 + exp(-gain)), 9) as win from pairs""")
def stats_sigmoid(t):
    """ENS21, PAR29."""
    gain = F.col("gain")
    return t("pairs").select("question_id", "chosen_id", "rejected_id", F.round(F.log1p(F.exp(-gain)), 9).alias("dpo_loss"), F.round(1 / (1 + F.exp(-gain)), 9).alias("win"))


@entry("pairs_dcrm", """select question_id, chosen_id, rejected_id, round((1 / (1 + exp(-gain)) - 0.5e0) / (abs(chosen_n - rejected_n) + 1), 9) as dcrm from pairs""")
def pairs_dcrm(t):
    """PAR02, PAR03."""
    edit = F.abs(F.col("chosen_n") - F.col("rejected_n"))
    return t("pairs").select("question_id", "chosen_id", "rejected_id", F.round(P.dcrm_score(F.col("gain"), edit, F.lit(1.0), epsilon=0.0), 9).alias("dcrm"))


@entry("pairs_curriculum", """select case when chosen_f1 >= 0.5 and rejected_f1 < 0.1 then 'c3_c1' when chosen_f1 >= 0.5 then 'c3_c2' else 'c2_c1' end as stage, count(*) as pairs from pairs group by 1""")
def pairs_curriculum(t):
    """PAR10."""
    stage = F.concat(F.when(F.col("chosen_f1") >= 0.5, "c3").otherwise("c2"), F.when((F.col("chosen_f1") >= 0.5) & (F.col("rejected_f1") >= 0.1), "_c2").otherwise("_c1"))
    return t("pairs").groupBy(stage.alias("stage")).agg(F.count("*").alias("pairs"))


@entry("pairs_tie_labels", """select question_id, chosen_id, rejected_id, case when gain < 0.15 then 'tie' else 'win' end as label from pairs""")
def pairs_tie_labels(t):
    """PAR11."""
    return t("pairs").select("question_id", "chosen_id", "rejected_id", F.when(F.col("gain") < 0.15, "tie").otherwise("win").alias("label"))


@entry("pairs_wrong_entities", """select question_id, item_key as wrong, rn from (select question_id, item_key, row_number() over (partition by question_id order by count(*) desc, item_key) as rn from matched where group_id is null group by question_id, item_key) where rn <= 4""")
def pairs_wrong_entities(t):
    """PAR12."""
    wrong = R.greedy_match(t("resp_items"), t("gold_groups")).where("group_id is null").groupBy("question_id", F.col("item_key").alias("wrong")).agg(F.count("*").alias("n"))
    return Q.first_of(wrong, ["question_id"], F.desc("n"), "wrong", n=4).drop("n")


@entry("pairs_gold_vs_sampled", """select question_id, response_id as rejected_id, n_gold as chosen_n, n_pred as rejected_n from ranked where f1 between 0.1 and 0.8 and n_pred <= 2 * n_gold""")
def pairs_gold_vs_sampled(t):
    """PAR04."""
    m = _metrics(t).where(F.col("f1").between(0.1, 0.8) & (F.col("n_pred") <= 2 * F.col("n_gold")))
    return m.select("question_id", F.col("response_id").alias("rejected_id"), F.col("n_gold").alias("chosen_n"), F.col("n_pred").alias("rejected_n"))


@entry("pairs_set_additions", """select m.question_id, m.response_id, m.item_key as removed from matched m join metrics x on x.response_id = m.response_id and x.question_id = m.question_id where m.group_id is null and x.n_pred > 1""")
def pairs_set_additions(t):
    """PAR05."""
    told = R.greedy_match(t("resp_items"), t("gold_groups")).where("group_id is null")
    return Q.known(told, _metrics(t).where("n_pred > 1"), ["question_id", "response_id"]).select("question_id", "response_id", F.col("item_key").alias("removed"))


@entry("pairs_set_omissions", """select r.question_id, r.response_id, g.alias_key as added from ranked r join gold_groups g on g.question_id = r.question_id where not exists (select 1 from resp_sets s where s.question_id = r.question_id and s.response_id = r.response_id and s.item_key = g.alias_key)""")
def pairs_set_omissions(t):
    """PAR06, SFT09."""
    wanted = _metrics(t).select("question_id", "response_id").join(t("gold_groups").select("question_id", F.col("alias_key").alias("item_key")), "question_id")
    return Q.unknown(wanted, t("resp_items"), ["question_id", "response_id", "item_key"]).withColumnRenamed("item_key", "added")


@entry("pairs_directions", """select case when chosen_n < rejected_n then 'shorter' when chosen_n > rejected_n then 'longer' else 'same' end as direction, case when chosen_p > rejected_p and chosen_r > rejected_r then 'both' when chosen_p > rejected_p then 'precision' else 'recall' end as operation, count(*) as pairs, round(avg(gain), 6) as gain from pairs group by 1, 2""")
def pairs_directions(t):
    """PAR17, PAR18."""
    size = F.signum(F.col("chosen_n") - F.col("rejected_n"))
    direction = F.element_at(F.array(*map(F.lit, ("shorter", "same", "longer"))), (size + 2).cast("int"))
    p, r = F.col("chosen_p") > F.col("rejected_p"), F.col("chosen_r") > F.col("rejected_r")
    return t("pairs").groupBy(direction.alias("direction"), F.when(p & r, "both").when(p, "precision").otherwise("recall").alias("operation")).agg(F.count("*").alias("pairs"), F.round(F.avg("gain"), 6).alias("gain"))


@entry("pairs_loss", """select question_id, chosen_id, rejected_id, round(-ln(1 / (1 + exp(-0.1e0 * (chosen_f1 - rejected_f1)))), 9) as dpo, round(power(chosen_f1 - 0.5e0, 2) + power(rejected_f1 + 0.5e0, 2), 9) as cal_dpo, round(1 - 1 / (1 + exp(-chosen_f1)) + 1 / (1 + exp(-rejected_f1)), 9) as apo_zero from pairs""")
def pairs_loss(t):
    """PAR29."""
    c, r = F.col("chosen_f1"), F.col("rejected_f1")
    return t("pairs").select("question_id", "chosen_id", "rejected_id", F.round(P.dpo_loss(c - r, 0.1), 9).alias("dpo"), F.round(P.calibrated_loss(c, r), 9).alias("cal_dpo"), F.round(P.anchored_loss(c, r), 9).alias("apo_zero"))


@entry("sft_targets", """select question_id, group_id, alias_key, case when group_id = 1 then 'original' else 'variant' end as relation from gold_groups where group_id <= 3""")
def sft_targets(t):
    """SFT01, SFT09."""
    return t("gold_groups").where("group_id <= 3").withColumn("relation", F.when(F.col("group_id") == 1, "original").otherwise("variant"))


@entry("sft_visible_gold", """select g.question_id, count(*) as visible from gold_groups g where exists (select 1 from resp_sets s where s.question_id = g.question_id and s.item_key = g.alias_key and s.response_id % 2 = 0) group by g.question_id having count(*) >= 2""")
def sft_visible_gold(t):
    """SFT02, SFT03."""
    shown = t("resp_items").where("response_id % 2 = 0").select("question_id", F.col("item_key").alias("alias_key"))
    seen = Q.known(t("gold_groups"), shown, ["question_id", "alias_key"]).groupBy("question_id").agg(F.count("*").alias("visible"))
    return seen.where("visible >= 2")


@entry("sft_conversations", """select conv_id, count(*) as turns, cast(sum(case when role = 'assistant' then 1 else 0 end) as bigint) as answers, min(case when turn = 0 then role end) as first_role from conversations group by conv_id""")
def sft_conversations(t):
    """SFT12, PRJ09."""
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))


@entry("boundary_pending", """select i.question_id, i.item_key from (select distinct question_id, item_key from resp_items where checkpoint = 'c0') i left join (select distinct question_id, item_key from resp_items where checkpoint = 'c1') c on c.question_id = i.question_id and c.item_key = i.item_key where c.item_key is null and not exists (select 1 from gold_groups g where g.question_id = i.question_id and g.alias_key = i.item_key)""")
def boundary_pending(t):
    """SRC21, SRC22."""
    gold = t("gold_groups").select("question_id", F.col("alias_key").alias("item_key"))
    units = t("resp_items").where("checkpoint = 'c0'").select("question_id", "item_key").distinct()
    return Q.unknown(Q.unknown(units, t("resp_items").where("checkpoint = 'c1'"), ["question_id", "item_key"]), gold, ["question_id", "item_key"])


@entry("split_panel", """select id, stratum, case when rn <= 10 then 'discovery' else 'audit' end as part from (select c_custkey as id, c_mktsegment as stratum, row_number() over (partition by c_mktsegment order by sha<<concat_ws(':', '9', cast(c_custkey as string))>>, c_custkey) as rn from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_custkey is not null) and c_custkey % 50 <> 0) where rn <= 20""")
def split_panel(t):
    """SPL13."""
    people = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    protected = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    reserved = people.where("id % 50 = 0")
    return Q.panel(people, "id", "stratum", 20, R.hash_order("9", "id"), [protected, reserved]).select("id", "stratum", "part")


@entry("split_distractor", """select id, stratum, coalesce(following, first_id) as distractor from (select c_custkey as id, c_mktsegment as stratum, lead(c_custkey) over (partition by c_mktsegment order by sha<<cast(c_custkey as string)>>, c_custkey) as following, first_value(c_custkey) over (partition by c_mktsegment order by sha<<cast(c_custkey as string)>>, c_custkey) as first_id from customer)""")
def split_distractor(t):
    """SPL17."""
    people = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    return Q.next_in_ring(people, "id", "stratum", F.sha2(F.col("id").cast("string"), 256))


@entry("window_random_first", """select question_id, response_id from (select question_id, response_id, row_number() over (partition by question_id order by sha<<concat_ws(':', '31', cast(response_id as string))>>, response_id) as rn from metrics) where rn = 1""")
def window_random_first(t):
    """WIN15."""
    return _metrics(t).groupBy("question_id").agg(F.min(F.struct(R.hash_order("31", "response_id"), "response_id")).alias("b")).select("question_id", "b.response_id")


@entry("window_snippet_frequency", """select question_id, item_key, snippets, row_number() over (partition by question_id order by snippets desc, item_key) as place from (select question_id, item_key, count(distinct response_id) as snippets from resp_sets group by question_id, item_key)""")
def window_snippet_frequency(t):
    """WIN17."""
    return Q.numbered(_said(t).withColumnRenamed("n", "snippets"), ["question_id"], F.desc("snippets"), "item_key", name="place")


@entry("agg_sorted_counts", """select event_type, n, row_number() over (order by n desc, event_type) as place from (select event_type, count(*) as n from events group by event_type)""")
def agg_sorted_counts(t):
    """AGG02."""
    n = t("events").groupBy("event_type").agg(F.count("*").alias("n"))  # one row a type
    return Q.numbered(n, [F.lit(0)], F.desc("n"), "event_type", name="place")


@entry("agg_cluster_summary", """select question_id, count(*) as clusters, max(n) as largest, cast(sum(case when n = 1 then 1 else 0 end) as bigint) as singletons from (select question_id, split_part(answer, ' ', 1) as head, count(*) as n from fused group by question_id, split_part(answer, ' ', 1)) group by question_id""")
def agg_cluster_summary(t):
    """AGG20, SET11."""
    sizes = R.pool(t("bank_rank")).groupBy("question_id", F.substring_index("answer", " ", 1).alias("head")).agg(F.count("*").alias("n"))
    return sizes.groupBy("question_id").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))


@entry("agg_truncation", """select lang, count(*) as prompts, cast(sum(case when length(text) > 2000 then 1 else 0 end) as bigint) as truncated, max(length(text)) as longest from documents group by lang""")
def agg_truncation(t):
    """AGG26."""
    return t("documents").groupBy("lang").agg(F.count("*").alias("prompts"), F.count_if(F.length("text") > 2000).alias("truncated"), F.max(F.length("text")).alias("longest"))


@entry("agg_citations", """select checkpoint, round(cast(sum(case when hit then 1 else 0 end) as double) / count(*), 9) as citation_precision, round(cast(sum(case when group_id is not null then 1 else 0 end) as double) / count(*), 9) as grounded from matched group by checkpoint""")
def agg_citations(t):
    """AGG33."""
    told = R.greedy_match(t("resp_items"), t("gold_groups"))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 9)
    return told.groupBy("checkpoint").agg(share(F.col("matched")).alias("citation_precision"), share(F.col("group_id").isNotNull()).alias("grounded"))


@entry("agg_judge_summary", """select checkpoint, class, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by checkpoint), 9) as fraction from (select checkpoint, case when hit then 'C3' when group_id is not null then 'C2' else 'C1' end as class from matched) group by checkpoint, class""")
def agg_judge_summary(t):
    """AGG34, MET14."""
    told = R.greedy_match(t("resp_items"), t("gold_groups"))
    judged = F.when(F.col("matched"), "C3").when(F.col("group_id").isNotNull(), "C2").otherwise("C1")
    n = told.groupBy("checkpoint", judged.alias("class")).agg(F.count("*").alias("n"))
    return n.join(n.groupBy("checkpoint").agg(F.sum("n").alias("all")), "checkpoint").select("checkpoint", "class", "n", F.round(F.col("n") / F.col("all"), 9).alias("fraction"))


@entry("array_layout", """select question_id, answer, concat('C', lpad(cast(row_number() over (partition by question_id order by sha<<concat_ws(':', '11', cast(question_id as string), answer)>>, answer) as string), 3, '0')) as candidate_id from pooled""")
def array_layout(t):
    """ARR14."""
    labelled = Q.numbered(R.pool(t("bank_rank")), ["question_id"], R.hash_order("11", "question_id", "answer"), "answer")
    return labelled.select("question_id", "answer", F.concat(F.lit("C"), F.lpad(F.col("rn").cast("string"), 3, "0")).alias("candidate_id"))


@entry("array_slates", """select c.question_id, c.answer as chosen, n.answer as negative, n.rk as place from fused c join gold_answer g on g.question_id = c.question_id and g.gold = c.answer join fused n on n.question_id = c.question_id and n.answer <> c.answer and n.rk <= 5""")
def array_slates(t):
    """ARR05."""
    ranked = _fused(t)
    right = ranked.join(_gold_answer(t), "question_id").where("answer = gold").select("question_id", F.col("answer").alias("chosen"))
    wrong = ranked.where("rank <= 5").select("question_id", F.col("answer").alias("negative"), F.col("rank").alias("place"))
    return right.join(wrong, "question_id").where("chosen <> negative")


@entry("pairs_siblings", """select a.question_id, a.alias_key as chosen, b.alias_key as rejected from gold_groups a join gold_groups b on a.question_id = b.question_id and a.group_id <> b.group_id where a.group_id <= 2 and b.group_id <= 2""")
def pairs_siblings(t):
    """PAR25."""
    gold = t("gold_groups").where("group_id <= 2")
    other = gold.select("question_id", F.col("alias_key").alias("rejected"), F.col("group_id").alias("other"))
    return gold.join(other, "question_id").where("group_id <> other").select("question_id", F.col("alias_key").alias("chosen"), "rejected")


@entry("pairs_reader", """select role, count(*) as n, cast(sum(case when answer is null or trim(answer) = '' then 1 else 0 end) as bigint) as incomplete from (select a.role, b.text as answer from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1) group by role""")
def pairs_reader(t):
    """PAR30."""
    turns = t("conversations")
    answers_ = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    read = turns.select("conv_id", "turn", "role").join(answers_, ["conv_id", "turn"], "left")
    return read.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull() | (F.trim("answer") == "")).alias("incomplete"))


@entry("pairs_with_notes", """select p.question_id, p.chosen_id, p.rejected_id, c.o_orderpriority as note, case when c.o_orderpriority = r.o_orderpriority then 'same' else 'different' end as agreement from pairs p join orders c on c.o_orderkey = p.chosen_id join orders r on r.o_orderkey = p.rejected_id""")
def pairs_with_notes(t):
    """PAR28."""
    notes = lambda side: t("orders").select(F.col("o_orderkey").alias(f"{side}_id"), F.col("o_orderpriority").alias(f"_{side}"))
    both = t("pairs").join(notes("chosen"), "chosen_id").join(notes("rejected"), "rejected_id")
    return both.select("question_id", "chosen_id", "rejected_id", F.col("_chosen").alias("note"), F.when(F.col("_chosen") == F.col("_rejected"), "same").otherwise("different").alias("agreement"))


@entry("pairs_wrong_bank_checks", """select question_id, count(*) as rows_in, count(distinct item_key) as surfaces, count(*) = count(distinct item_key) as unique_ok, cast(sum(case when group_id is not null then 1 else 0 end) as bigint) as gold_leaks from matched group by question_id""")
def pairs_wrong_bank_checks(t):
    """PAR13, SET12."""
    told = R.greedy_match(t("resp_items"), t("gold_groups"))
    n = told.groupBy("question_id").agg(F.count("*").alias("rows_in"), F.countDistinct("item_key").alias("surfaces"), F.count_if(F.col("group_id").isNotNull()).alias("gold_leaks"))
    return n.withColumn("unique_ok", F.col("rows_in") == F.col("surfaces"))


@entry("sft_expected", """select coalesce(e.question_id, g.question_id) as question_id, case when g.question_id is null then 'missing' when e.question_id is null then 'unexpected' else 'present' end as state from (select c_custkey as question_id from customer) e full outer join (select distinct question_id from gold_groups) g on g.question_id = e.question_id""")
def sft_expected(t):
    """SFT10."""
    actions = Q.upsert(t("customer").select(F.col("c_custkey").alias("question_id")), t("gold_groups"), ["question_id"])
    state = F.when(F.col("action") == "kept", "missing").when(F.col("action") == "inserted", "unexpected").otherwise("present")
    return actions.select("question_id", state.alias("state"))


@entry("boundary_request_grid", """select q.question_id, d.draw, b.n is not null as answered from (select distinct question_id from bank_rank) q join (select distinct draw from bank_rank) d on d.draw is not null left join (select question_id, draw, count(*) as n from bank_rank group by question_id, draw) b on b.question_id = q.question_id and b.draw = d.draw""")
def boundary_request_grid(t):
    """UDF07."""
    grid = Q.membership(t("bank_rank"), "question_id", "draw")
    return grid.withColumnRenamed("present", "answered")
