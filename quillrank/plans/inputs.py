"""Catalog entries for question data sets, model boundaries and experiment checks.

Inputs of another format (JSON documents, token scores, cached responses) are made from the driver's tables in the entry and
read by the operator; the DuckDB SQL states what has to come out of the tables directly."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import forms as M
from ..functions import responses as J
from ..functions import routing as O
from ..operators import boundary as B
from ..operators import evidence as V
from ..operators import experiments as X
from ..operators import preferences as P
from ..operators import ranking as R
from ..operators import tables as Q
from ..sources import files
from ..sources import questions as S
from .relational import Tables, _fused, _gold_answer, _metrics, _rr
from .views import for_duckdb

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def entry(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        ORACLE[name] = for_duckdb(sql)
        return f

    return add


def _folder(spark) -> str:
    """A new folder that all executors share; one of our own where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: files need a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quillrank-')}"
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def _prepared(t):
    c = t("customer")
    row = F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, " List").otherwise("factoid ").alias("type"), F.lit("Answer\n\n  it. ").alias("instruction"),
        F.concat(F.lit(" What  is "), "c_name", F.lit("?")).alias("input_1"), F.concat(F.lit("is "), "c_mktsegment").alias("input_2"), F.lit(" ").alias("input_3"), F.lit("last").alias("input_10"),
        F.concat(F.lit("[BI]"), F.lower("c_mktsegment"), F.lit("[EI][BI] x[EI]")).alias("output"))
    listed = c.groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value"))
    return S.prepared_records(listed.select(F.format_string("in/p%02d.json", "c_nationkey").alias("path"), "value"))


def _raw(t):
    group = F.array(F.upper("alias_key"), F.concat(F.lit(" "), "alias_key"), F.upper("alias_key"))
    g = t("gold_groups").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", group.alias("g")))), lambda x: x["g"]).alias("exact_answer"))
    q = F.struct(
        F.col("question_id").cast("string").alias("id"), F.when(F.col("question_id") % 5 == 0, "factoid").otherwise("List").alias("type"), F.concat(F.lit("Which of "), F.col("question_id").cast("string")).alias("body"),
        "exact_answer", F.array(F.struct(F.lit(" one ").alias("text")), F.struct(F.lit("  ").alias("text")), F.struct(F.lit("two").alias("text"))).alias("snippets"))
    listed = g.groupBy((F.col("question_id") % 7).alias("k")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(q)).alias("questions"))).alias("value"))
    return S.raw_questions(listed.select(F.format_string("in/q%02d.json", "k").alias("path"), "value"))


_P = "select cast(c_custkey as varchar) as id, case when c_custkey % 2 = 0 then 'list' else 'factoid' end as type, 'What is ' || c_name || '?' as input_1, 'is ' || c_mktsegment as r1, '[BI]' || lower(c_mktsegment) || '[EI][BI] x[EI]' as output from customer"
_G = "select question_id, cast(question_id as varchar) as id, case when question_id % 5 = 0 then 'factoid' else 'list' end as type, count(*) as n, string_agg(upper(alias_key) || '|' || alias_key, '|' order by group_id) as flat, string_agg('[BI]' || upper(alias_key) || '[EI]', '' order by group_id) as tagged from gold_groups group by question_id"


@entry("scan_prepared_records", f"select id, type, 'Answer' || chr(10) || 'it.' as instruction, input_1, r1 || '|last' as resources, output from ({_P})")
def scan_prepared_records(t):
    """SRC09, PRJ01."""
    return _prepared(t).select("id", "type", "instruction", "input_1", F.array_join("resources", "|").alias("resources"), "output")


@entry("scan_raw_questions", f"select id, type, 'Which of ' || id as body, n as n_groups, flat as aliases, 'one|two' as evidence from ({_G})")
def scan_raw_questions(t):
    """SRC10, PRJ11, PRJ13."""
    return _raw(t).select("id", "type", "body", F.size("aliases").cast("long").alias("n_groups"), F.array_join(F.flatten("aliases"), "|").alias("aliases"), F.array_join("evidence", "|").alias("evidence"))


@entry("project_flat_aliases", "select question_id, string_agg(alias_key, '|' order by group_id) as aliases from gold_groups group by question_id")
def project_flat_aliases(t):
    """PRJ13: aliases nested three deep, with repeats and blanks."""
    g = t("gold_groups").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "alias_key"))), lambda x: F.array(F.array(x["alias_key"], F.lit(" ")), F.array(x["alias_key"]))).alias("nested"))
    return g.select("question_id", F.array_join(S.flat_aliases(F.to_json("nested")), "|").alias("aliases"))


@entry("scan_list_examples", f"with e as (select id, input_1 as question, r1 || '|last' as evidence, 2 as n_gold, 0 as src from ({_P}) where type = 'list' union all select id, 'Which of ' || id, 'one|two', n, 1 from ({_G}) where type = 'list') select id, question, evidence, n_gold from (select *, row_number() over (partition by id order by src) as rn from e) where rn = 1")
def scan_list_examples(t):
    """SRC11: prepared rows stand before raw ones of the same id, by path."""
    return S.list_examples(_prepared(t), _raw(t)).select("id", "question", F.array_join("evidence", "|").alias("evidence"), F.size("gold").cast("long").alias("n_gold"))


@entry("scan_gold_outputs", f"with e as (select id, type, input_1 as body, output as gold_output, 0 as src from ({_P}) union all select id, type, 'Which of ' || id, case when type = 'list' then tagged else replace(replace(tagged, '[BI]', '[BE]'), '[EI]', '[EE]') end, 1 from ({_G})) select id, type, body, gold_output from (select *, row_number() over (partition by id order by src) as rn from e) where rn = 1")
def scan_gold_outputs(t):
    """SRC15."""
    return S.gold_outputs(_prepared(t), _raw(t))


@entry("scan_eval_examples", f"with e as (select id, type, input_1 as body, output as gold_output, 0 as src from ({_P}) union all select id, type, 'Which of ' || id, replace(replace(tagged, '[BI]', '[BE]'), '[EI]', '[EE]'), 1 from ({_G})) select id, type, body, gold_output from (select *, row_number() over (partition by id, type order by src) as rn from e where type = 'factoid') where rn = 1")
def scan_eval_examples(t):
    """SRC14: factoid examples of both formats."""
    return S.eval_examples(_prepared(t), _raw(t), ["factoid"]).select("id", "type", "body", "gold_output")


def _bank_documents(t):
    o = t("orders")
    key = F.col("o_custkey").cast("string")
    prediction = o.where("o_orderkey % 3 = 0").select(F.lit("in/first model.json").alias("path"), F.struct("o_orderkey", F.lit("List").alias("type"), key.alias("id"), F.col("o_clerk" if "o_clerk" in o.columns else "o_orderpriority").alias("prediction")).alias("r"))
    bank = o.where("o_orderkey % 3 = 1").select(F.lit("in/second.json").alias("path"), F.struct("o_orderkey", F.lit("list").alias("question_type"), key.alias("question_id"), F.lit("m9").alias("model"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("response_id"), F.lit(" raw ").alias("raw_output")).alias("r"))
    texts = [d.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("value")) for d in (prediction, bank)]
    odd = t.spark.createDataFrame([("in/empty.json", "[]"), ("in/odd.json", '[{"x": 1}]')], "path string, value string")
    return texts[0].union(texts[1]).union(odd)


@entry("scan_bank_rows", "with p as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders where o_orderkey % 3 = 0), b as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders where o_orderkey % 3 = 1) select cast(o_custkey as varchar) as question_id, n as sample_id, cast(o_custkey as varchar) || '-prediction' || cast(n as varchar) as response_id, 'first model' as generator_checkpoint from p union all select cast(o_custkey as varchar), n, 'r' || cast(o_orderkey as varchar), 'm9' from b")
def scan_bank_rows(t):
    """SRC13: prediction lists and banks, told apart by their first row."""
    return S.bank_rows(_bank_documents(t)).drop("raw_output")


@entry("scan_bank_formats", "select * from (values ('in/empty.json', 'empty'), ('in/first model.json', 'predictions'), ('in/odd.json', 'unknown'), ('in/second.json', 'candidate_bank')) v(path, format)")
def scan_bank_formats(t):
    """SRC13."""
    return S.bank_format(_bank_documents(t)).select("path", "format")


@entry("scan_evaluation_folders", "select 'c' || cast(o_orderkey % 2 as varchar) as model, cast(o_custkey as varchar) as question_id, count(*) as n, count(case when o_custkey % 4 > 0 then 1 end) as scored from orders group by 1, 2")
def scan_evaluation_folders(t):
    """SRC19."""
    o = t("orders").select(F.concat(F.lit("c"), (F.col("o_orderkey") % 2).cast("string")).alias("model"), F.col("o_custkey").cast("string").alias("question_id"), F.col("o_custkey").alias("k"))
    texts = o.groupBy("model").agg(F.to_json(F.collect_list(F.struct("question_id", F.lit("p").alias("prediction")))).alias("value"))
    scores = o.where("k % 4 > 0").select("model", "question_id", F.lit(0.5).alias("score")).distinct()
    rows = S.evaluation_folders(texts.select(F.concat(F.lit("eval/"), "model", F.lit("/predictions.json")).alias("path"), "value"), scores)
    return rows.groupBy("model", "question_id").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@entry("source_round_trips", "select f.format, n_nationkey, n_name, n_regionkey from nation cross join (values ('csv'), ('json'), ('jsonl')) f(format)")
def source_round_trips(t):
    """SRC01, SRC02, SRC03, SRC04, SRC06, SRC07: a table written and read in three formats."""
    n, folder, schema = t("nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(t.spark), "n_nationkey long, n_name string, n_regionkey long"
    files.write_jsonl(n, f"{folder}/jsonl")
    files.write_csv(n, f"{folder}/csv")
    S.write_json(n, f"{folder}/n.json")
    read = {"jsonl": files.read_jsonl(t.spark, f"{folder}/jsonl", schema), "csv": files.read_csv(t.spark, f"{folder}/csv", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema)), "json": files.read_json_list(t.spark, f"{folder}/n.json", schema)}
    out = None
    for name, df in read.items():
        df = df.select(F.lit(name).alias("format"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
        out = df if out is None else out.union(df)
    return out


@entry("snapshot_manifest", "select count(*) as rows, 'c_custkey|c_name|c_nationkey' as columns from customer")
def snapshot_manifest(t):
    """SRC24: a table without its private columns, as stored and read back."""
    c = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return S.snapshot(c, f"{_folder(t.spark)}/customers", ["c_mktsegment"]).select("rows", "columns")


@entry("route_variants", "select p_partkey, case p_partkey % 5 when 0 then 'reject' when 4 then 'verify' else 'accept' end as decision, case p_partkey % 5 when 0 then 'duplicates_official_alias' when 1 then 'deterministic_terminal_or_trademark_formatting' when 2 then 'deterministic_numeric_expression' when 3 then 'explicit_parenthetical_abbreviation_in_snippets' else 'requires_semantic_verification' end as route from part")
def route_variants(t):
    """STR43, STR42: repeats, formatting, numbers, abbreviations of the snippets, and what needs a model."""
    n, k, size = F.col("p_name"), F.col("p_partkey") % 5, F.col("p_size").cast("string")
    answer = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(n, F.lit("&trade; ."))).when(k == 2, F.concat(F.lit("at least "), size, F.lit(",000 mg"))).when(k == 3, F.lit("A.B(1)")).otherwise(F.concat(n, F.lit(" too")))
    alias = F.when(k == 1, F.concat(n, F.lit(" TM"))).when(k == 2, F.concat(F.lit("≥"), size, F.lit("000mg"))).otherwise(n)
    relation = F.when(k == 1, "harmless_formatting").when(k == 2, "numerically_equivalent").when(k == 3, "abbreviation_expansion").otherwise("synonym")
    rows = t("part").select("p_partkey", O.unescaped(answer).alias("answer"), relation.alias("relation"), F.array(alias).alias("aliases"), F.array(F.concat(F.lit("the "), F.upper(n), F.lit(" ( a.b(1) ) is"))).alias("snippets"))
    return rows.select("p_partkey", O.local_decision(F.col("answer"), F.col("relation"), F.col("aliases"), F.col("snippets")).alias("d")).select("p_partkey", "d.decision", "d.route")


_BAND = "select p_partkey, p_size / 50e0 as s, (p_partkey % 11) / 10e0 as f, (p_partkey % 7) / 6e0 as c, p_partkey % 13 = 0 as rule, p_partkey % 3 = 0 as unasked from part"


@entry("label_hybrid", f"with r as ({_BAND}) select p_partkey, case when rule then true when s >= 0.9e0 then true when s <= 0.5e0 then false when unasked then false when f >= 0.8e0 and c < 0.5e0 then true else false end as matched, case when rule then 'exact_normalized' when s >= 0.9e0 then 'biomedical_embedding_match' when s <= 0.5e0 then 'biomedical_embedding_low_similarity_no_match' when unasked and s >= 0.82e0 then 'biomedical_embedding_ambiguous' when unasked then 'biomedical_embedding_review_band' when f >= 0.8e0 and c < 0.5e0 then 'nli_equivalence_match' when f >= 0.6e0 then 'nli_equivalence_ambiguous' when c >= 0.8e0 then 'nli_contradiction_no_match' else 'nli_no_match' end as match_type from r")
def label_hybrid(t):
    """STR38: rules, then cached similarity, then cached entailment of both directions."""
    k = F.col("p_partkey")
    scores = [F.col("p_size") / 50.0, (k % 11) / 10.0, (k % 7) / 6.0]
    label = B.hybrid_label(F.when(k % 13 == 0, "exact_normalized"), scores[0], F.when(k % 3 > 0, scores[1]), F.when(k % 3 > 0, F.lit(1.0)), F.when(k % 3 > 0, scores[2]))
    return t("part").select("p_partkey", label.alias("l")).select("p_partkey", "l.matched", "l.match_type")


@entry("pairs_hybrid_edits", "with a as (select distinct question_id from gold_groups where alias_key = 'brand#11'), s as (select distinct i.question_id, response_id, case when item_key like 'brand#1%' and a.question_id is not null then 'brand#11' else item_key end as item_key from resp_items i left join a on a.question_id = i.question_id), l as (select s.*, g.group_id from s left join gold_groups g on g.question_id = s.question_id and g.alias_key = s.item_key), c as (select question_id, response_id, count(*) as n_pred, count(distinct group_id) as tp from l group by question_id, response_id), w as (select l.question_id, response_id, item_key as removed, count(*) over (partition by l.question_id, item_key) as times from l where group_id is null), e as (select w.question_id, w.response_id, removed, times, round(2e0 * tp / (n_pred - 1 + n_gold) - 2e0 * tp / (n_pred + n_gold), 9) as gain from w join c on c.question_id = w.question_id and c.response_id = w.response_id join gold_size z on z.question_id = w.question_id where n_pred > 1) select * from (select *, row_number() over (partition by question_id order by times desc, gain desc, removed, response_id) as pair_rank from e where gain > 0) where pair_rank <= 5")
def pairs_hybrid_edits(t):
    """PAR08: set edits under another predicate, here one that takes every brand#1x for brand#11."""
    items, gold = t("resp_items"), t("gold_groups")
    equal = items.where("item_key like 'brand#1%'").select("question_id", "item_key", F.lit("brand#11").alias("alias_key")).distinct()
    return P.negative_addition(B.matched_items(items, gold, equal), gold)


@entry("boundary_cached", "select conv_id, turn, case when conv_id % 3 = 0 then 'cache' else 'pending' end as origin, case when conv_id % 3 = 0 then 'len ' || cast(length(text) as varchar) end as response from conversations")
def boundary_cached(t):
    """SRC28, UDF05: requests by hash against cached responses; what is missing stays pending without a caller."""
    sha = B.request_hash(F.col("conv_id"), F.col("turn"), F.col("text"))
    requests = t("conversations").select("conv_id", "turn", F.col("text").alias("payload"), sha.alias("request_sha256"))
    cache = t("conversations").where("conv_id % 3 = 0").select(sha.alias("request_sha256"), F.concat(F.lit("len "), F.length("text").cast("string")).alias("response"))
    return B.cached_or_called(requests, cache).select("conv_id", "turn", "origin", "response")


@entry("boundary_called", "select conv_id, turn, case when conv_id % 3 = 0 then 'cache' else 'call' end as origin, case when conv_id % 3 = 0 then 'known' else 'len ' || cast(length(text) as varchar) end as response from conversations where text is not null")
def boundary_called(t):
    """SRC28, UDF05: with a function for the missing ones, called once a distinct request."""
    def call(batches):
        for batch in batches:
            yield batch.assign(response="len " + batch["payload"].str.len().astype(str))[["request_sha256", "response"]]

    rows = t("conversations").where("text is not null")
    requests = rows.select("conv_id", "turn", F.col("text").alias("payload"), B.request_hash(F.col("conv_id") % 3 == 0, F.col("text")).alias("request_sha256"))
    cache = requests.where("conv_id % 3 = 0").select("request_sha256", F.lit("known").alias("response")).distinct()
    return B.cached_or_called(requests, cache, call, budget=1 << 30).select("conv_id", "turn", "origin", "response")


@entry("score_log_probs", "select p_partkey, greatest(0, p_size - greatest(0, 40 - p_partkey % 6 - 1)) as dropped, p_partkey % 6 + 1 as tokens, round(-0.5e0 * (p_partkey % 6 + 1), 9) as total, -0.5e0 as mean from part")
def score_log_probs(t):
    """UDF08: prompts cut from the left to 40 ids, and the log-probabilities of what follows them."""
    answer = F.array_repeat(F.lit(7), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = t("part").select("p_partkey", B.left_truncated(F.sequence(F.lit(1), F.col("p_size").cast("int")), answer, 40).alias("s"))
    scores = F.transform("s.ids", lambda x, i: F.when(x == 7, F.when(i >= F.col("s.prompt_length"), -0.5).otherwise(-9.0)).otherwise(-9.0))
    told = rows.select("p_partkey", "s.dropped", B.log_probs(scores, F.col("s.prompt_length")).alias("l"))
    return told.select("p_partkey", "dropped", "l.tokens", F.round("l.total", 9).alias("total"), "l.mean")


@entry("rerank_logits", "select question_id, answer, row_number() over (partition by question_id order by case when votes > 1 then votes - best_rank end desc nulls last, rk) as reranker_rank from fused")
def rerank_logits(t):
    """UDF10: cached yes and no scores of some candidates; the others keep their order behind them."""
    ranked = _fused(t)
    logits = ranked.where("votes > 1").select("question_id", "answer", F.col("votes").cast("double").alias("yes"), F.col("best_rank").cast("double").alias("no"))
    return B.reranked(ranked, logits, "question_id", "answer", ["rank"]).select("question_id", "answer", "reranker_rank")


@entry("audit_arms", "with b as (select distinct question_id, model, draw from bank_rank), a as (select question_id, model, count(*) as n, min(draw) as lo, max(draw) as hi from b where model <> 'm2' group by question_id, model), q as (select distinct question_id from a), x as (select q.question_id, m.arm from q cross join (values ('m0'), ('m1')) m(arm)) select 'question_missing' as problem, arm, x.question_id as question from x where not exists (select 1 from a where a.question_id = x.question_id and a.model = x.arm) union all select 'draws_incomplete', model, question_id from a where n <> 7 or lo <> 1 or hi <> 7 union all select 'unknown_arm', 'm2', null where exists (select 1 from b where model = 'm2')")
def audit_arms(t):
    """ORC12: two declared arms of seven draws each, and one that nobody declared."""
    rows = t("bank_rank").select("question_id", "model", "draw").distinct()
    return X.arm_problems(rows, "model", "question_id", "draw", {"m0": 7, "m1": 7}, F.lit("same"))


@entry("audit_settings", "select 'draws' as field, '2|3' as values from (select 1) union all select 'seed', '1|null'")
def audit_settings(t):
    """ORC12: settings that arms must share."""
    configs = t.spark.createDataFrame([("a", 1, 2, "x"), ("b", None, 3, "x")], "arm string, seed long, draws long, loader string")
    return X.setting_problems(configs, "arm", ["seed", "draws", "loader"]).withColumn("values", F.array_join("values", "|"))


@entry("audit_rescored", "select question_id, response_id, round(f1, 9) as rescored, response_id % 17 = 0 and f1 <> 0 as changed from metrics")
def audit_rescored(t):
    """ORC09: frozen responses scored again; every seventeenth recorded score was damaged."""
    frozen = _metrics(t).withColumn("recorded", F.when(F.col("response_id") % 17 == 0, 0.0).otherwise(F.col("f1")))
    return X.rescored(frozen, ["question_id", "response_id"], "recorded", F.col("f1")).select("question_id", "response_id", F.round("rescored", 9).alias("rescored"), "changed")


@entry("report_misses", "with j as (select f.question_id, rk, round(rank_vote, 9) as score, answer = gold as ok from fused f join gold_answer g on g.question_id = f.question_id), b as (select question_id, min(case when ok then rk end) as best, max(case when rk = 2 then score end) as kth from j group by question_id) select b.question_id, best as best_rank, round(kth - j.score, 6) as score_gap from b join j on j.question_id = b.question_id and j.rk = b.best where best > 2")
def report_misses(t):
    """ORC11: pools that hold the right answer below their first two."""
    ranked = _fused(t).join(_gold_answer(t), "question_id").withColumn("rank_vote", F.round("rank_vote", 9))
    return X.selection_misses(ranked, "question_id", "rank", "rank_vote", F.col("answer") == F.col("gold"), 2).withColumn("score_gap", F.round("score_gap", 6))


@entry("report_changed", "with a as (select question_id, min(answer) as x from bank_rank where model = 'm0' group by question_id), b as (select question_id, min(answer) as x from bank_rank where model = 'm1' group by question_id) select a.question_id, a.x as before, b.x as after from a join b on a.question_id = b.question_id where a.x is distinct from b.x")
def report_changed(t):
    """ORC11: first answers that two runs give differently."""
    first = lambda m: t("bank_rank").where(F.col("model") == m).groupBy("question_id").agg(F.min("answer").alias("x"))
    return X.changed_cases(first("m0"), first("m1"), "question_id", "x")


@entry("metric_official_types", "with e as (select value > 50 as g, event_id % 3 <> 0 as p from events), y as (select avg(case when g = p then 1e0 else 0e0 end) as accuracy, 2e0 * count(case when g and p then 1 end) / (count(case when g then 1 end) + count(case when p then 1 end)) as f1_yes, 2e0 * count(case when not g and not p then 1 end) / (count(case when not g then 1 end) + count(case when not p then 1 end)) as f1_no from e), f as (select avg(case when first_rank = 1 then 1e0 else 0e0 end) as strict, avg(case when first_rank <= 5 then 1e0 else 0e0 end) as lenient, avg(case when first_rank <= 5 then 1e0 / first_rank else 0e0 end) as mrr from rr), l as (select avg(p) as precision, avg(r) as recall, avg(f1) as f1 from metrics) select round(accuracy, 6) as accuracy, round(f1_yes, 6) as f1_yes, round(f1_no, 6) as f1_no, round((f1_yes + f1_no) / 2, 6) as macro_f1, round(strict, 6) as strict, round(lenient, 6) as lenient, round(mrr, 6) as mrr, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from y cross join f cross join l")
def metric_official_types(t):
    """SRC27, MET09: the scorer's figures for yes/no, factoid and list questions."""
    says = lambda c: F.when(c, "yes").otherwise("no")
    yes_no = t("events").select(says(F.col("value") > 50).alias("gold"), says(F.col("event_id") % 3 != 0).alias("predicted"))
    s = X.official_scores(yes_no, _rr(t).select("first_rank"), _metrics(t).select("p", "r", "f1"))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@entry("evidence_eligible", "with p as (select question_id, group_id as alias_id, question_id % 4 as k from gold_groups) select question_id, alias_id, concat_ws('|', case when k = 0 then 'unreviewed' end, case when k = 1 and alias_id = 1 then 'input_changed' end, case when k > 0 and alias_id = 2 then 'answer_not_accepted' end, case when k = 2 then 'reviewer_missing' end) as reasons, not (k = 0 or (k = 1 and alias_id = 1) or alias_id = 2 or k = 2) as eligible from p")
def evidence_eligible(t):
    """SFT07: packets against decisions on older input, on refused answers, without a reviewer, and none."""
    g = t("gold_groups").select("question_id", F.col("group_id").alias("alias_id"), (F.col("question_id") % 4).alias("k"))
    packets = g.select("question_id", "alias_id", F.lit("s1").alias("input_sha256"))
    decisions = g.where("k > 0").select(
        "question_id", "alias_id", F.when((F.col("k") == 1) & (F.col("alias_id") == 1), "s0").otherwise("s1").alias("input_sha256"), F.when(F.col("k") == 2, "human").otherwise("model").alias("origin"),
        F.when(F.col("alias_id") == 2, "refused").otherwise("accepted").alias("answer_status"), F.lit("supported").alias("evidence_status"), F.lit(None).cast("string").alias("reviewer"))
    return X.eligible_aliases(packets, decisions).select("question_id", "alias_id", F.array_join("exclusion_reasons", "|").alias("reasons"), "eligible")


@entry("evidence_answer_documents", "with d as (select question_id, response_id, string_agg(item_key, ' ' order by item_key) as doc, list(replace(item_key, '#', ' ')) as keys from resp_sets group by question_id, response_id), h as (select d.question_id, doc, row_number() over (partition by d.question_id order by d.response_id) as rn from d where exists (select 1 from gold_groups g where g.question_id = d.question_id and contains(replace(d.doc, '#', ' '), replace(g.alias_key, '#', ' ')))) select question_id, string_agg(doc, '|' order by rn) as documents from h where rn <= 2 group by question_id")
def evidence_answer_documents(t):
    """SFT03: the first two texts of a question that hold any of its aliases."""
    texts = t("resp_items").groupBy("question_id", "response_id").agg(F.array_join(F.array_sort(F.collect_set("item_key")), " ").alias("doc"))
    texts = texts.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("response_id", "doc"))), lambda x: x["doc"]).alias("docs"))
    gold = t("gold_groups").groupBy("question_id").agg(F.collect_set("alias_key").alias("aliases"))
    found = texts.join(gold, "question_id").select("question_id", V.answer_documents(F.col("docs"), F.col("aliases"), 2).alias("d"))
    return found.where(F.size("d") > 0).select("question_id", F.array_join("d", "|").alias("documents"))


@entry("evidence_occurrences", "select g.question_id, alias_key as alias, s.checkpoint as snippet_id, contains(' ' || replace(s.t, '#', ' ') || ' ', ' ' || replace(alias_key, '#', ' ') || ' ') as hit from gold_groups g join (select question_id, checkpoint, string_agg(distinct item_key, ' ' order by item_key) as t from resp_items group by question_id, checkpoint) s on s.question_id = g.question_id")
def evidence_occurrences(t):
    """SFT06: each alias against each snippet of its question."""
    texts = t("resp_items").groupBy("question_id", F.col("checkpoint").alias("snippet_id")).agg(F.array_join(F.array_sort(F.collect_set("item_key")), " ").alias("text"))
    snippets = texts.groupBy("question_id").agg(F.collect_list(F.struct("snippet_id", "text")).alias("snippets"))
    gold = t("gold_groups").groupBy("question_id").agg(F.collect_set("alias_key").alias("aliases"))
    return V.occurrence_labels(gold.join(snippets, "question_id"), "question_id", "aliases", "snippets").drop("reason")


@entry("evidence_serialized", "select conv_id, count(*) as n, string_agg('S' || cast(rn as varchar) || ' ' || txt, '|' order by rn) as snippets from (select conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as txt, row_number() over (partition by conv_id order by turn) as rn from conversations where trim(coalesce(text, '')) <> '') group by conv_id")
def evidence_serialized(t):
    """PRJ03, STR29: snippets written with marks under a header, and read back."""
    rows = t("conversations").where("trim(coalesce(text, '')) <> ''")
    s = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), F.lit("abstract").alias("begin"), F.lit(None).cast("string").alias("end")))
    told = rows.groupBy("conv_id").agg(V.serialized(F.lit("Document"), s, 1 << 30).alias("t"))
    back = told.select("conv_id", V.snippets_of(F.col("t")).alias("s"))
    return back.select("conv_id", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: F.concat(x["snippet_id"], F.lit(" "), x["text"])), "|").alias("snippets"))


@entry("evidence_document_numbers", "select doc_id, case when doc_id % 3 = 0 then null else cast(doc_id as varchar) end as number from documents")
def evidence_document_numbers(t):
    """PRJ02: numbers that end an address, with a slash or without."""
    url = F.when(F.col("doc_id") % 3 == 0, "http://x/none").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("http://x/9/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"), F.lit("/")))
    return t("documents").select("doc_id", V.document_number(url).alias("number"))


@entry("prompt_marks", "select p_partkey, '[1] ' || substr(p_name, 1, 2) || '[2] ' || substr(p_name, 3) as marked, case when p_partkey % 2 = 0 then 'Q ' || p_name || ' R' || chr(10) || 'Answer: x' else p_name || chr(10) || 'R' end as reminded from part")
def prompt_marks(t):
    """PRJ18, PRJ19: numbered marks put in from the end, and a reminder before the last marker."""
    n = F.col("p_name")
    mark = lambda offset, k: F.struct(F.lit(offset).alias("offset"), F.lit(k).alias("n"))
    prompt = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Q "), n, F.lit(" Answer: x"))).otherwise(n)
    return t("part").select("p_partkey", V.numbered(n, F.array(mark(0, 1), mark(2, 2))).alias("marked"), V.with_reminder(prompt, "R").alias("reminded"))


@entry("filter_extractive", "select p_partkey, p_partkey % 2 = 0 as extractive from part")
def filter_extractive(t):
    """FLT12: whether a name stands in the resource section of a prompt, or only in its question."""
    n = F.col("p_name")
    prompt = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Q? PubMed resources: the "), F.upper(n), F.lit(". Answer: none"))).otherwise(F.concat(F.lit("Is it "), n, F.lit("? PubMed resources: no. Answer: "), n))
    return t("part").select("p_partkey", V.in_prompt(n, prompt).alias("extractive"))


@entry("array_ordered_subset", "with k as (select question_id, string_agg(distinct item_key, '|' order by item_key) as a from resp_items where checkpoint = 'c0' group by question_id), x as (select question_id, item_key, checkpoint from resp_items group by question_id, item_key, checkpoint) select k.question_id, not exists (select 1 from x where x.question_id = k.question_id and x.checkpoint = 'c0' and not exists (select 1 from x y where y.question_id = x.question_id and y.checkpoint = 'c1' and y.item_key = x.item_key)) as subset from k")
def array_ordered_subset(t):
    """ARR06: whether the sorted items of one checkpoint stand in those of the other, in order."""
    items = lambda c, name: t("resp_items").where(F.col("checkpoint") == c).groupBy("question_id").agg(F.array_sort(F.collect_set("item_key")).alias(name))
    both = items("c0", "a").join(items("c1", "b"), "question_id", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    return both.select("question_id", J.ordered_subset(F.col("a"), F.col("b")).alias("subset"))


@entry("filter_numeric_holds", "select p_partkey, case p_partkey % 4 when 0 then '' when 1 then 'value_or_bound_differs' when 2 then 'approximation_not_established' else '' end as holds from part")
def filter_numeric_holds(t):
    """FLT18: equal quantities, another value, an approximation, and a question that asks for none."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    answer = F.concat(F.when(k == 2, "about ").otherwise(""), F.when(k == 1, size + 1000).otherwise(size).cast("string"), F.lit(" days"))
    question = F.when(k == 3, "Which one?").otherwise("How many days?")
    rows = t("part").select("p_partkey", question.alias("q"), answer.alias("a"), F.concat(size.cast("string"), F.lit(" days")).alias("g"))
    quantity = lambda c: F.struct(F.col(c).alias("text"), M.number_values(F.col(c)).alias("numbers"))
    told = rows.select("p_partkey", "q", quantity("a").alias("a"), F.array(quantity("g")).alias("g"))
    return told.select("p_partkey", F.array_join(M.numeric_holds(F.col("a"), F.col("q"), F.col("g")), "|").alias("holds"))


@entry("judge_verdicts", "select conv_id, turn, case conv_id % 5 when 0 then 'pending' when 1 then 'not_json' when 2 then 'unknown_evidence' when 3 then 'no_evidence' end as problem, case when conv_id % 5 = 2 or conv_id % 5 = 3 or conv_id % 5 = 4 then 'supported' end as verdict from conversations")
def judge_verdicts(t):
    """UDF03, UDF04: cached answers of a judge, of which some are missing, broken, or cite nothing that was shown."""
    k = F.col("conv_id") % 5
    cited = F.when(k == 2, '["S9"]').when(k == 3, "[]").otherwise('["S1"]')
    answer = F.when(k == 0, None).when(k == 1, "no json").otherwise(F.concat(F.lit('{"verdict": "supported", "equivalence": "equivalent", "evidence": '), cited, F.lit("}")))
    rows = t("conversations").select("conv_id", "turn", answer.cast("string").alias("response"), F.array(F.lit("S1"), F.lit("S2")).alias("ids"))
    return B.judged(rows, "response", "ids").select("conv_id", "turn", "problem", "verdict")


@entry("pairs_annotated_tasks", "with p as (select question_id, chosen_id, rejected_id, case when chosen_id % 3 = 0 then 'why ' || cast(rejected_id as varchar) end as why from pairs), r as (select *, 'answer' as task, '' as source, cast(chosen_id as varchar) as target from p union all select *, 'judge', cast(chosen_id as varchar), 'right' from p union all select *, 'judge', cast(rejected_id as varchar), 'wrong' from p union all select *, 'explain', cast(rejected_id as varchar), why from p where why is not null) select question_id, chosen_id, rejected_id, case when why is null then 'missing' else 'annotated' end as origin, task, source, target from r")
def pairs_annotated_tasks(t):
    """PAR27, UDF02: rationales of some pairs, and the training rows that follow."""
    pairs = t("pairs").select("question_id", "chosen_id", "rejected_id")
    notes = pairs.select("chosen_id", "rejected_id", F.when(F.col("chosen_id") % 3 == 0, F.concat(F.lit("why "), F.col("rejected_id").cast("string"))).otherwise(" ").alias("rationale")).distinct()
    rows = B.multitask_rows(B.annotated(pairs, notes), "chosen_id", "rejected_id", "rationale")
    return rows.select("question_id", "chosen_id", "rejected_id", "origin", "task", "source", "target")


@entry("sft_formulations", "with g as (select question_id, string_agg(alias_key, '|' order by group_id) as every, min(case when group_id = 1 then alias_key end) as one from gold_groups group by question_id) select question_id, 'original' as formulation, one as targets from g union all select question_id, 'expansion', every from g")
def sft_formulations(t):
    """SFT11."""
    gold = t("gold_groups").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "alias_key"))), lambda x: x["alias_key"]).alias("answers"))
    return V.formulations(gold, "question_id", "answers").withColumn("targets", F.array_join("targets", "|"))


@entry("evidence_packets", "with s as (select question_id, checkpoint, ' ' || replace(string_agg(distinct item_key, ' ' order by item_key), '#', ' ') || ' ' as t from resp_items group by question_id, checkpoint), g as (select question_id, count(*) as n from gold_groups group by question_id) select g.question_id, n as aliases, (select count(*) from s where s.question_id = g.question_id) as snippets, coalesce((select string_agg(checkpoint, '|' order by checkpoint) from s where s.question_id = g.question_id and exists (select 1 from gold_groups a where a.question_id = g.question_id and contains(s.t, replace(a.alias_key, '#', ' ')))), '') as shown_in from g")
def evidence_packets(t):
    """SFT08: what a judge would see of each question."""
    texts = t("resp_items").groupBy("question_id", F.col("checkpoint").alias("snippet_id")).agg(F.array_join(F.array_sort(F.collect_set("item_key")), " ").alias("text"))
    gold = t("gold_groups").groupBy("question_id").agg(F.collect_set("alias_key").alias("aliases"))
    p = V.packets(gold, texts, "question_id", "aliases")
    return p.select("question_id", F.size("aliases").cast("long").alias("aliases"), F.size("snippets").cast("long").alias("snippets"), F.array_join("shown_in", "|").alias("shown_in"))


@entry("bank_recovered", "with l as (select o_custkey as question_id, max(o_orderkey) as value from orders group by o_custkey), e as (select c_custkey as question_id from customer where c_custkey % 10 <> 1) select coalesce(e.question_id, l.question_id) as question_id, value, case when e.question_id is null then 'unexpected' when value is null then 'missing' else 'present' end as state from e full outer join l on l.question_id = e.question_id")
def bank_recovered(t):
    """ORC14: the last row of each key over the shards of a journal, against what was planned."""
    shards = t("orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("value"))
    planned = t("customer").where("c_custkey % 10 <> 1").select(F.col("c_custkey").alias("question_id"))
    return V.recovered(planned, shards, "question_id", "value", "value")


@entry("report_markdown", "with n as (select n_regionkey as r, count(*) as n from nation group by 1) select '## Nations' || chr(10) || chr(10) || '| region | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || cast(r as varchar) || ' | ' || cast(n as varchar) || ' |', chr(10) order by r) || chr(10) as text from n")
def report_markdown(t):
    """ARR16: a report of one row a region."""
    n = t("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return t.spark.createDataFrame([(X.markdown("Nations", n, ["region", "n"], ["region"]),)], "text string")


@entry("archive_members", "select n from (values ('a/one.txt'), ('two.txt')) v(n)")
def archive_members(t):
    """SRC25: small outputs of the driver in an archive."""
    import os

    with tempfile.TemporaryDirectory() as folder:
        os.makedirs(f"{folder}/in/a")
        for name in ("two.txt", "a/one.txt"):
            with open(f"{folder}/in/{name}", "w", encoding="utf-8") as f:
                f.write(name)
        names = S.archive(f"{folder}/in", f"{folder}/out.tar.gz")
    return t.spark.createDataFrame([(n,) for n in names], "n string")
