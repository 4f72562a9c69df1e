"""Catalog entries for answer forms, spans, equivalence, evidence, constructed pairs and learned selection.

The DuckDB SQL of an entry is a second formulation; entries without SQL are held against brute force in the tests."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import equivalence as E
from ..functions import forms as M
from ..functions import parsing as A
from ..functions import prompts as C
from ..functions import responses as J
from ..functions import spans as S
from ..functions.text import clean_text, loose_key, serialize_items
from ..operators import evidence as V
from ..operators import learned as L
from ..operators import preferences as P
from ..operators import ranking as R
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select * from {name}")


def _short(c: str) -> str:
    letters = f"length(regexp_replace({c}, '\\P{{L}}', '', 'g'))"
    return rf"(length({c}) <= 24 and len(string_split({c}, ' ')) <= 3 and regexp_matches({c}, '^[\p{{L}}\p{{N}}_+./−–-]+(?: [IVX0-9]+)?$') and {letters} > 0 and length(regexp_replace({c}, '\P{{Lu}}', '', 'g')) >= 0.6e0 * {letters})"


@entry("forms_classify", rf"with t as (select p_partkey, v.k, case v.k when 0 then p_brand when 1 then p_name when 2 then p_name || ' (' || upper(substr(p_name, 1, 2)) || '1)' when 3 then cast(p_size as varchar) || ' months' when 4 then p_name || ' is required' else '' end as s from part cross join (values (0), (1), (2), (3), (4), (5)) v(k)) select p_partkey, k, case when s = '' then 'other' when regexp_matches(s, '^\d[\d.,]*(\s*months?)?$') then 'numerical_expression' when not {_short('s')} and regexp_matches(s, '\b(is|are|required)\b') then 'descriptive_phrase' when k = 2 then 'combined_form' when {_short('s')} then 'abbreviation' else 'full_name' end as form from t")
def forms_classify(spark, sf_dir):
    """STR32, STR39: names, symbols, both, quantities, sentences and empty texts made of each part."""
    name, brand = F.col("p_name"), F.col("p_brand")
    made = F.array(brand, name, F.concat(name, F.lit(" ("), F.upper(F.substring(name, 1, 2)), F.lit("1)")), F.concat(F.col("p_size").cast("string"), F.lit(" months")), F.concat(name, F.lit(" is required")), F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(made).alias("k", "s"))
    return rows.select("p_partkey", "k", M.classify(F.col("s"))["form"].alias("form"))


_COUNT = lambda x: f"(length(text) - length(replace(text, '{x}', '')))"


@entry("forms_list_like", f"select doc_id, {_COUNT(';')} >= 2 or {_COUNT(',')} >= 3 or ({_COUNT(',')} >= 2 and regexp_matches(text, '(?i)\\b(?:and|or)\\b')) as list_like from documents")
def forms_list_like(spark, sf_dir):
    """FLT17."""
    return table(spark, sf_dir, "documents").select("doc_id", M.list_like(F.col("text")).alias("list_like"))


_CUE = " or ".join(f"contains(' ' || lower(s) || ' ', '{c}')" for c in M.CUES)


@entry("forms_entity_like", rf"with t as (select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from benchmark), w as (select *, case when s = '' then 0 else len(string_split(s, ' ')) end as n from t) select item_id, s <> '' and length(s) <= 120 and n <= 14 and not (n > 4 and (regexp_matches(s, '[.;:]$') or {_CUE})) as entity_like from w")
def forms_entity_like(spark, sf_dir):
    """FLT06."""
    return table(spark, sf_dir, "benchmark").select("item_id", M.entity_like(F.col("text"), 120, 14).alias("entity_like"))


@entry("forms_variants", "with s as (select p_partkey, replace(p_name, ' ', '-') || case when p_size % 2 = 0 then '.' else '' end as s from part) select p_partkey, case when s like '%.' then left(s, length(s) - 1) else s || '.' end as text, case when s like '%.' then 'remove' else 'add' end || '_terminal_period' as operation from s union all select p_partkey, replace(s, '-', ' ') as text, 'hyphen_to_space' as operation from s where s like '%-%'")
def forms_variants(spark, sf_dir):
    """STR30."""
    s = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 2 == 0, ".").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(M.surface_variants(s)))


@entry("forms_relation", "select p_partkey, case when v.k = 0 then 'harmless_formatting' when v.k = 1 then 'abbreviation_expansion' else 'synonym' end as relation, v.k from part cross join (values (0), (1), (2)) v(k)")
def forms_relation(spark, sf_dir):
    """STR33, STR40: a name against its hyphenated, abbreviated and other form."""
    name = F.col("p_name")
    other = F.array(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.upper(M.initials(name)), F.concat(name, F.lit(" x")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.posexplode(other).alias("k", "alias"))
    return rows.select("p_partkey", "k", M.infer_relation(F.col("p_name"), F.col("alias")).alias("relation"))


@entry("numbers_parse")
def numbers_parse(spark, sf_dir):
    """STR41, STR42: numbers, bound and units of every benchmark text."""
    c = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(M.number_values(c), "|").alias("numbers"), M.bound(c).alias("bound"), F.array_join(M.units(c), "|").alias("units"))


@entry("spans_mine")
def spans_mine(spark, sf_dir):
    """STR13-STR19, FLT07, PAR15: spans around every place of each document's second and third word."""
    gold = F.regexp_extract("text", r"^\S+\s+(\S+\s+\S+)", 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", gold.alias("gold"))
    return rows.select("doc_id", "gold", F.inline(S.mined(F.col("text"), F.col("gold"))))


@entry("equivalence_levels")
def equivalence_levels(spark, sf_dir):
    """STR03, STR33-STR37, JON20: answers of a question against its gold groups, by the variants that they share."""
    # a profile is made once a distinct surface; the hash join below is on (question, variant)
    answers = E.with_profiles(view(spark, sf_dir, "resp_sets").select("item_key").distinct(), "item_key")
    aliases = E.with_profiles(view(spark, sf_dir, "gold_groups").select("alias_key").distinct(), "alias_key")
    left = view(spark, sf_dir, "resp_sets").select("question_id", "item_key").distinct().join(answers, "item_key")
    right = view(spark, sf_dir, "gold_groups").select("question_id", "alias_key").join(aliases, "alias_key")
    return E.equivalences(left, right, ["question_id"], "item_key", "alias_key")


_KEYED = "select question_id, answer as x, trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) as c, trim(regexp_replace(lower(split_part(answer, ' ', 1)), '[^a-z0-9]+', ' ', 'g')) as r from fused"


@entry("filter_containment", f"with k as ({_KEYED}), p as (select a.question_id, a.x, b.x as y, a.c, b.r from k a join k b on a.question_id = b.question_id and a.x <> b.x) select question_id, x, y, case when c = r then 'exact' when contains(' ' || c || ' ', ' ' || r || ' ') then 'chosen_contains' else 'rejected_contains' end as direction from p where contains(' ' || c || ' ', ' ' || r || ' ') or contains(' ' || r || ' ', ' ' || c || ' ')")
def filter_containment(spark, sf_dir):
    """FLT11, STR22, STR25, STR26: all answers of a question against the first words of all others; pairs meet on shared words."""
    f = view(spark, sf_dir, "fused").select("question_id", F.col("answer").alias("x"))
    left, right = f.withColumn("c", loose_key(F.col("x"))), f.select("question_id", F.col("x").alias("y"), loose_key(F.split("x", " ")[0]).alias("r"))
    return S.containing_pairs(left, right, ["question_id"], "c", "r").where("x <> y").select("question_id", "x", "y", S.containment(F.col("c"), F.col("r"), F.lit("")).alias("direction"))


@entry("evidence_coverage", "with t as (select question_id, response_id, string_agg(item_key, ' ' order by item_key) as joined from resp_sets group by question_id, response_id), g as (select question_id, replace(alias_key, '#', ' ') as alias from gold_groups) select t.question_id, t.response_id, round(avg(case when contains(replace(joined, '#', ' '), alias) then cast(1 as double) else 0 end), 9) as coverage from t join g on g.question_id = t.question_id group by t.question_id, t.response_id")
def evidence_coverage(spark, sf_dir):
    """FLT10, FLT09, SFT02: share of gold groups that a response's text shows, by substring."""
    texts = view(spark, sf_dir, "resp_sets").groupBy("question_id", "response_id").agg(F.array_sort(F.collect_list("item_key")).alias("texts"))
    groups = view(spark, sf_dir, "gold_groups").groupBy("question_id").agg(F.collect_list(F.array("alias_key")).alias("groups"))
    return texts.join(groups, "question_id").select("question_id", "response_id", F.round(V.gold_coverage(F.col("groups"), F.col("texts")), 9).alias("coverage"))


@entry("evidence_by_document", "select conv_id, role, row_number() over (partition by conv_id order by min(turn), role) as place, count(*) as n, string_agg(text, chr(10) order by turn, text) as joined from conversations where text is not null and role is not null group by conv_id, role")
def evidence_by_document(spark, sf_dir):
    """PRJ04, PRJ05: texts by origin in order of first mention."""
    rows = table(spark, sf_dir, "conversations").where("text is not null and role is not null")
    out = V.by_document(rows, "conv_id", "role", "text", "turn")
    return out.select("conv_id", "role", "place", F.size("texts").cast("long").alias("n"), F.array_join("texts", "\n").alias("joined"))


_FIT = """with recursive t as (select conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) as cost, row_number() over (partition by conv_id order by turn) as rn from conversations),
f as (select conv_id, turn, rn, cost <= 40 as taken, case when cost <= 40 then cost else 0 end as spent from t where rn = 1
union all select t.conv_id, t.turn, t.rn, f.spent + t.cost <= 40 as taken, case when f.spent + t.cost <= 40 then f.spent + t.cost else f.spent end as spent from t join f on t.conv_id = f.conv_id and t.rn = f.rn + 1)
select conv_id, string_agg(cast(turn as varchar), ',' order by turn) as turns from f where taken group by conv_id"""


@entry("evidence_fitting")
def evidence_fitting(spark, sf_dir):
    """SFT15, SFT14: turns that fit 40 words, in order, misfits skipped."""
    cost = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.col("turn").cast("string").alias("snippet_id"), cost.alias("cost")).alias("s"))
    kept = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", V.fitting(F.col("s"), lambda x: x["cost"], 40).alias("k"))
    return kept.where(F.size("k") > 0).select("conv_id", F.array_join(F.transform("k", lambda x: x["snippet_id"]), ",").alias("turns"))


ORACLE["evidence_fitting"] = _FIT


@entry("evidence_best_window")
def evidence_best_window(spark, sf_dir):
    """STR44, STR45: each benchmark text's window of 12 words that is nearest its first and last words."""
    words = F.filter(F.split(clean_text(F.col("text")), " "), lambda w: w != "")
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    return rows.select("item_id", V.best_window(F.col("w"), 12, F.array_join(F.slice("w", 1, 6), " "), F.array_join(F.reverse(F.slice(F.reverse("w"), 1, 3)), " ")).alias("window"))


_F1 = lambda tp, n: f"(case when {n} + n_gold > 0 then cast(2 as double) * ({tp}) / ({n} + n_gold) else 0 end)"
_EDIT = f"""with lab as (select distinct s.question_id, s.response_id, s.item_key, g.group_id from resp_sets s left join gold_groups g on g.question_id = s.question_id and g.alias_key = s.item_key),
cnt as (select l.question_id, response_id, count(distinct group_id) as tp, count(*) as n_pred, max(n_gold) as n_gold from lab l join gold_size z on z.question_id = l.question_id group by l.question_id, response_id),
neg as (select l.question_id, l.response_id, l.item_key as removed, count(*) over (partition by l.question_id, l.item_key) as times from lab l where group_id is null),
subs as (select n.question_id, n.response_id, removed, times, round({_F1('tp', 'n_pred - 1')} - {_F1('tp', 'n_pred')}, 9) as gain from neg n join cnt c on c.question_id = n.question_id and c.response_id = n.response_id where n_pred > 1),
src as (select question_id, group_id, item_key as added, count(*) as times, row_number() over (partition by question_id, group_id order by count(*) desc, item_key desc) as rn from lab where group_id is not null group by question_id, group_id, item_key),
adds as (select c.question_id, c.response_id, added, times, round({_F1('tp + 1', 'n_pred + 1')} - {_F1('tp', 'n_pred')}, 9) as gain from cnt c join src s on s.question_id = c.question_id and rn = 1 where not exists (select 1 from lab l where l.question_id = c.question_id and l.response_id = c.response_id and l.group_id = s.group_id))"""


def _items_gold(spark, sf_dir):
    return view(spark, sf_dir, "resp_items"), view(spark, sf_dir, "gold_groups")


@entry("pairs_negative_addition", f"{_EDIT} select * from (select *, row_number() over (partition by question_id order by times desc, gain desc, removed, response_id) as pair_rank from subs where gain > 0) where pair_rank <= 5")
def pairs_negative_addition(spark, sf_dir):
    """PAR05, PAR07, PAR19, WIN04: an edit that takes one wrong answer out."""
    return P.negative_addition(*_items_gold(spark, sf_dir))


@entry("pairs_valid_omission", f"{_EDIT} select * from (select *, row_number() over (partition by question_id order by times desc, gain desc, added, response_id) as pair_rank from adds where gain > 0) where pair_rank <= 5")
def pairs_valid_omission(spark, sf_dir):
    """PAR06, PAR07, PAR19: an edit that puts one missing answer in."""
    return P.valid_omission(*_items_gold(spark, sf_dir))


@entry("pairs_substitution", f"{_EDIT}, r as (select *, row_number() over (partition by question_id, response_id order by times desc, removed desc) as rn from subs where gain > 0), a as (select *, row_number() over (partition by question_id, response_id order by times desc, added desc) as rn from adds where gain > 0), p as (select r.question_id, r.response_id, removed, added, round({_F1('tp + 1', 'n_pred')} - {_F1('tp', 'n_pred')}, 9) as gain from r join a on a.question_id = r.question_id and a.response_id = r.response_id and a.rn = 1 and r.rn = 1 join cnt c on c.question_id = r.question_id and c.response_id = r.response_id) select * from (select *, row_number() over (partition by question_id order by gain desc, response_id) as pair_rank from p) where pair_rank <= 5")
def pairs_substitution(spark, sf_dir):
    """PAR19, PAR21, PAR23: one wrong answer changed for a missing one, same length."""
    return P.substitution(*_items_gold(spark, sf_dir))


_CLASS = "select question_id, item_key as answer_key, max(case when group_id is null then 'C1' when group_id <= 2 then 'C3' else 'C2' end) as class from matched where item_ord <> 7 group by question_id, item_key"


@entry("pairs_class_slates", f"with s as ({_CLASS}), n as (select * from s) select a.question_id, a.answer_key as chosen, b.answer_key as rejected, a.class as chosen_class, b.class as rejected_class, a.class || '>' || b.class as stage from n a join n b on a.question_id = b.question_id and a.class > b.class")
def pairs_class_slates(spark, sf_dir):
    """PAR09, PAR10, PAR22, PAR26: judged classes, uncertain rows left out, better over worse."""
    judged = F.when(F.col("item_ord") == 7, "UNCERTAIN").when(F.col("group_id").isNull(), "C1").when(F.col("group_id") <= 2, "C3").otherwise("C2")
    rows = view(spark, sf_dir, "matched").select("question_id", F.col("item_key").alias("answer_key"), judged.alias("class"))
    return P.class_pairs(P.judged_slates(rows))


_PERMS = ", ".join(f"({i}, {', '.join(str(x + 1) for x in p)})" for i, p in enumerate(permutations(range(4)), 1))
_WRONG = "select question_id, item_key, row_number() over (partition by question_id order by count(*) desc, item_key) as rn from matched where group_id is null group by question_id, item_key"


@entry("pairs_ranked_sequences", f"with w as ({_WRONG}), q as (select question_id, list(item_key order by rn) as ws from w where rn <= 4 group by question_id having count(*) = 4), g as (select q.question_id, ws, alias_key as gold, 2 + (row_number() over (order by sha<<concat_ws(':', '13', cast(q.question_id as varchar))>>, q.question_id) - 1) % 4 as r from q join gold_groups o on o.question_id = q.question_id and o.group_id = 1) select question_id, n as permutation, cast(r as integer) as rejected_rank, concat_ws('|', gold, ws[a], ws[b], ws[c], ws[d]) as preferred, case r when 2 then concat_ws('|', ws[a], gold, ws[b], ws[c], ws[d]) when 3 then concat_ws('|', ws[a], ws[b], gold, ws[c], ws[d]) when 4 then concat_ws('|', ws[a], ws[b], ws[c], gold, ws[d]) else concat_ws('|', ws[a], ws[b], ws[c], ws[d], gold) end as rejected, cast(1 as double) / r as rejected_mrr from g cross join (values {_PERMS}) p(n, a, b, c, d)")
def pairs_ranked_sequences(spark, sf_dir):
    """PAR16, ARR02, ARR03, ARR04."""
    wrong = run_sql(spark, sf_dir, f"select * from ({_WRONG}) where rn <= 4").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rn", "item_key"))).alias("w"))
    gold = view(spark, sf_dir, "gold_groups").where("group_id = 1").select("question_id", F.col("alias_key").alias("gold"))
    out = P.ranked_sequences(wrong.join(gold, "question_id").withColumn("w", F.transform("w", lambda x: x["item_key"])), "question_id", "gold", "w")
    return out.withColumn("preferred", F.array_join("preferred", "|")).withColumn("rejected", F.array_join("rejected", "|"))


@entry("pairs_dominance", "with q as (select question_id, response_id, cast(tp as bigint) as good, cast(n_pred - tp as bigint) as bad from metrics), c as (select * from q where bad = 0) select * from (select a.question_id, a.response_id as chosen_id, b.response_id as rejected_id, row_number() over (partition by a.question_id order by least(a.response_id, b.response_id), greatest(a.response_id, b.response_id)) as pair_rank from c a join q b on a.question_id = b.question_id and a.good >= b.good and (a.good > b.good or b.bad > 0)) where pair_rank <= 2")
def pairs_dominance(spark, sf_dir):
    """PAR20, JON08, PAR24."""
    q = view(spark, sf_dir, "metrics").select("question_id", "response_id", F.col("tp").cast("long").alias("good"), (F.col("n_pred") - F.col("tp")).cast("long").alias("bad"))
    return P.dominance_pairs(q, ["good"], ["bad"], ["bad"])


@entry("responses_parse", "with i as (select question_id, response_id, item_key, min(item_ord * 1000000 + tie) as first from resp_items group by question_id, response_id, item_key), n as (select question_id, response_id, count(*) as items from resp_items group by question_id, response_id) select n.question_id, n.response_id, least(10, count(*)) as accepted, items - least(10, count(*)) as rejected, items = count(*) and items <= 10 as strict from n join i on i.question_id = n.question_id and i.response_id = n.response_id group by n.question_id, n.response_id, items")
def responses_parse(spark, sf_dir):
    """ARR07, ARR08, ARR09, UDF09: each response as JSON inside other text, read back with reasons."""
    items = view(spark, sf_dir, "resp_items").groupBy("question_id", "response_id").agg(F.array_sort(F.collect_list(F.struct("item_ord", "tie", "surface"))).alias("s"))
    answers = F.transform("s", lambda x, i: F.struct(x["surface"].alias("answer"), F.when(i == 0, "original").otherwise("synonym").alias("relation_type")))
    rows = items.select("question_id", "response_id", F.concat(F.lit("Result: "), F.to_json(F.struct(answers.alias("answers")))).alias("raw"))
    p = rows.select("question_id", "response_id", "raw", J.parsed(F.col("raw")).alias("p"), J.strict_problem(F.replace("raw", F.lit("Result: "), F.lit(""))).alias("problem"))
    return p.select("question_id", "response_id", F.size("p.accepted").cast("long").alias("accepted"), F.size("p.rejected").cast("long").alias("rejected"), F.col("problem").isNull().alias("strict"))


@entry("stats_mcnemar_exact", "with s as (select question_id, max(case when arm = 'click' and score > 50 then 1 else 0 end) as a, max(case when arm = 'purchase' and score > 50 then 1 else 0 end) as b from event_arm group by question_id), c as (select count(case when a = 0 and b = 1 then 1 end) as gained, count(case when a = 1 and b = 0 then 1 end) as lost from s) select gained, lost, round(least(1, 2 * (select sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1) - (gained + lost) * ln(2e0))) from generate_series(0, 1000000) t(k) where k <= least(gained, lost))), 6) as p from c")
def stats_mcnemar_exact(spark, sf_dir):
    """ENS17."""
    right = lambda arm: F.max(F.when((F.col("arm") == arm) & (F.col("score") > 50), 1).otherwise(0))
    s = view(spark, sf_dir, "event_arm").groupBy("question_id").agg(right("click").alias("a"), right("purchase").alias("b"))
    c = s.agg(F.count(F.when((F.col("a") == 0) & (F.col("b") == 1), 1)).alias("gained"), F.count(F.when((F.col("a") == 1) & (F.col("b") == 0), 1)).alias("lost"))
    return c.select("gained", "lost", F.round(L.mcnemar_p(F.col("gained"), F.col("lost")), 6).alias("p"))


NUMERIC = ["votes", "best_rank", "rank_vote", "frequency"]


def _labelled(spark, sf_dir) -> DataFrame:
    rows = run_sql(spark, sf_dir, "select p.question_id, p.answer, votes, best_rank, rank_vote, frequency, case when p.answer = g.gold then 1 else 0 end as label from pooled p join gold_answer g on g.question_id = p.question_id")
    return rows.select("question_id", "answer", *[F.col(c).cast("double").alias(c) for c in NUMERIC], "label")


@entry("rank_logistic")
def rank_logistic(spark, sf_dir):
    """ENS07, ENS09, ENS10, ENS11, ARR15: out-of-fold scores of a logistic reranker."""
    rows = L.featured(_labelled(spark, sf_dir).withColumn("question", F.col("question_id").cast("string")), "question", "answer")
    return L.out_of_fold(rows, "question_id", NUMERIC, width=1 << 12).select("question_id", "answer", "label", F.round("score", 4).alias("score"))


@entry("rank_pairwise")
def rank_pairwise(spark, sf_dir):
    """ENS08: scores of a linear ranker fitted on differences of right and wrong candidates."""
    rows = _labelled(spark, sf_dir)
    weights = L.pairwise_weights(rows, "question_id", "answer", NUMERIC)
    return rows.select("question_id", "answer", "label", F.round(L.linear_score(weights), 4).alias("score"))


@entry("nearest_texts")
def nearest_texts(spark, sf_dir):
    """ENS05: the five documents nearest each document whose id is divisible by 100, against all documents."""
    docs = table(spark, sf_dir, "documents")
    return L.nearest_texts(docs, docs.where("doc_id % 100 = 0"), "doc_id", "text").withColumn("score", F.round("score", 4))


def _listed(spark, sf_dir) -> DataFrame:
    items = view(spark, sf_dir, "resp_items").groupBy("question_id", "response_id").agg(F.array_sort(F.collect_list(F.struct("item_ord", "tie", "surface"))).alias("s"))
    return items.select("question_id", "response_id", F.transform("s", lambda x: x["surface"]).alias("items"))


@entry("parse_lists", "select question_id, response_id, count(*) as n_items, case when response_id % 4 < 2 then 'ok' else 'malformed' end as status, case response_id % 4 when 0 then '' when 1 then 'placeholder_items_dropped' when 2 then 'mismatched_tag_count|truncated_final_item' else 'mismatched_tag_count' end as warnings from resp_items group by question_id, response_id")
def parse_lists(spark, sf_dir):
    """STR05, STR06, FLT05: whole lists, with a placeholder, cut off, and with an end mark too many."""
    bad = F.when(F.col("response_id") % 4 == 1, "[BI]item_1[EI]").when(F.col("response_id") % 4 == 2, "[BI]cut").when(F.col("response_id") % 4 == 3, "[EI]").otherwise("")
    p = _listed(spark, sf_dir).select("question_id", "response_id", A.parse_list(F.concat(serialize_items(F.col("items")), bad)).alias("p"))
    return p.select("question_id", "response_id", F.size("p.items").cast("long").alias("n_items"), "p.status", F.array_join("p.warnings", "|").alias("warnings"))


@entry("parse_candidates", "select question_id, response_id, count(distinct surface) as tagged, case when count(*) >= 2 then count(distinct surface) else 1 end as numbered from resp_items group by question_id, response_id")
def parse_candidates(spark, sf_dir):
    """STR07, STR08, STR09: the same candidates as tags and as a numbered list."""
    items = _listed(spark, sf_dir)
    numbered = F.array_join(F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), " ")
    n = lambda c: F.size(A.factoid_candidates(c)).cast("long")
    return items.select("question_id", "response_id", n(serialize_items(F.col("items"), "E")).alias("tagged"), n(numbered).alias("numbered"))


@entry("parse_single", "select p_partkey, k, case when k < 3 then p_name end as answer, case when k < 2 then 'strict_tagged' when k = 2 then 'single_answer_line' else 'unrecoverable' end as how from part cross join (values (0), (1), (2), (3)) v(k)")
def parse_single(spark, sf_dir):
    """STR10, STR11, UDF11: strict, labelled, plain-line and lost answers."""
    n = F.col("p_name")
    raw = F.array(F.concat(F.lit("[BE]"), n, F.lit("[EE]")), F.concat(F.lit("Answer: [BE] "), n, F.lit(" [EE]")), F.concat(F.lit("Answer: "), n), F.concat(n, F.lit(" only")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(raw).alias("k", "raw"))
    return rows.select("p_partkey", "k", F.inline(F.array(A.recover_answer(F.col("raw")))))


@entry("match_boundary", "select p_partkey, k, case k when 0 then 'exact' when 1 then 'boundary_variant' else 'mismatch' end as match from part cross join (values (0), (1), (2)) v(k)")
def match_boundary(spark, sf_dir):
    """STR27, UDF06: intended against extracted answers."""
    n = F.col("p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.posexplode(F.array(F.upper(n), F.concat(F.lit("The "), n, F.lit(".")), F.concat(n, F.lit("s")))).alias("k", "x"))
    return rows.select("p_partkey", "k", A.match_type(F.col("p_name"), F.col("x")).alias("match"))


@entry("filter_supported", "select g.question_id, r.response_id, count(*) as supported from gold_groups g join resp_sets r on r.question_id = g.question_id and r.item_key = g.alias_key group by g.question_id, r.response_id")
def filter_supported(spark, sf_dir):
    """FLT08, SFT05: gold aliases that stand whole in one item of a response."""
    texts = view(spark, sf_dir, "resp_sets").groupBy("question_id", "response_id").agg(F.collect_set("item_key").alias("t"))
    gold = view(spark, sf_dir, "gold_groups").groupBy("question_id").agg(F.collect_set("alias_key").alias("g"))
    key = lambda c: F.transform(c, loose_key)
    out = texts.join(gold, "question_id").select("question_id", "response_id", F.size(A.supported(key("g"), key("t"))).cast("long").alias("supported"))
    return out.where("supported > 0")


@entry("prompt_round_trip", r"select item_id, 'Answer it.' as instruction, 'What is ' || item_id || '?' as question, 2 as n_resources, sha256('Document: ' || item_id || chr(10) || trim(regexp_replace(text, '\s+', ' ', 'g'))) as first_sha256 from benchmark")
def prompt_round_trip(spark, sf_dir):
    """PRJ08, PRJ17, SFT01, SFT04: plain prompts written and read back."""
    doc = lambda t: F.concat(F.lit("Document: "), F.col("item_id").cast("string"), F.lit("\n"), clean_text(t))
    prompt = C.plain_prompt(F.lit("Answer it."), F.concat(F.lit("What is "), F.col("item_id").cast("string"), F.lit("?")), F.array(doc(F.col("text")), F.lit(" "), doc(F.lit("other"))))
    p = table(spark, sf_dir, "benchmark").select("item_id", C.parse_plain(prompt).alias("p"))
    return p.select("item_id", "p.instruction", "p.question", F.size("p.resources").alias("n_resources"), F.sha2(F.col("p.resources")[0], 256).alias("first_sha256"))


@entry("token_distance", "with c as (select surface, chr(cast(32 + row_number() over (order by surface) as integer)) as letter from (select distinct surface from resp_items)), w as (select r.question_id, r.rk, string_agg(letter, '' order by item_ord, tie) as word from ranked r join resp_items i on i.question_id = r.question_id and i.response_id = r.response_id join c on c.surface = i.surface where rk <= 2 group by r.question_id, r.rk) select a.question_id, levenshtein(a.word, b.word) as edits from w a join w b on a.question_id = b.question_id and a.rk = 1 and b.rk = 2")
def token_distance(spark, sf_dir):
    """STR24, PAR03: edits between the item lists of a question's two best responses."""
    ranked = view(spark, sf_dir, "ranked").where("rk <= 2").select("question_id", "response_id", "rk").join(_listed(spark, sf_dir), ["question_id", "response_id"])
    side = lambda k, name: ranked.where(F.col("rk") == k).select("question_id", F.col("items").alias(name))
    return side(1, "a").join(side(2, "b"), "question_id").select("question_id", C.token_distance("a", "b").alias("edits"))


@entry("embedding_rank", "with q as (select label, embedding as qe from (select *, row_number() over (partition by label order by vec_id) as rn from embeddings) where rn = 1), s as (select e.label, vec_id, round(list_dot_product(cast(embedding as double[]), cast(qe as double[])) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) * list_dot_product(cast(qe as double[]), cast(qe as double[]))), 6) as score from embeddings e join q on q.label = e.label) select label, vec_id, score, row_number() over (partition by label order by score desc, vec_id) as place from s")
def embedding_rank(spark, sf_dir):
    """ENS06, PRJ06: vectors of a label by cosine with its first."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e = table(spark, sf_dir, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    score = dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q"))
    ranked = e.join(q, "label").select("label", "vec_id", F.round(score, 6).alias("score"))
    return R.global_rank(ranked, -F.floor(F.col("score") * 1024), F.desc("score"), "vec_id", within=("label",), name="place")  # by steps of the score


@entry("split_kfold", "select question_id, group_id, cast('0x' || substring(sha256(cast(question_id as varchar)), 1, 8) as bigint) % 5 as fold from gold_groups")
def split_kfold(spark, sf_dir):
    """SPL11: all rows of a question in one fold."""
    return view(spark, sf_dir, "gold_groups").select("question_id", "group_id", A.hash_fold(F.col("question_id")).alias("fold"))


@entry("agg_form_audit", f"select form, count(*) as n, count(distinct p_partkey) as parts from ({'{forms}'}) group by form".replace("{forms}", ORACLE["forms_classify"]))
def agg_form_audit(spark, sf_dir):
    """AGG29."""
    return forms_classify(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


@entry("split_nested", "select question_id, case when rn <= floor(n * 0.1e0) then 'test' when rn <= floor(n * 0.2e0) then 'dev' else 'train' end as split from (select question_id, row_number() over (order by sha<<concat_ws(':', '7', cast(question_id as string))>>, question_id) as rn, count(*) over () as n from (select distinct question_id from gold_groups))")
def split_nested(spark, sf_dir):
    """SPL03, SPL06, SPL12."""
    q = view(spark, sf_dir, "gold_groups").select("question_id").distinct()
    ranked = R.hash_rank(q, R.hash_order("7", "question_id"), "question_id").join(q.agg(F.count("*").alias("n")))  # one row
    part = F.when(F.col("rn") <= F.floor(F.col("n") * 0.1), "test").when(F.col("rn") <= F.floor(F.col("n") * 0.2), "dev").otherwise("train")
    return ranked.select("question_id", part.alias("split"))


@entry("window_model_balanced", "with q as (select question_id, concat('m', cast((row_number() over (order by sha<<cast(question_id as string)>>, question_id) - 1) % 3 as string)) as model from (select distinct question_id from bank_rank)) select question_id, model, answer from (select q.question_id, q.model, p.answer, row_number() over (partition by q.question_id order by p.src_rank, p.answer) as rn from q join per_model p on p.question_id = q.question_id and p.model = q.model) where rn = 1")
def window_model_balanced(spark, sf_dir):
    """WIN13: models in turn over the questions in hash order."""
    q = view(spark, sf_dir, "bank_rank").select("question_id").distinct()
    turn = R.hash_rank(q, F.sha2(F.col("question_id").cast("string"), 256), "question_id")
    turn = turn.select("question_id", F.concat(F.lit("m"), ((F.col("rn") - 1) % 3).cast("string")).alias("model"))
    first = view(spark, sf_dir, "per_model").groupBy("question_id", "model").agg(F.min(F.struct("src_rank", "answer")).alias("f"))
    return turn.join(first, ["question_id", "model"]).select("question_id", "model", F.col("f.answer").alias("answer"))
