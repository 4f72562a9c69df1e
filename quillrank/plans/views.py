"""Derived question-keyed views over the driver's tables, the same text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "bank_rank": "select l_partkey % 500 as question_id, 'm' || cast(l_suppkey % 3 as string) as model, cast(l_linenumber as bigint) as draw, p_name || ' ' || p_brand as answer, l_orderkey as ord from lineitem join part on p_partkey = l_partkey",
    "resp_items": "select o_custkey as question_id, o_orderkey as response_id, 'c' || cast(o_orderkey % 2 as string) as checkpoint, l_linenumber as item_ord, l_partkey as tie, p_brand as surface, lower(p_brand) as item_key from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey",
    "gold_groups": "select question_id, group_id, alias_key from (select o_custkey as question_id, p_brand as alias, lower(p_brand) as alias_key, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, p_brand) as group_id from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by o_custkey, p_brand) g where group_id <= 5",
    "event_arm": "select user_id as question_id, event_id as ord, event_type as arm, value as score from events",
    "matched": "select i.*, g.group_id, g.group_id is not null and row_number() over (partition by i.question_id, i.response_id, g.group_id order by i.item_ord, i.tie) = 1 as hit from resp_items i left join gold_groups g on g.question_id = i.question_id and g.alias_key = i.item_key",
    "gold_size": "select question_id, count(distinct group_id) as n_gold from gold_groups group by question_id",
    "counted": "select m.question_id, response_id, checkpoint, sum(case when hit then 1 else 0 end) as tp, count(*) as n_pred, max(n_gold) as n_gold from matched m join gold_size s on s.question_id = m.question_id group by m.question_id, response_id, checkpoint",
    "ratios": "select *, cast(tp as double) / n_pred as p, cast(tp as double) / n_gold as r from counted",
    "metrics": "select *, case when p + r > 0 then cast(2 as double) * p * r / (p + r) else cast(0 as double) end as f1 from ratios",
    "ranked": "select *, row_number() over (partition by question_id order by f1 desc, p desc, r desc, n_pred, response_id) as rk from metrics",
    "pairs": "select a.question_id, a.response_id as chosen_id, b.response_id as rejected_id, a.rk as chosen_rank, b.rk as rejected_rank, a.f1 as chosen_f1, b.f1 as rejected_f1, a.p as chosen_p, b.p as rejected_p, a.r as chosen_r, b.r as rejected_r, a.n_pred as chosen_n, b.n_pred as rejected_n, round(a.f1 - b.f1, 9) as gain from ranked a join ranked b on a.question_id = b.question_id and a.rk < b.rk where a.f1 - b.f1 >= 0.1",
    "per_model": "select question_id, answer, model, min(draw) as src_rank, count(distinct draw) as drawn from bank_rank group by question_id, answer, model",
    "pooled": "select question_id, answer, count(*) as votes, min(src_rank) as best_rank, sum(cast(1 as double) / src_rank) as rank_vote, sum(cast(drawn as double) / 7) as frequency from per_model group by question_id, answer",
    "gold_answer": "select question_id, min(answer) as gold from bank_rank where draw = 1 group by question_id",
    "fused": "select *, row_number() over (partition by question_id order by round(rank_vote, 9) desc, best_rank, sha<<answer>>, answer) as rk from pooled",
    "rr": "select q.question_id, min(case when f.answer = q.gold then rk end) as first_rank from gold_answer q left join fused f on f.question_id = q.question_id group by q.question_id",
    "resp_sets": "select distinct question_id, response_id, item_key from resp_items",
    "arm_means": "select question_id, arm, avg(score) as mean_score, count(*) as n from event_arm group by question_id, arm",
}


def expand(sql: str) -> str:
    """sql with the views it needs, in order of use, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    found = ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)
    if not found:
        return sql
    return re.sub(r"^\s*with\s", f"with {found},\n", sql, count=1, flags=re.I) if re.match(r"\s*with\s", sql, re.I) else f"with {found}\n{sql}"


def for_duckdb(sql: str) -> str:
    return re.sub(r"rx<<(.*?)>>", r"regexp_replace(\1, 'g')", re.sub(r"sha<<(.*?)>>", r"sha256(\1)", expand(sql)))


def for_spark(sql: str) -> str:
    sql = re.sub(r"rx<<(.*?)>>", lambda m: f"regexp_replace({m[1]})".replace("\\", "\\\\"), re.sub(r"sha<<(.*?)>>", r"sha2(\1, 256)", expand(sql)))
    return re.sub(rf"\b(from|join)\s+({'|'.join(TABLES)})\b", r"\1 quillrank_\2", sql)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir; names live in this statement alone, so the session's views stay as they are."""
    sql = for_spark(sql)
    tables = {f"quillrank_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"quillrank_(\w+)", sql))}
    braced = re.sub(r"quillrank_\w+", lambda m: "{" + m[0] + "}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(braced, **tables)
