"""Catalog entries for methods, plans, steps and registries (runner.py), each run on the driver's tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import ranking as R
from . import runner
from .relational import Tables, _metrics
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


def _pairs(spark, sf_dir, least_gain: float, cap: int):
    """Chosen and rejected responses of each question."""
    pairs = R.whole_response_pairs(_metrics(Tables(spark, sf_dir)), least_gain, cap)
    return pairs.select("question_id", F.col("chosen_response_id").alias("chosen_id"), F.col("rejected_response_id").alias("rejected_id"), "pair_rank")


@entry("orchestrate_plan", "select * from (select question_id, chosen_id, rejected_id, row_number() over (partition by question_id order by gain desc, chosen_rank, rejected_rank) as pair_rank from pairs where chosen_f1 - rejected_f1 >= 0.2) where pair_rank <= 2")
def orchestrate_plan(t):
    """ORC01, ORC02, ORC03, ORC04: a method with defaults under a preset, planned with a fingerprint and run."""
    method = runner.Method("whole_response_pairs", _pairs, "pairs", {"least_gain": 0.1, "cap": 5})
    parameters = runner.merged(runner.merged(method.describe()["defaults"], {"cap": 2}), {"least_gain": 0.2})
    return runner.execute(t.spark, method, runner.plan(method, parameters), t.sf_dir)


@entry("orchestrate_steps", "with n as (select event_type, count(*) as n from events group by event_type) select event_type, n, 'load done|keep done|count done|again skipped|later not_selected' as report from n where event_type <> 'view'")
def orchestrate_steps(t):
    """ORC05: named steps with variables, one skipped for its output, one not selected."""
    made: dict = {}

    def load(table):
        made["rows"] = t(table)

    def keep(condition):
        made["rows"] = made["rows"].where(condition)

    def count(column):
        made["out"] = made["rows"].groupBy(column).agg(F.count("*").alias("n"))

    steps = [
        {"name": "load", "action": "load", "args": {"table": "${table}"}}, {"name": "keep", "action": "keep", "args": {"condition": "event_type <> '${out}'"}},
        {"name": "count", "action": "count", "args": {"column": "event_type"}}, {"name": "again", "action": "count", "args": {"column": "user_id"}, "skip_if_exists": "counted"}]
    report = runner.run_steps(steps, {"load": load, "keep": keep, "count": count}, {"table": "events", "out": "view"}, exists=lambda name: name == "counted" and "out" in made)
    report += runner.run_steps([{"name": "later", "action": "load"}, {"name": "first", "action": "load"}], {}, only="first", dry_run=True)[:1]
    return made["out"].withColumn("report", F.lit("|".join(f"{r['name']} {r['status']}" for r in report)))


@entry("orchestrate_registry", "with s as (select checkpoint, round(avg(f1), 6) as f1, count(*) as n from metrics group by checkpoint) select checkpoint as run_id, f1, n, 'metrics.f1|note' as changed from s order by f1 desc, checkpoint desc limit 1")
def orchestrate_registry(t):
    """SRC05, ORC06, ORC07, ORC10, ORC13: a run a checkpoint in a registry, the best one promoted, its metrics filled in later."""
    scores = _metrics(t).groupBy("checkpoint").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n")).collect()  # a row a checkpoint
    with tempfile.TemporaryDirectory() as folder:  # the registry is the driver's
        registry = runner.Registry(os.path.join(folder, "registry.json"))
        for r in scores:
            registry.upsert({"run_id": r.checkpoint, "n": r.n, "metrics": {}})
            registry.upsert(runner.set_nested({"run_id": r.checkpoint, "n": r.n, "metrics": {}, "note": "scored"}, "metrics.f1", r.f1))
        best = max(registry.runs(note="scored"), key=lambda r: (r["metrics"]["f1"], r["run_id"]))
        registry.promote("Best run", best["run_id"])
        found = registry.resolve("best-run")
    changed = runner.differences({"run_id": found["run_id"], "n": found["n"], "metrics": {}}, found)
    return t.spark.createDataFrame([(found["run_id"], found["metrics"]["f1"], found["n"], "|".join(changed))], "run_id string, f1 double, n long, changed string")
