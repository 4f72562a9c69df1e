"""Checks and reports of experiments: arms that must match, frozen rows scored again, misses, official figures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arm_problems(rows: DataFrame, arm: str, question: str, draw: str, expected_draws: dict[str, int], fingerprint: Column) -> DataFrame:
    """(problem, arm, question) of what makes arms incomparable (ORC12): a question that an arm lacks, an unknown arm, draws that
    are not 1 to the expected number, inputs whose fingerprints differ between arms.  No rows: the arms are valid."""
    arms = F.array(*[F.lit(a) for a in sorted(expected_draws)])
    known = rows.where(F.col(arm).isin(list(expected_draws)))
    have = known.groupBy(question).agg(F.collect_set(arm).alias("_have"))
    absent = have.select(F.explode(F.array_except(arms, "_have")).alias("arm"), F.col(question).alias("question")).withColumn("problem", F.lit("question_missing"))
    per = known.groupBy(arm, question).agg(F.array_sort(F.collect_list(draw)).alias("_draws"), F.collect_set(fingerprint).alias("_inputs"))
    wanted = F.create_map(*[F.lit(x) for a, n in expected_draws.items() for x in (a, n)])
    bad = per.where(F.col("_draws").cast("array<long>") != F.sequence(F.lit(1).cast("long"), wanted[F.col(arm)].cast("long")))
    bad = bad.select(F.col(arm).alias("arm"), F.col(question).alias("question"), F.lit("draws_incomplete").alias("problem"))
    inputs = per.groupBy(question).agg(F.size(F.array_distinct(F.flatten(F.collect_list("_inputs")))).alias("_n")).where("_n > 1")
    inputs = inputs.select(F.lit(None).cast("string").alias("arm"), F.col(question).alias("question"), F.lit("inputs_differ").alias("problem"))
    unknown = rows.where(~F.col(arm).isin(list(expected_draws))).select(F.col(arm).alias("arm"), F.lit(None).cast(rows.schema[question].dataType).alias("question"), F.lit("unknown_arm").alias("problem")).distinct()
    out = absent.unionByName(bad).unionByName(inputs).unionByName(unknown)
    return out.select("problem", "arm", "question")


def setting_problems(configs: DataFrame, arm: str, shared: list[str]) -> DataFrame:
    """(field, values) of settings that arms must share and don't; nulls count as a value."""
    pairs = configs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in shared])).alias("s")).select("s.*")
    return pairs.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def rescored(frozen: DataFrame, keys: list[str], recorded: str, score: Column) -> DataFrame:
    """Frozen generations scored again (ORC09): keys, the recorded and the new score, and whether they differ by more than 1e-9."""
    rows = frozen.select(*keys, F.col(recorded).alias("recorded"), score.alias("rescored"))
    same = F.when(F.col("recorded").isNull() | F.col("rescored").isNull(), F.col("recorded").eqNullSafe(F.col("rescored"))).otherwise(F.abs(F.col("recorded") - F.col("rescored")) <= 1e-9)
    return rows.withColumn("changed", ~same)


def selection_misses(ranked: DataFrame, key: str, rank: str, score: str, right: Column, k: int = 5) -> DataFrame:
    """Questions whose pool holds a right answer that the first k miss (ORC11): its best rank and how far its score is below the k-th's."""
    per = ranked.groupBy(key).agg(
        F.min(F.when(right, F.struct(F.col(rank).alias("rank"), F.col(score).alias("score")))).alias("_best"),
        F.max(F.when(F.col(rank) == k, F.col(score))).alias("_kth"))
    return per.where(F.col("_best.rank") > k).select(key, F.col("_best.rank").alias("best_rank"), (F.col("_kth") - F.col("_best.score")).alias("score_gap"))


def changed_cases(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value changed between two runs, with both values; keys of one run only are left out (ORC11)."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))


def official_scores(yes_no: DataFrame, factoid: DataFrame, listed: DataFrame) -> DataFrame:
    """One row of the scorer's figures (SRC27, MET09, MET10).

    yes_no(gold, predicted): accuracy and F1 of yes and of no with their mean; factoid(first_rank), null where no answer
    of the first five is right: strict and lenient accuracy, MRR; listed(p, r, f1): their means."""
    def f1(label):
        hit = F.count_if((F.col("gold") == label) & (F.col("predicted") == label))
        n = F.count_if(F.col("gold") == label) + F.count_if(F.col("predicted") == label)
        return F.when(n > 0, 2.0 * hit / n).otherwise(F.lit(0.0))

    y = yes_no.agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"), f1("yes").alias("f1_yes"), f1("no").alias("f1_no")).withColumn("macro_f1", (F.col("f1_yes") + F.col("f1_no")) / 2)
    rank = F.when(F.col("first_rank") <= 5, F.col("first_rank"))
    f = factoid.agg(F.avg(F.coalesce((rank == 1).cast("double"), F.lit(0.0))).alias("strict"), F.avg(rank.isNotNull().cast("double")).alias("lenient"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"))
    m = listed.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f1").alias("f1"))
    return y.join(F.broadcast(f)).join(F.broadcast(m))  # one row each


def eligible_aliases(packets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Packets' aliases with what was decided on them and why they may not be taught (SFT07).

    packets(question_id, alias_id, input_sha256), decisions(question_id, alias_id, input_sha256, origin, answer_status,
    evidence_status, reviewer); a decision on other input does not count."""
    d = decisions.select("question_id", "alias_id", F.col("input_sha256").alias("_sha"), "origin", "answer_status", "evidence_status", "reviewer")
    rows = packets.join(d, ["question_id", "alias_id"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_sha").isNull(), "unreviewed"), F.when(F.col("_sha") != F.col("input_sha256"), "input_changed"),
        F.when(F.col("answer_status") != "accepted", "answer_not_accepted"), F.when(F.col("evidence_status") != "supported", "evidence_not_supported"),
        F.when((F.col("origin") == "human") & F.col("reviewer").isNull(), "reviewer_missing")))
    return rows.select("question_id", "alias_id", reasons.alias("exclusion_reasons"), (F.size(reasons) == 0).alias("eligible"))


def markdown(title: str, df: DataFrame, columns: list[str], order: list[str]) -> str:
    """A small aggregate as a Markdown section (ARR16); the caller's frame is a report of a few rows."""
    def cell(value):
        return f"{value:.4f}" if isinstance(value, float) else "" if value is None else str(value).replace("|", "\\|")

    head = [f"## {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in df.select(*columns).orderBy(*order).collect()]) + "\n"
