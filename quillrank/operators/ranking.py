"""Matching, metrics, ranking, fusion and pair mining over question-keyed tables.

Every frame is keyed by question_id, so one shuffle by it serves the windows that follow; every order ends in a
unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_match(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Items with matched: the first item of a response on a gold group takes it; alias keys belong to one group."""
    keyed = items.join(gold.select("question_id", F.col("alias_key").alias("item_key"), "group_id"), ["question_id", "item_key"], "left")
    turn = Window.partitionBy("question_id", "response_id", "group_id").orderBy("item_ord", "tie")
    return keyed.withColumn("matched", F.col("group_id").isNotNull() & (F.row_number().over(turn) == 1))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def set_metrics(items: DataFrame, gold: DataFrame) -> DataFrame:
    """One row a response: tp, n_pred, n_gold, p, r, f1."""
    groups = gold.groupBy("question_id").agg(F.countDistinct("group_id").alias("n_gold"))
    out = greedy_match(items, gold).groupBy("question_id", "response_id", "checkpoint").agg(F.sum(F.col("matched").cast("long")).alias("tp"), F.count("*").alias("n_pred"))
    out = out.join(groups, "question_id").withColumn("p", safe_ratio(F.col("tp"), F.col("n_pred"))).withColumn("r", safe_ratio(F.col("tp"), F.col("n_gold")))
    return out.withColumn("f1", safe_ratio(2.0 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def response_rank() -> list[Column]:
    return [F.col("f1").desc(), F.col("p").desc(), F.col("r").desc(), F.col("n_pred").asc(), F.col("response_id").asc()]


def whole_response_pairs(metrics: DataFrame, least_gain: float = 0.1, cap: int = 5) -> DataFrame:
    """Chosen and rejected responses of a question: of all pairs with an F1 gain of least_gain, the cap largest gains.

    A pair whose chosen response is not among the cap best has cap pairs before it with the same rejected response.
    Likewise a rejected response can't lie above the F1 of the cap worst, but for what rounding the gain makes equal: F1
    values that differ in the last bit are one gain, yet least_gain may part them.  So each F1 value up to there keeps its
    first rows (no more than cap of them are at or before a chosen one), and these two ends hold all the pairs wanted."""
    turn = Window.partitionBy("question_id")
    ranked = metrics.withColumn("rank", F.row_number().over(turn.orderBy(*response_rank())))
    worst = ranked.withColumn("last", F.row_number().over(turn.orderBy("f1", "rank"))).withColumn("same", F.row_number().over(Window.partitionBy("question_id", "f1").orderBy("rank")))
    worst = worst.withColumn("low", F.max(F.when(F.col("last") <= cap, F.col("f1"))).over(turn)).where((F.col("f1") <= F.col("low") + 2e-9) & (F.col("same") <= 2 * cap))
    fields = ["response_id", "f1", "p", "r", "n_pred", "rank"]
    a = ranked.where(F.col("rank") <= cap).select("question_id", *[F.col(c).alias(f"chosen_{c}") for c in fields])
    b = worst.select("question_id", *[F.col(c).alias(f"rejected_{c}") for c in fields])
    pairs = a.join(b, "question_id").where((F.col("chosen_rank") < F.col("rejected_rank")) & (F.col("chosen_f1") - F.col("rejected_f1") >= least_gain))
    pairs = pairs.withColumn("gain", F.round(F.col("chosen_f1") - F.col("rejected_f1"), 9))
    order = Window.partitionBy("question_id").orderBy(F.col("gain").desc(), "chosen_rank", "rejected_rank")
    return pairs.withColumn("pair_rank", F.row_number().over(order)).where(F.col("pair_rank") <= cap)


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails, else null; a null check fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for ok, name in checks])


def pool(bank: DataFrame, draws: int = 7) -> DataFrame:
    """One row a question and answer: n sources, votes, best rank by source, frequency over draws."""
    per = bank.groupBy("question_id", "answer", "model").agg(F.min("draw").alias("rank"), F.countDistinct("draw").alias("drawn"))
    return per.groupBy("question_id", "answer").agg(
        F.count("*").alias("votes"), F.min("rank").alias("best_rank"), F.sum(F.lit(1.0).cast("double") / F.col("rank")).alias("rank_vote"),
        F.sum(F.col("drawn") / F.lit(draws)).alias("frequency"), F.min(F.struct("rank", "model")).alias("turn"))


def ordered(pooled: DataFrame, *order: Column) -> DataFrame:
    return pooled.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order, F.sha2("answer", 256), "answer")))


SELECTORS = {
    "model_vote": lambda: (F.col("votes").desc(), F.col("best_rank")),
    "rank_vote": lambda: (F.round("rank_vote", 9).desc(), F.col("best_rank")),
    "sample_frequency": lambda: (F.round("frequency", 9).desc(), F.col("best_rank")),
    "round_robin": lambda: (F.col("turn.rank"), F.col("turn.model")),
}


def reciprocal_ranks(ranked: DataFrame, questions: DataFrame, right: Column, k: int = 5) -> DataFrame:
    """One row a question, whether or not it has answers: first right rank, rr within k."""
    first = ranked.where(right).groupBy("question_id").agg(F.min("rank").alias("first_rank"))
    out = questions.join(first, "question_id", "left")
    return out.withColumn("rr", F.when(F.col("first_rank") <= k, 1.0 / F.col("first_rank")).otherwise(F.lit(0.0)))


def ranking_summary(rr: DataFrame) -> DataFrame:
    at = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"coverage_{k}")
    return rr.agg(F.count("*").alias("questions"), F.round(F.avg("rr"), 6).alias("mrr"), at(1), at(5), at(10), F.round(F.avg(F.col("first_rank").isNotNull().cast("double")), 6).alias("pool_coverage"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, n = successes / n, n.cast("double")
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def global_rank(df: DataFrame, bucket: Column, *order: str | Column, within: tuple[str, ...] = (), name: str = "rn") -> DataFrame:
    """df with the number of each row in the order of (bucket, order) over all rows, or over those equal in `within`.

    The bucket is a coarse form of the order, with a bound on its values (hash prefixes, steps of a length): rows are
    numbered in their bucket, and only one count a bucket is added up in one place."""
    keyed = df.withColumn("_bucket", bucket)
    inside = keyed.withColumn("_inside", F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)))
    before = Window.partitionBy(*within).orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    counts = keyed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    base = counts.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate((*within, "_bucket"))], "_before")
    same = F.lit(True)
    for i, c in enumerate((*within, "_bucket")):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    joined = inside.join(base if within else F.broadcast(base), same)
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def hash_rank(df: DataFrame, hashed: Column, *ties: str, within: tuple[str, ...] = (), name: str = "rn") -> DataFrame:
    """global_rank by a hexadecimal hash: 4096 prefixes are the buckets."""
    return global_rank(df.withColumn("_hash", hashed), F.substring("_hash", 1, 3), "_hash", *ties, within=within, name=name).drop("_hash")


def hash_order(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def largest_remainder(df: DataFrame, key: str, stratum: str, ratio: float, seed: str) -> DataFrame:
    """Rows with held: exactly round(ratio * n) of them, strata's quotas by largest remainder, then hash order."""
    strata = df.groupBy(stratum).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row a stratum
    quota = strata.withColumn("total", F.floor(F.sum("n").over(everything) * ratio + 0.5)).withColumn("floor", F.floor(F.col("n") * ratio))
    left = F.col("total") - F.sum("floor").over(everything)
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("n") * ratio - F.col("floor"), 9).desc(), stratum))
    quota = quota.withColumn("left", left).withColumn("quota", F.col("floor") + (turn <= F.col("left")).cast("int")).select(stratum, "quota")
    return hash_rank(df, hash_order(seed, key), key, within=(stratum,), name="place").join(quota, stratum).withColumn("held", F.col("place") <= F.col("quota")).drop("place", "quota")
