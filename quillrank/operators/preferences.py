"""Constructors of preference pairs beyond whole responses: single edits, judged classes, ranked sequences, dominance.

A cap is on what a question gives, never on what is looked at: before a question is joined with itself, rows that
can't be in the result are told from the order alone."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_order, hash_rank, safe_ratio


def f1_of(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    return safe_ratio(2.0 * tp, n_pred + n_gold)


def response_counts(items: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a distinct item with its group, one row a response with tp, n_pred, n_gold) by distinct item keys."""
    distinct = items.select("question_id", "response_id", "item_key").distinct()
    labelled = distinct.join(gold.select("question_id", F.col("alias_key").alias("item_key"), "group_id").distinct(), ["question_id", "item_key"], "left")
    n_gold = gold.groupBy("question_id").agg(F.countDistinct("group_id").alias("n_gold"))
    counts = labelled.groupBy("question_id", "response_id").agg(F.countDistinct("group_id").alias("tp"), F.count("*").alias("n_pred"))
    return labelled, counts.join(n_gold, "question_id")


def _capped(pairs: DataFrame, cap: int, *order) -> DataFrame:
    return pairs.withColumn("pair_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("pair_rank") <= cap)


def negative_addition(items: DataFrame, gold: DataFrame, cap: int = 5, least_gain: float = 0.0) -> DataFrame:
    """rejected: a response; chosen: it without one unsupported item (PAR05, PAR19's deletion).

    Taking a wrong item out changes one element, leaves tp and raises F1; the most frequent wrong items come first."""
    labelled, counts = response_counts(items, gold)
    wrong = labelled.where("group_id is null")
    often = wrong.groupBy("question_id", "item_key").agg(F.count("*").alias("times"))
    rows = wrong.join(often, ["question_id", "item_key"]).join(counts, ["question_id", "response_id"])
    before, after = f1_of(F.col("tp"), F.col("n_pred"), F.col("n_gold")), f1_of(F.col("tp"), F.col("n_pred") - 1, F.col("n_gold"))
    rows = rows.where("n_pred > 1").withColumn("gain", F.round(after - before, 9)).where((F.col("gain") > 0) & (F.col("gain") >= least_gain))
    return _capped(rows.select("question_id", "response_id", F.col("item_key").alias("removed"), "times", "gain"), cap, F.desc("times"), F.desc("gain"), "removed", "response_id")


def valid_omission(items: DataFrame, gold: DataFrame, cap: int = 5, fallback: bool = False) -> DataFrame:
    """rejected: a response; chosen: it with one missing gold answer, as another response gave it (PAR06, PAR19's addition).

    With fallback a gold alias that no response gave is used after those."""
    labelled, counts = response_counts(items, gold)
    aliases = gold.select("question_id", "group_id", F.col("alias_key").alias("item_key")).distinct()
    said = labelled.where("group_id is not null").groupBy("question_id", "group_id", "item_key").agg(F.count("*").alias("times"))
    source = aliases.join(said, ["question_id", "group_id", "item_key"], "left") if fallback else said
    source = source.withColumn("times", F.coalesce("times", F.lit(0)))
    one = source.groupBy("question_id", "group_id").agg(F.max(F.struct("times", "item_key")).alias("s")).select("question_id", "group_id", F.col("s.times").alias("times"), F.col("s.item_key").alias("added"))
    held = labelled.where("group_id is not null").select("question_id", "response_id", "group_id").distinct()
    missing = counts.join(one, "question_id").join(held, ["question_id", "response_id", "group_id"], "left_anti")
    before, after = f1_of(F.col("tp"), F.col("n_pred"), F.col("n_gold")), f1_of(F.col("tp") + 1, F.col("n_pred") + 1, F.col("n_gold"))
    rows = missing.withColumn("gain", F.round(after - before, 9)).where("gain > 0")
    return _capped(rows.select("question_id", "response_id", "added", "times", "gain"), cap, F.desc("times"), F.desc("gain"), "added", "response_id")


def substitution(items: DataFrame, gold: DataFrame, cap: int = 5) -> DataFrame:
    """chosen: a response with its most frequent wrong item changed for the most frequent missing answer (PAR19, PAR21)."""
    removed = negative_addition(items, gold, cap=1 << 30).groupBy("question_id", "response_id").agg(F.max(F.struct("times", "removed")).alias("r"))
    added = valid_omission(items, gold, cap=1 << 30).groupBy("question_id", "response_id").agg(F.max(F.struct("times", "added")).alias("a"))
    _, counts = response_counts(items, gold)
    rows = removed.join(added, ["question_id", "response_id"]).join(counts, ["question_id", "response_id"])
    gain = f1_of(F.col("tp") + 1, F.col("n_pred"), F.col("n_gold")) - f1_of(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    return _capped(rows.select("question_id", "response_id", F.col("r.removed").alias("removed"), F.col("a.added").alias("added"), F.round(gain, 9).alias("gain")), cap, F.desc("gain"), "response_id")


def judged_slates(candidates: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """One row a question and answer key with its best class; UNCERTAIN rows go; gold is added as C3 (PAR09, UDF01)."""
    rows = candidates.where("class in ('C1', 'C2', 'C3')").select("question_id", "answer_key", "class", F.lit(False).alias("injected"))
    if gold is not None:
        rows = rows.unionByName(gold.select("question_id", "answer_key", F.lit("C3").alias("class"), F.lit(True).alias("injected")))
    return rows.groupBy("question_id", "answer_key").agg(F.max("class").alias("class"), F.min("injected").alias("injected"))


def class_pairs(slates: DataFrame, per_class: int | None = None) -> DataFrame:
    """All pairs of a better over a worse class (PAR09, PAR10, PAR22); slates hold an answer of a question once.

    With per_class, a sample: each class enters with so many answers, the first by hash."""
    some = slates
    if per_class:
        turn = Window.partitionBy("question_id", "class").orderBy(F.sha2(F.concat_ws(":", F.col("question_id").cast("string"), "answer_key"), 256), "answer_key")
        some = slates.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= per_class)
    side = lambda s: some.select("question_id", F.col("answer_key").alias(s), F.col("class").alias(f"{s}_class"))
    pairs = side("chosen").join(side("rejected"), "question_id").where("chosen_class > rejected_class")
    return pairs.withColumn("stage", F.concat_ws(">", "chosen_class", "rejected_class"))


def ranked_sequences(rows: DataFrame, key: str, gold: str, wrong: str, seed: str = "13") -> DataFrame:
    """All orders of four wrong answers, gold first against gold at the question's rank (PAR16, ARR02, ARR03).

    Ranks 2 to 5 go round the questions in hash order, so each is used equally often up to one."""
    rows = rows.where(F.size(wrong) == 4)
    turn = hash_rank(rows.select(key), hash_order(seed, key), key)
    ranked = turn.select(key, (2 + (F.col("rn") - 1) % 4).cast("int").alias("rejected_rank"))
    orders = F.array(*[F.struct(F.lit(i).alias("permutation"), F.array(*map(F.lit, p)).alias("places")) for i, p in enumerate(permutations(range(4)), 1)])
    out = rows.join(ranked, key).select(key, F.col(gold).alias("_g"), F.col(wrong).alias("_w"), "rejected_rank", F.inline(orders))
    listed = F.transform("places", lambda i: F.get(F.col("_w"), i))
    worse = F.concat(F.slice(listed, F.lit(1), F.col("rejected_rank") - 1), F.array("_g"), F.slice(listed, F.col("rejected_rank"), F.lit(4)))
    return out.select(key, "permutation", "rejected_rank", F.concat(F.array("_g"), listed).alias("preferred"), worse.alias("rejected"), (1.0 / F.col("rejected_rank")).alias("rejected_mrr"))


def dominance_pairs(quality: DataFrame, larger: list[str], smaller: list[str], clean: list[str], cap: int = 2) -> DataFrame:
    """Pairs where the chosen response is no worse in any count and better in one; chosen has none of `clean` (PAR20, JON08).

    A question gives its cap first pairs by (smaller id, larger id).  Dominance follows from the counts alone, so
    responses of equal counts meet as one row with their cap first ids: a pair of a later id has cap pairs before it."""
    counts = list(dict.fromkeys([*larger, *smaller, *clean]))
    turn = Window.partitionBy("question_id", *counts).orderBy("response_id")
    first = quality.select("question_id", "response_id", *counts).withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= cap)
    alike = first.groupBy("question_id", *counts).agg(F.collect_list("response_id").alias("ids"))
    a = alike.where(" and ".join(f"{c} = 0" for c in clean) if clean else "true").alias("a")
    b = alike.alias("b")
    no_worse, better = F.lit(True), F.lit(False)
    for names, sign in ((larger, 1), (smaller, -1)):
        for c in names:
            gap = sign * (F.col(f"a.{c}") - F.col(f"b.{c}"))
            no_worse, better = no_worse & (gap >= 0), better | (gap > 0)
    pairs = a.join(b, (F.col("a.question_id") == F.col("b.question_id")) & no_worse & better)
    rows = pairs.select(F.col("a.question_id").alias("question_id"), F.explode("a.ids").alias("chosen_id"), F.col("b.ids").alias("ids"))
    rows = rows.select("question_id", "chosen_id", F.explode("ids").alias("rejected_id"))
    return _capped(rows, cap, F.least("chosen_id", "rejected_id"), F.greatest("chosen_id", "rejected_id"))


def task_reward(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """F1 with a penalty for a wrong number of answers."""
    return f1_of(tp, n_pred, n_gold) - 0.1 * F.abs(n_pred - n_gold) / F.greatest(n_pred, n_gold)


def dcrm_score(gap: Column, edit: Column, log_gap: Column, epsilon: float = 1e-6) -> Column:
    """(sigmoid(gap) - 1/2) over the distance of the pair (PAR03)."""
    return (1 / (1 + F.exp(-gap)) - 0.5) / (edit + F.abs(log_gap) + epsilon)


def dpo_loss(margin: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta * margin), without overflow for large margins (PAR29)."""
    x = -beta * margin
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def calibrated_loss(chosen: Column, rejected: Column, target: float = 0.5) -> Column:
    """Squared distances of the chosen and the rejected reward from target and -target."""
    return (chosen - target) ** 2 + (rejected + target) ** 2


def anchored_loss(chosen: Column, rejected: Column) -> Column:
    """Pushes the chosen reward up and the rejected one down, each from 0."""
    return (1 - 1 / (1 + F.exp(-chosen))) + 1 / (1 + F.exp(-rejected))
