"""What models say, as tables: cached scores and responses are joined, and what is missing is told or called for.

No operator here calls a service by itself; a caller passes a function, which then runs once a batch on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of similarity and entailment.
MATCH, UNCERTAIN, NO_MATCH = 0.90, 0.82, 0.50
NLI_MATCH, NLI_UNCERTAIN = 0.80, 0.60


def request_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def cached_or_called(requests: DataFrame, cache: DataFrame, call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, budget: int = 0) -> DataFrame:
    """requests(request_sha256, ...) with response and origin: cache, call or pending (SRC28, UDF05).

    Each distinct missing request is called once, the first `budget` of them in hash order; without a function all stay
    pending.  call gets and gives frames of (request_sha256, payload) and (request_sha256, response)."""
    known = cache.select("request_sha256", F.col("response").alias("_cached")).dropDuplicates(["request_sha256"])
    joined = requests.join(known, "request_sha256", "left")
    if call is None or budget <= 0:
        return joined.select(*requests.columns, F.col("_cached").alias("response"), F.when(F.col("_cached").isNotNull(), "cache").otherwise("pending").alias("origin"))
    missing = joined.where("_cached is null").select("request_sha256", "payload").dropDuplicates(["request_sha256"]).orderBy("request_sha256").limit(budget)
    called = missing.mapInPandas(call, "request_sha256 string, response string").withColumnRenamed("response", "_called")
    both = joined.join(called, "request_sha256", "left")
    origin = F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_called").isNotNull(), "call").otherwise("pending")
    return both.select(*requests.columns, F.coalesce("_cached", "_called").alias("response"), origin.alias("origin"))


def hybrid_label(level: Column, similarity: Column, forward: Column, backward: Column, contradiction: Column) -> Column:
    """struct(matched, match_type, uncertain): rules first, then embedding similarity, then entailment both ways (STR38).

    level is the rules' match or null; scores are null where no model was asked.  Between the thresholds of similarity,
    entailment decides; without it the pair stays uncertain."""
    out = lambda matched, kind, uncertain=False: F.struct(F.lit(matched).alias("matched"), kind.alias("match_type"), F.lit(uncertain).alias("uncertain"))
    entailed = F.least(forward, backward)
    band = F.when(similarity >= UNCERTAIN, F.lit("biomedical_embedding_ambiguous")).otherwise("biomedical_embedding_review_band")
    return (
        F.when(level.isNotNull(), out(True, level))
        .when(similarity >= MATCH, out(True, F.lit("biomedical_embedding_match")))
        .when(similarity <= NO_MATCH, out(False, F.lit("biomedical_embedding_low_similarity_no_match")))
        .when(entailed.isNull(), F.when(similarity.isNull(), out(False, F.lit("not_scored"), True)).otherwise(out(False, band, True)))
        .when((entailed >= NLI_MATCH) & (contradiction < 0.5), out(True, F.lit("nli_equivalence_match")))
        .when(entailed >= NLI_UNCERTAIN, out(False, F.lit("nli_equivalence_ambiguous"), True))
        .when(contradiction >= NLI_MATCH, out(False, F.lit("nli_contradiction_no_match")))
        .otherwise(out(False, F.lit("nli_no_match"))))


def matched_items(items: DataFrame, gold: DataFrame, equal: DataFrame) -> DataFrame:
    """items with item_key replaced by the gold alias that equal(question_id, item_key, alias_key) matches it with (PAR08).

    Set edits then run on them unchanged, whatever predicate made `equal`; the smallest alias is taken of several."""
    known = equal.join(gold.select("question_id", "alias_key").distinct(), ["question_id", "alias_key"], "left_semi")
    one = known.groupBy("question_id", "item_key").agg(F.min("alias_key").alias("_alias"))
    return items.join(one, ["question_id", "item_key"], "left").withColumn("item_key", F.coalesce("_alias", "item_key")).drop("_alias")


def left_truncated(prompt: Column, answer: Column, most: int) -> Column:
    """struct(ids, prompt_length, dropped): prompt ids cut from the left so that prompt and answer fit `most` (UDF08).

    The answer stays whole; one that is too long by itself leaves no prompt and is cut from the right."""
    room = F.greatest(F.lit(0), F.lit(most) - F.size(answer))
    kept = F.when(room > 0, F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), F.greatest(F.lit(1), room))).otherwise(F.slice(prompt, 1, 0))
    return F.struct(F.slice(F.concat(kept, answer), 1, most).alias("ids"), F.size(kept).alias("prompt_length"), (F.size(prompt) - F.size(kept)).alias("dropped"))


def log_probs(scores: Column, prompt_length: Column) -> Column:
    """struct(total, mean, tokens) of the log-probabilities after the prompt; null where there are none (UDF08)."""
    told = F.filter(F.transform(scores, lambda x, i: F.when(i >= prompt_length, x)), lambda x: x.isNotNull())
    total = F.aggregate(told, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(told) > 0, F.struct(total.alias("total"), (total / F.size(told)).alias("mean"), F.size(told).alias("tokens")))


def reranked(candidates: DataFrame, logits: DataFrame, key: str, unit: str, ties: list[str]) -> DataFrame:
    """candidates with score = yes - no of logits(key, unit, yes, no) and their rank in the key (UDF10); unscored ones come last with null."""
    scored = candidates.join(logits.select(key, unit, (F.col("yes") - F.col("no")).alias("score")), [key, unit], "left")
    return scored.withColumn("reranker_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), *ties)))


def judged(rows: DataFrame, response: str, snippet_ids: str) -> DataFrame:
    """rows with what a judge's JSON answer says and whether it may be used (UDF03, UDF04).

    The answer is {"verdict", "equivalence", "evidence": [snippet ids]}.  problem: pending without an answer, not_json, an
    unknown verdict, evidence that is not among the row's snippets, or a supported verdict without evidence; else null."""
    said = F.from_json(response, "struct<verdict:string,equivalence:string,evidence:array<string>>")
    cited = F.coalesce(said["evidence"], F.array().cast("array<string>"))
    problem = (
        F.when(F.col(response).isNull(), "pending").when(said["verdict"].isNull(), "not_json").when(~said["verdict"].isin("supported", "unsupported", "uncertain"), "unknown_verdict")
        .when(F.size(F.array_except(cited, F.col(snippet_ids))) > 0, "unknown_evidence").when((said["verdict"] == "supported") & (F.size(cited) == 0), "no_evidence"))
    return rows.withColumns({"verdict": said["verdict"], "equivalence": said["equivalence"], "problem": problem})


def annotated(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """pairs with rationale and origin (UDF02): notes(chosen_id, rejected_id, rationale) as annotators gave them; blank ones count as missing."""
    told = notes.select("chosen_id", "rejected_id", F.nullif(F.trim("rationale"), F.lit("")).alias("rationale"))
    joined = pairs.join(told, ["chosen_id", "rejected_id"], "left")
    return joined.withColumn("origin", F.when(F.col("rationale").isNotNull(), "annotated").otherwise("missing"))


def multitask_rows(pairs: DataFrame, chosen: str, rejected: str, rationale: str) -> DataFrame:
    """Training rows of a pair (PAR27): the answer, the judgment of both sides, and, where there is a rationale, the explanation of the error."""
    task = lambda name, source, target: F.struct(F.lit(name).alias("task"), source.cast("string").alias("source"), target.cast("string").alias("target"))
    none = F.lit("")
    tasks = F.array(
        task("answer", none, F.col(chosen)), task("judge", F.col(chosen), F.lit("right")), task("judge", F.col(rejected), F.lit("wrong")),
        F.when(F.col(rationale).isNotNull(), task("explain", F.col(rejected), F.col(rationale))))
    return pairs.select("*", F.inline(F.array_compact(tasks)))
