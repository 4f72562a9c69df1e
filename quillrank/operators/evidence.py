"""Evidence: resources, snippets, what of the gold they show, and what fits a budget.  All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import contains_tokens, relevance
from ..functions.text import clean_text, compact_key, loose_key, truncate


def resources(inputs: Column) -> Column:
    """The cleaned, non-empty values of keys input_2, input_3, ... of a map, in numeric order (PRJ01)."""
    number = lambda e: F.regexp_extract(e["key"], r"^input_(\d+)$", 1).try_cast("int")
    found = F.filter(F.map_entries(inputs), lambda e: number(e) >= 2)
    ordered = F.array_sort(F.transform(found, lambda e: F.struct(number(e).alias("n"), clean_text(e["value"]).alias("t"))))
    return F.filter(F.transform(ordered, lambda e: e["t"]), lambda t: t != "")


def document_number(url: Column) -> Column:
    """The number that ends a document's address, else null (PRJ02)."""
    found = F.regexp_extract(url, r"(\d+)/?\s*$", 1)
    return F.when(found != "", found)


def serialized(header: Column, snippets: Column, max_chars: int = 4000) -> Column:
    """A header line and one marked line a snippet with its sections (PRJ03); snippets hold text, begin, end."""
    line = lambda s: F.concat(F.lit("[BS]"), clean_text(s["text"]), F.lit("[ES]"), F.when(s["begin"].isNotNull(), F.concat(F.lit(" ("), s["begin"], F.lit(" -> "), F.coalesce(s["end"], s["begin"]), F.lit(")"))).otherwise(""))
    return truncate(F.array_join(F.concat(F.array(header), F.transform(snippets, line)), "\n"), max_chars)


def by_document(snippets: DataFrame, key: str, url: str = "document", text: str = "text", order: str = "ord") -> DataFrame:
    """One row a question and document, in order of first mention; a snippet without a document is its own (PRJ04)."""
    named = snippets.withColumn("_doc", F.coalesce(F.col(url), F.concat(F.lit("document_"), F.col(order).cast("string"))))
    grouped = named.groupBy(key, F.col("_doc").alias(url)).agg(F.min(order).alias("first_ord"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(text).alias("text")))).alias("s"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first_ord", url))
    return grouped.select(key, url, place.alias("place"), F.transform("s", lambda x: x["text"]).alias("texts"))


def top_padded(items: Column, n: int) -> Column:
    """The first n items, empty strings where there are fewer (PRJ06)."""
    kept = F.slice(items, 1, n)
    return F.concat(kept, F.array_repeat(F.lit(""), F.lit(n) - F.size(kept)))


def snippets_of(text: Column) -> Column:
    """(snippet_id S1, S2, ..., text) of marked blocks (STR29)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\[BS\](.*?)\[ES\]"), F.lit(1)), clean_text)
    return F.transform(F.filter(found, lambda t: t != ""), lambda t, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("snippet_id"), t.alias("text")))


def malformed_snippets(text: Column) -> Column:
    """Marks don't pair up."""
    count = lambda t: F.size(F.split(text, rf"\[{t}\]")) - 1
    return count("BS") != count("ES")


def evidence_ids(candidate: Column, snippets: Column) -> Column:
    """Snippets whose compact key holds the candidate's (STR28)."""
    key = compact_key(candidate)
    return F.transform(F.filter(snippets, lambda s: (key != "") & F.contains(compact_key(s["text"]), key)), lambda s: s["snippet_id"])


def visible(aliases: Column, texts: Column) -> Column:
    """Whether any alias stands in any text, by normalized substring (FLT10, SFT02)."""
    return F.exists(aliases, lambda a: (loose_key(a) != "") & F.exists(texts, lambda t: F.contains(loose_key(t), loose_key(a))))


def gold_coverage(groups: Column, texts: Column) -> Column:
    """Share of alias groups that the joined texts show; no groups gives 0."""
    joined = loose_key(F.array_join(texts, "\n"))
    shown = F.filter(groups, lambda g: F.exists(g, lambda a: (loose_key(a) != "") & F.contains(joined, loose_key(a))))
    return F.when(F.size(groups) > 0, F.size(shown) / F.size(groups)).otherwise(F.lit(0.0))


def canonical_alias(groups: Column, evidence: Column) -> Column:
    """The alias to teach: of the first group that evidence shows the richest shown alias, else the first group's richest (PRJ15).

    Richest: a digit, a parenthesis, more words, more characters; the earliest of equals."""
    text = loose_key(evidence)
    score = lambda a, i: F.struct(a.rlike(r"\d").cast("int"), F.contains(a, F.lit("(")).cast("int"), F.size(F.split(a, " ")), F.length(a), -i, a.alias("alias"))
    best = lambda aliases: F.array_max(F.transform(aliases, score))["alias"]
    shown = F.filter(F.transform(groups, lambda g: F.filter(g, lambda a: (loose_key(a) != "") & F.contains(text, loose_key(a)))), lambda g: F.size(g) > 0)
    first = F.filter(groups, lambda g: F.size(g) > 0)
    return F.coalesce(F.when(F.size(shown) > 0, best(F.get(shown, F.lit(0)))), best(F.get(first, F.lit(0))))


def answer_documents(texts: Column, aliases: Column, most: int = 5) -> Column:
    """The first texts, in order, that hold an alias (SFT03)."""
    return F.slice(F.filter(texts, lambda t: visible(aliases, F.array(t))), 1, most)


def occurrence_labels(questions: DataFrame, key: str, aliases: str, snippets: str) -> DataFrame:
    """One row an alias and snippet with whether it stands there whole, or why it can't (SFT06)."""
    rows = questions.select(key, F.explode(aliases).alias("alias"), F.col(snippets).alias("_s")).select(key, "alias", F.inline("_s"))
    a, t = loose_key(F.col("alias")), loose_key(F.col("text"))
    return rows.select(key, "alias", "snippet_id", contains_tokens(t, a).alias("hit"), F.when(a == "", "empty_alias").when(t == "", "empty_snippet").when(~contains_tokens(t, a), "absent").alias("reason"))


def fitting(snippets: Column, cost, budget: int, required: Column | None = None) -> Column:
    """Required snippets, then each other one in order that still fits; original order kept (SFT15).

    The fold keeps the tokens spent and the places taken; a misfit is skipped and later ones may still fit.  Null
    if the required ones alone don't fit."""
    needed = lambda s: F.array_contains(required, s["snippet_id"]) if required is not None else F.lit(False)
    start = F.aggregate(snippets, F.lit(0).cast("long"), lambda a, s: a + F.when(needed(s), cost(s).cast("long")).otherwise(0))
    empty = F.array().cast("array<int>")
    state = F.struct(start.alias("spent"), empty.alias("taken"))

    def step(acc, i):
        s = F.get(snippets, i)
        fits = ~needed(s) & (acc["spent"] + cost(s) <= budget)
        return F.struct((acc["spent"] + F.when(fits, cost(s).cast("long")).otherwise(0)).alias("spent"), F.when(fits | needed(s), F.concat(acc["taken"], F.array(i))).otherwise(acc["taken"]).alias("taken"))

    places = F.when(F.size(snippets) > 0, F.sequence(F.lit(0), F.size(snippets) - 1)).otherwise(empty)
    taken = F.aggregate(places, state, step)["taken"]
    return F.when(start <= budget, F.transform(taken, lambda i: F.get(snippets, i)))


def best_window(tokens: Column, size: int, question: Column, answer: Column) -> Column:
    """The half-overlapping window of tokens that is most relevant; the earliest of equals (STR45)."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), F.lit(max(1, size // 2)))
    text = lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(size)), " ")
    scored = F.transform(starts, lambda i: F.struct(relevance(text(i), question, answer).alias("score"), (-i).alias("at"), text(i).alias("text")))
    return F.array_max(scored)["text"]


def in_prompt(candidate: Column, prompt: Column, opens: str = "PubMed resources:", closes: str = "Answer:") -> Column:
    """The candidate stands whole in the prompt's resource section (FLT12)."""
    section = F.substring_index(F.element_at(F.split(prompt, opens, 2), -1), closes, 1)
    return F.contains(prompt, F.lit(opens)) & contains_tokens(loose_key(section), loose_key(candidate))


def numbered(text: Column, marks: Column) -> Column:
    """text with [n] put before each mark (offset, n), from the end so that offsets hold (PRJ19)."""
    ordered = F.array_sort(marks, lambda a, b: F.when(a["offset"] > b["offset"], -1).when(a["offset"] < b["offset"], 1).when(a["n"] > b["n"], -1).otherwise(1))
    return F.aggregate(ordered, text, lambda t, m: F.concat(F.substring(t, F.lit(1), m["offset"]), F.lit("["), m["n"].cast("string"), F.lit("] "), F.substring(t, m["offset"] + 1, F.length(t))))


def with_reminder(prompt: Column, reminder: str, marker: str = "Answer:") -> Column:
    """The reminder before the last marker, or at the end; once only (PRJ18)."""
    head = F.regexp_extract(prompt, rf"(?s)^(.*)\Q{marker}\E", 1)
    tail = F.element_at(F.split(prompt, rf"\Q{marker}\E"), -1)
    placed = F.when(F.contains(prompt, F.lit(marker)), F.concat(head, F.lit(reminder + "\n" + marker), tail)).otherwise(F.concat(F.rtrim(prompt), F.lit("\n" + reminder)))
    return F.when(F.contains(prompt, F.lit(reminder)), prompt).otherwise(placed)


def formulations(questions: DataFrame, key: str, answers: str) -> DataFrame:
    """Each question in two paired formulations (SFT11): original asks for one answer, expansion for all; a question without answers has neither."""
    some = questions.where(F.size(answers) > 0)
    forms = F.array(
        F.struct(F.lit("original").alias("formulation"), F.slice(answers, 1, 1).alias("targets")),
        F.struct(F.lit("expansion").alias("formulation"), F.array_distinct(F.col(answers)).alias("targets")))
    return some.select(key, F.inline(forms))


def packets(questions: DataFrame, snippets: DataFrame, key: str, aliases: str) -> DataFrame:
    """One packet a question (SFT08): its aliases, its snippets in order, which of them show an alias, and a hash of all that a judge would see."""
    listed = snippets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("snippet_id", "text"))).alias("snippets"))
    rows = questions.join(listed, key, "left").withColumn("snippets", F.coalesce("snippets", F.array().cast(listed.schema["snippets"].dataType)))
    shown = F.transform(F.filter("snippets", lambda s: visible(F.col(aliases), F.array(s["text"]))), lambda s: s["snippet_id"])
    return rows.withColumn("shown_in", shown).withColumn("input_sha256", F.sha2(F.to_json(F.struct(key, aliases, "snippets")), 256))


def recovered(expected: DataFrame, shards: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A bank put together again from journal shards (ORC14): the last value of each key, and keys that no shard or no plan has."""
    last = shards.groupBy(key).agg(F.max_by(value, order).alias(value))
    joined = expected.select(key, F.lit(True).alias("_planned")).distinct().join(last, key, "full")
    state = F.when(F.col("_planned").isNull(), "unexpected").when(F.col(value).isNull(), "missing").otherwise("present")
    return joined.select(key, value, state.alias("state"))
