"""Model responses in JSON: salvage from surrounding text, acceptance with reasons, strict checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How a candidate relates to the first answer, and the kinds of extracted candidates are free text.
RELATIONS = ["original", "harmless_formatting", "abbreviation_expansion", "synonym"]

PARSED = (
    "struct<accepted:array<struct<answer:string,label:string,position:int,snippet_id:string,corrected:boolean>>,"
    "rejected:array<struct<position:int,reason:string>>,issues:array<string>,strict:boolean>"
)


def objects(text: str | None) -> list[dict]:
    """Every JSON object that starts at some brace of text, nested ones too, in order (ARR07)."""
    text, decoder, out, at = text or "", json.JSONDecoder(), [], -1
    while (at := text.find("{", at + 1)) >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
        except (json.JSONDecodeError, RecursionError):
            continue
        out.append(value)
    return out


def folded(text: str) -> str:
    return " ".join(text.casefold().split())


def parse_response(text: str | None, most: int = 10, snippets: list[tuple[str, str]] | None = None, relations: list[str] = RELATIONS) -> dict:
    """accepted and rejected candidates, issues and whether the response kept to its schema (ARR08).

    With snippets (id, text) an answer must stand literally in one; a wrong citation is put right.  Without, candidates
    carry relation types, of which exactly the first is `original`."""
    label = "relation_type" if snippets is None else "candidate_type"
    fields = {"answer", label} | (set() if snippets is None else {"snippet_id"})
    found, issues, accepted, rejected, seen = objects(text), [], [], [], set()
    whole = next((o for o in found if isinstance(o.get("answers"), list)), None)
    if whole is None:
        rows = [o for o in found if fields <= set(o)]
        issues.append("incomplete_json_recovered" if rows else "no_candidates")
    else:
        rows = whole["answers"]
        if set(whole) != {"answers"}:
            issues.append("unexpected_top_level_fields")
        if not 1 <= len(rows) <= most:
            issues.append("answer_count_out_of_range")
    for place, row in enumerate(rows, 1):
        note = lambda what: issues.append(f"candidate_{place}_{what}")  # noqa: B023,E731
        if not isinstance(row, dict):
            note("not_object")
            rejected.append((place, "not_an_object"))
            continue
        if set(row) != fields:
            note("unexpected_fields")
        answer, kind = row.get("answer"), str(row.get(label) or "unrecognized")
        if not isinstance(answer, str) or not answer.strip():
            rejected.append((place, "empty_answer"))
            continue
        cited, corrected = None, False
        if snippets is None:
            if kind not in relations:
                note("invalid_relation_type")
            if (place == 1) != (kind == "original"):
                issues.append("first_candidate_not_original" if place == 1 else f"candidate_{place}_unexpected_original" if kind == "original" else "")
        else:
            holders = [i for i, t in snippets if answer in t]
            if not holders:
                rejected.append((place, "not_literal_in_any_snippet"))
                continue
            cited = str(row.get("snippet_id") or "")
            corrected = cited not in holders
            cited = holders[0] if corrected else cited
        reason = "duplicate_answer" if folded(answer) in seen else None
        seen.add(folded(answer))
        if not reason and len(accepted) >= most:
            reason = "over_the_limit"
        if reason:
            rejected.append((place, reason))
            continue
        if corrected:
            note("citation_corrected")
        accepted.append((answer, kind, place, cited, corrected))
    issues = [i for i in issues if i]
    return {
        "accepted": [dict(zip(("answer", "label", "position", "snippet_id", "corrected"), a)) for a in accepted],
        "rejected": [dict(zip(("position", "reason"), r)) for r in rejected],
        "issues": issues, "strict": all(i.endswith("citation_corrected") for i in issues)}


def parsed(text: Column, most: int = 10) -> Column:
    @F.pandas_udf(PARSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_response(t, most) for t in texts], columns=["accepted", "rejected", "issues", "strict"])

    return run(text)


def parsed_extractive(text: Column, snippets: Column, most: int = 10) -> Column:
    """snippets is array<struct<snippet_id, text>>."""

    @F.pandas_udf(PARSED)
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [parse_response(t, most, [(x["snippet_id"], x["text"] or "") for x in (s if s is not None else [])]) for t, s in zip(texts, found)]
        return pd.DataFrame(rows, columns=["accepted", "rejected", "issues", "strict"])

    return run(text, snippets)


@F.pandas_udf(StringType())
def strict_problem(texts: pd.Series) -> pd.Series:
    """Why a response isn't complete, unrepaired and free of duplicates; null if it is (ARR09)."""

    def check(text):
        try:
            value = json.loads(text or "")
        except ValueError:
            return "not_json"
        if not isinstance(value, dict) or set(value) != {"answers"}:
            return "unexpected_fields"
        rows = value["answers"]
        if not isinstance(rows, list) or not 1 <= len(rows) <= 10:
            return "answer_count"
        if any(not isinstance(r, dict) or set(r) != {"answer", "relation_type"} for r in rows):
            return "candidate_schema"
        if any(not isinstance(r["answer"], str) or not r["answer"].strip() for r in rows):
            return "empty_answer"
        if any(r["relation_type"] not in RELATIONS for r in rows):
            return "relation_type"
        if any((r["relation_type"] == "original") != (i == 0) for i, r in enumerate(rows)):
            return "original_first"
        return "duplicate" if len({folded(r["answer"]) for r in rows}) < len(rows) else None

    return texts.map(check)


def ordered_subset(short: Column, long: Column) -> Column:
    """short's items stand in long in that order, gaps allowed (ARR06)."""
    state = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(acc, x):
        place = F.array_position(F.slice(long, acc["at"] + 1, F.greatest(F.lit(0), F.size(long) - acc["at"])), x).cast("int")
        return F.struct((acc["at"] + place).alias("at"), (acc["ok"] & (place > 0)).alias("ok"))

    return F.aggregate(short, state, step)["ok"]
