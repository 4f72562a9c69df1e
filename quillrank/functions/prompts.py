"""Prompts as plain text and as chat, and token distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import clean_multiline, clean_text

# Section marks of plain prompts, the header of a resource, and role marks of chat prompts.
QUESTION, RESOURCES, ANSWER = "# Question:", "# PubMed resources:", "# Answer:"
RESOURCE_START = r"(?:PubMed ID:|Document:)"
BEGIN, TURN, END = "<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>"


def plain_prompt(instruction: Column, question: Column, resources: Column, answer: Column | None = None, stop: str = "") -> Column:
    """Instruction, question, resources and, if given, the answer (PRJ08)."""
    lines = F.array_join(F.filter(F.transform(resources, clean_multiline), lambda r: r != ""), "\n")
    shown = F.when(lines != "", F.concat(F.lit(" "), lines)).otherwise("")
    tail = F.lit("") if answer is None else F.concat(F.lit(" "), clean_text(answer), F.lit(f" {stop}" if stop else ""))
    return F.concat(clean_multiline(instruction), F.lit(f"\n\n{QUESTION} "), clean_text(question), F.lit(f"\n{RESOURCES}"), shown, F.lit(f"\n{ANSWER}"), tail)


def parse_plain(prompt: Column) -> Column:
    """(instruction, question, resources) of a plain prompt; null without its marks (PRJ17).

    A resource begins at a line with a header; evidence without headers is one resource."""
    body = F.regexp_extract(prompt, rf"(?s)^(.*?){QUESTION}(.*){ANSWER}", 2)
    question, block = F.split(body, RESOURCES, 2)[0], F.coalesce(F.get(F.split(body, RESOURCES, 2), F.lit(1)), F.lit(""))
    parts = F.split(clean_multiline(block), rf"\n(?={RESOURCE_START})")
    found = F.filter(parts, lambda r: r != "")
    return F.when(prompt.rlike(rf"(?s){QUESTION}.*{ANSWER}"), F.struct(clean_multiline(F.split(prompt, QUESTION, 2)[0]).alias("instruction"), clean_text(question).alias("question"), found.alias("resources")))


def chat_prompt(instruction: Column, question: Column, resources: Column, prefix: str = "Answer:") -> Column:
    """System and user turns, open at the assistant's; white space collapsed."""
    listed = F.array_join(F.transform(resources, lambda r, i: F.concat(F.lit("Resource "), (i + 1).cast("string"), F.lit(": "), clean_multiline(r))), " ")
    user = F.concat(F.lit("Question: "), clean_text(question), F.when(F.size(resources) > 0, F.concat(F.lit(" PubMed resources: "), listed)).otherwise(""))
    turn = lambda role: F.lit(TURN.format(role=role))
    return clean_text(F.concat(F.lit(BEGIN), turn("system"), clean_multiline(instruction), F.lit(END), turn("user"), user, F.lit(END), turn("assistant"), F.lit(prefix)))


def token_edits(a: list, b: list) -> int:
    """Unit-cost edit distance of two sequences, a row of the table at a time: insertions run along a row, so its least
    values are a running minimum of value minus place."""
    known = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([known[t] for t in s], np.int64) for s in (a, b))
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, token in enumerate(x, 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != token))])
        row = np.minimum.accumulate(step - place) + place
    return int(row[-1])


@F.pandas_udf(LongType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR24; null is an empty sequence."""
    return pd.Series([token_edits([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b)], dtype="int64")
