"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

_SPACE = b" \t\n\r\x0b\x0c"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """One text and its statistics, each computed when first asked for.  A null text has no words."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at ASCII white space exactly

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"#*$%&|<>"))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words, 5)


def repeat_words(words: list[bytes], width: int) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included; exact."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    n, code, room = len(words) - width + 1, ids[: len(words) - width + 1], len(seen)
    for k in range(1, width):
        if room * len(seen) >= 2**62:  # rank the prefixes, so that codes stay exact
            distinct, code = np.unique(code, return_inverse=True)
            room = len(distinct)
        code, room = code * len(seen) + ids[k : k + n], room * len(seen)
    _, code, count = np.unique(code, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(count[code] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Rejects by integer arithmetic, so that any engine gets the same verdicts.
RULES = (
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("letters", lambda t: 100 * sum(1 for w in t.words if _LETTER.search(w)) < 60 * t.n_words),
    Rule("digits", lambda t: 100 * (len(t.raw) - len(t.raw.translate(None, b"0123456789"))) > 30 * t.word_chars),
    Rule("ellipsis_lines", lambda t: 100 * sum(x.rstrip(_SPACE).endswith((b"...", b"\xe2\x80\xa6")) for x in t.lines) > 30 * len(t.lines)),
    Rule("bullet_lines", lambda t: 100 * sum(x.lstrip(_SPACE).startswith((b"-", b"* ", b"\xe2\x80\xa2")) for x in t.lines) > 90 * len(t.lines)),
    Rule("dominant_word", lambda t: t.n_words > 0 and 100 * Counter(t.words).most_common(1)[0][1] > 30 * t.n_words),
)


def base_failed(t: Text) -> bool:
    return t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words


def _measure(rules):
    def run(batches):
        for batch in batches:
            masks, spent = [], np.zeros(len(rules), np.int64)
            for text in batch["text"].to_pylist():
                t, mask = Text(text), 0
                for name in _BASE:
                    getattr(t, name)
                if base_failed(t):
                    continue  # no rule will see it
                for i, rule in enumerate(rules):
                    began = time.perf_counter_ns()
                    mask |= rule.rejects(t) << i  # what the rule costs once the base statistics are there
                    spent[i] += time.perf_counter_ns() - began
                masks.append(mask)
            if not masks:
                continue
            count = Counter(masks)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([spent.tolist()] + [[0] * len(rules)] * (len(count) - 1), pa.list_(pa.int64()))], ["mask", "n", "spent"])

    return run


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[int]:
    """The order in which the rules reject most for their cost: each next rule has the largest share of rejections
    among the sample's survivors, divided by its cost, both over rows that pass the base.  Takes a sample of about sample_rows;
    an empty one keeps the order."""
    prepare(docs.sparkSession)
    total = docs.count()
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / max(1, total)), seed)
    found = sample.mapInArrow(_measure(rules), "mask long, n long, spent array<long>").groupBy("mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("spent")[i]).alias(f"s{i}") for i in range(len(rules))]).collect()
    cost = [1 + sum(r[f"s{i}"] or 0 for r in found) for i in range(len(rules))]  # one row for each combination of verdicts
    left, order = {r["mask"]: r["n"] for r in found}, []
    while len(order) < len(rules):
        rest = [i for i in range(len(rules)) if i not in order]
        best = max(rest, key=lambda i: (sum(n for m, n in left.items() if m >> i & 1) / cost[i], -cost[i]))
        order.append(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _cascade(rules):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(len(_BASE) + 2)]
            for text in batch["text"].to_pylist():
                t = Text(text)
                for column, name in zip(out, _BASE):
                    column.append(getattr(t, name))
                bad = base_failed(t)
                out[-2].append(bad)
                out[-1].append(not bad and not any(rule.rejects(t) for rule in rules))  # any() stops at the first rejection
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, pa.int64()) for c in out[:-2]), pa.array(out[-2], pa.bool_()), pa.array(out[-1], pa.bool_())], ["id", *_BASE, "base_failed", "kept"])

    return run


def quality_cascade(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """One row for each row of docs: key, the base statistics, base_failed and kept (all rules pass).

    The order of the rules changes the cost, never a verdict.  Null and empty texts have no words and fail.
    Repeated rows each keep a row; other columns are not read; empty tables give no rows."""
    prepare(docs.sparkSession)
    order = order_rules(docs, rules, text, sample_rows)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, kept boolean"
    return source.mapInArrow(_cascade([rules[i] for i in order]), schema).withColumnRenamed("id", key)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
p as (select r, unnest(words) as word, unnest(range(len(words))) as i from w),
v as (select r, i, concat_ws(chr(10), word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as g,
        lead(i, 4) over o as last from p window o as (partition by r order by i)),
h as (select r, i from (select r, i, count(*) over (partition by r, g) as c from v where last is not null) where c > 1),
n as (select r, count(distinct i + k) as n_repeat_words from h, range(5) as t(k) group by r),
x as (select r, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as ellipses,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\* |•)'))) as bulleted, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from w),
c as (select r, max(c) as top from (select r, word, count(*) as c from p group by r, word) group by r),
s as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(top, 0) as top, ellipses, bulleted, digits,
        len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]') or strlen(x) > length(x))) as lettered
      from w left join n using (r) left join c using (r) left join x using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2 * n_words and 15 * n_words and 10 * n_symbols <= n_words
  and 100 * n_dup_lines <= 30 * n_lines and 100 * lettered >= 60 * n_words and 100 * top <= 30 * n_words
  and 100 * digits <= 30 * word_chars and 100 * ellipses <= 30 * n_lines and 100 * bulleted <= 90 * n_lines as kept from b
"""
