"""Secret scans: base patterns, and random strings that a tiktoken vocabulary encodes poorly."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .vocabulary import encoder

VOCABULARY = "byte_bpe_50k"
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = (b"passw", b"secret", b"token", b"api")
#: The same matches as the open-ended patterns with the short ones dropped: a run too short has no long part.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: A string of MIN_CHARS or more with fewer characters for each token than RATIO is random.
MIN_CHARS, RATIO = 20, 2.1
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:sha(?:1|224|256|384|512)|md5)?-?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_UUID_OR_DIGEST = (_DIGEST, _UUID)
#: Parts of a name: digits, a capitalised or lower-case word, a run of capitals.
_PART = re.compile(r"[0-9]+|[A-Z]?[a-z]+|[A-Z]+")
#: A string is a name where this share of its letters stands in parts of three letters or more that read as words, that
#: is, take at most one token for each WORD_CHARS letters.
NAME_SHARE, WORD_CHARS = 0.8, 3


def _tokens(text: str) -> int:
    return len(encoder(VOCABULARY)(text))


def is_name(string: str) -> bool:
    """Words joined by separators or case, as identifiers are.  The words are told by the vocabulary, not by their case."""
    letters = known = 0
    for part in _PART.findall(string):
        if part.isalpha():
            letters += len(part)
            known += len(part) * (len(part) >= 3 and WORD_CHARS * (_tokens(" " + part.lower()) - 1) < len(part))
    return known >= NAME_SHARE * letters


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    found = [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    low = text.encode().lower()  # bytes: A-Z alone change
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def is_random(string: str) -> bool:
    """The token-efficiency test, without known digests and identifiers (names, numbers, UUIDs)."""
    if len(string) >= RATIO * _tokens(string) or any(p.fullmatch(string) for p in _UUID_OR_DIGEST):
        return False
    return not is_name(string)


def random_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Random strings outside the base spans, which come by start; what a base span leaves of a string is judged by itself."""
    out, i, reach = [], 0, 0

    def judge(a, b):
        if b - a >= MIN_CHARS and is_random(text[a:b]):
            out.append((a, b, "random"))

    for m in _CANDIDATE.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            judge(max(m.start(), reach), base[i][0])
            reach, i = max(reach, base[i][1]), i + 1
        judge(max(m.start(), reach), m.end())
    return out


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(batches):
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            base = base_spans(text or "")
            spans = sorted(base + random_spans(text or "", base), key=lambda x: (x[0], (*KINDS, "random").index(x[2])))
            kinds = [k for _, _, k in base]
            out.append((*map(kinds.count, KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
        columns = zip(zip(*out), (*[pa.int64()] * 3, pa.string(), pa.string()))
        yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, t) for c, t in columns)], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end" by start, comma-joined).

    Whole texts; null is empty and has no span.  Repeated rows each keep a row; an empty table gives none; other columns
    are not read."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_scan, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", key)


def redacted(text: str | None, mask: str = "[SECRET]") -> str | None:
    """text with each stretch of spans replaced."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, b, _ in sorted(base + random_spans(text, base)):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with the secrets in text replaced, and their length column, if one is named, brought up to date.

    Null stays null; other columns, whatever their names, stay as they are; an empty table stays empty."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.set_column(place, batch.schema.field(place), pa.array([redacted(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type))

    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = out.mapInArrow(run, out.schema)
    if length:
        at = docs.columns.index(length)
        out = out.withColumn(f"c{at}", F.length(f"c{place}").cast(docs.schema[at].dataType))
    return out.toDF(*docs.columns)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
