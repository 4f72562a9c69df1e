"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties (FTRL-proximal), then calibrated by temperature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BITS, ORDERS = 16, (1, 2, 3)
#: Labelled rows that the classifier is fitted on, about; a share of them only sets the temperature.
TRAIN_ROWS = 4000
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


#: Characters of a text that are in memory as numbers at once.
PIECE = 1 << 18


def ngram_pieces(text: str):
    """ngram_ids in pieces; together the same for any PIECE."""
    text = f" {text.lower()} "
    carry, ended = np.empty(0, np.uint32), False
    for lo in range(0, len(text), PIECE):
        x = np.frombuffer(text[lo : lo + PIECE].encode("utf-32-le", "replace"), np.uint32)
        plain = (x < 128) & ~((x >= 97) & (x <= 122))
        x = np.where(plain, np.uint32(32), x)
        x = x[~(plain & np.concatenate([[ended], plain[:-1]]))]  # runs of such characters are one
        ended = bool(plain[-1])
        x = np.concatenate([carry, x])
        out, h = [], np.zeros(len(x), np.uint32)
        for k in range(max(ORDERS)):
            h = (h[: max(0, len(x) - k)] ^ x[k:]) * _MUL[k]
            if k + 1 in ORDERS:  # runs that end in the carry were there before
                new = h[max(0, len(carry) - k) :]
                out.append((new ^ np.uint32(k * 0x27D4EB2F)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
        carry = x[max(0, len(x) - max(ORDERS) + 1) :]
        yield np.concatenate(out)


def ngram_ids(text: str) -> np.ndarray:
    """Hashed ids of all runs of 1, 2 and 3 characters of the lower-cased text; other characters than letters count as a space."""
    return np.concatenate(list(ngram_pieces(text)))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a text and their counts."""
    if len(text) < PIECE:
        return np.unique(ngram_ids(text), return_counts=True)
    counts = sum(np.bincount(ids, minlength=1 << BITS) for ids in ngram_pieces(text))
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    features: np.ndarray  # those with a weight, sorted
    weights: np.ndarray  # features x languages, IDF and scale and temperature included
    bias: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << BITS, len(self.languages)), np.float32)
        out[self.features] = self.weights
        return out


def predict(model: Model, dense: np.ndarray, text: str | None) -> tuple[str, float]:
    """The language and its calibrated probability; ("und", 0) for texts without a letter, or where nothing was learned."""
    if not has_letter(text) or not model.languages:
        return "und", 0.0
    total, n = np.zeros(len(model.languages)), 0
    for ids in ngram_pieces(text):
        total += dense[ids].sum(0, dtype=np.float64)
        n += len(ids)
    z = total / n + model.bias
    p = np.exp(z - z.max())
    p /= p.sum()
    best = int(p.argmax())
    return model.languages[best], float(p[best])


SCALE = 30.0


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: tuple[str, ...], l1: float = 0.02, l2: float = 0.05, alpha: float = 0.3, beta: float = 1.0, epochs: int = 3, seed: int = 3) -> Model:
    """rows: (language index, n-gram ids, counts).  Every fifth row sets the temperature and is not learned from."""
    size, k = 1 << BITS, len(languages)
    learn = [r for i, r in enumerate(rows) if i % 5] or rows
    hold = rows[::5]
    seen = np.zeros(size)
    for _, ids, _ in learn:
        seen[ids] += 1
    idf = np.log((1 + len(learn)) / (1 + seen)) + 1
    z, n, w = np.zeros((size, k)), np.zeros((size, k)), np.zeros((size, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weight(z, n, l1=l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    def value(ids, counts):
        return SCALE * counts / counts.sum() * idf[ids]

    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            y, ids, counts = learn[i]
            x = value(ids, counts)
            w, b = weight(z[ids], n[ids]), weight(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[ids] + g * g
            z[ids] += g - (np.sqrt(grown) - np.sqrt(n[ids])) / alpha * w
            n[ids] = grown
            grown = nb + p * p
            zb += p - (np.sqrt(grown) - np.sqrt(nb)) / alpha * b
            nb = grown
    w, b = weight(z, n), weight(zb, nb, 0.0)
    scores = np.array([value(ids, counts) @ w[ids] + b for _, ids, counts in hold]).reshape(-1, k)
    truth = np.array([y for y, _, _ in hold], int)

    def loss(t):
        s = scores * t
        s = s - s.max(1, keepdims=True)
        log_p = s - np.log(np.exp(s).sum(1, keepdims=True))
        doubt = 1 / (len(truth) + 2)  # Platt's smoothed targets: separable rows give no certainty
        other = (log_p.sum(1) - log_p[np.arange(len(truth)), truth]) / max(1, k - 1)
        return -float(((1 - doubt) * log_p[np.arange(len(truth)), truth] + doubt * other).mean()) if len(truth) else 0.0

    t = min(np.geomspace(0.05, 8, 60), key=loss)  # an inverse temperature
    kept = np.flatnonzero(np.abs(w).sum(1))
    return Model(languages, kept, (w[kept] * idf[kept, None] * SCALE * t).astype(np.float32), b * t)


def held_out(key: str) -> Column:
    """crc32 of the key as text, modulo 4, is 2; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches):
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            ids, counts = ngram_counts(text)
            out.append((ids.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["lang", "ids", "counts"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fits on a sample of about `rows` labelled rows outside the held-out fold, as many of each language as there are, or an
    equal share.  The sample goes by a hash of row content, so that reruns agree.  The driver gets at most 8 bytes for each
    feature of a row, of which there are 2**16, whatever the length of the texts.  No labelled rows: a model that says "und"."""
    prepare(docs.sparkSession)
    pool = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[lang]: r["count"] for r in docs.where(~held_out(key) & F.col(lang).isNotNull()).groupBy(lang).count().collect()}  # a number a language
    each = rows / max(1, len(counts))
    place = F.pmod(F.xxhash64(F.lit(5), key, text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(each / n))]) if counts else None
    if not counts:
        return Model((), np.empty(0, int), np.empty((0, 0), np.float32), np.empty(0))
    picked = pool.where(place < share[F.col(lang)]).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text, lang).alias("row"))
    picked = picked.dropDuplicates(["row"]).select("lang", "text")  # repeated rows have one place and come together
    found = picked.mapInArrow(_features, "lang string, ids binary, counts binary").collect()
    languages = tuple(sorted({r["lang"] for r in found}))
    found.sort(key=lambda r: (hash_bytes(r["ids"]), r["lang"]))
    sample = [(languages.index(r["lang"]), np.frombuffer(r["ids"], "<u4").astype(int), np.frombuffer(r["counts"], "<u4").astype(float)) for r in found]
    return fit(sample, languages)


def hash_bytes(x: bytes) -> bytes:
    import hashlib

    return hashlib.md5(x).digest()


_dense: dict = {}


def _predict(model: Model, token: str):
    def run(batches):
        if token not in _dense:
            _dense.clear()
            _dense[token] = model.dense()
        for batch in batches:
            got = [predict(model, _dense[token], t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, held_out, lang_pred, score, from the whole text alone.

    Null texts and texts without a letter: "und", 0.  Repeated rows each keep a row; an empty table gives none; other
    columns are not read."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    kind = source.schema["id"].dataType.simpleString()
    token = hash_bytes(model.weights.tobytes() + model.bias.tobytes()).hex()
    return source.mapInArrow(_predict(model, token), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", key)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, in docs' columns, whatever their names.

    Null texts and texts without a letter go; repeated rows go or stay together; an empty table stays empty."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        dense = model.dense()
        for batch in batches:
            got = [predict(model, dense, t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([a != "und" and b >= least for a, b in got], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
