"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A map task hashes all windows of its texts and deals packed (hash, position) arrays to hash buckets, each
distinct hash of a flush once (map-side combine: a hot passage sends one entry a flush, whatever its copies).
Buckets find hashes that occur twice or more and send back packed positions; a flush's positions merge into
maximal removal intervals for each text.  Texts then meet their intervals by a 96-bit key of row content."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buckets, mix, prepare, row_key, word_hashes

#: Words of one flush: so many, or FILL for each bucket, so that its entries stay packed where buckets are many.
FLUSH_WORDS, FILL = 1_000_000, 16
#: Bits of the second hash, which number the buckets.
SIDE = 18
_PACKED = "bucket int, flush string, docs binary, at_low binary, at_high binary, hashes binary"
_FOUND = "flush string, docs binary, at binary"
_SPANS = "_k1 long, _k2 int, spans binary"
_DOC = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("words", "<i8")])
P = U(2**61 - 1)
#: Two bases of the Rabin-Karp polynomials, drawn once.
BASES = (U(0x0B5C1E6F2A9D3847), U(0x14D9A7C36E0F5B29))
_LOW30, _LOW31 = U(2**30 - 1), U(2**31 - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> U(61))
    return np.where(x >= P, x - P, x)


def times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo the prime P, for x and c below it: halves of 31 bits, of which no sum leaves 64 bits."""
    ch, cl, xh, xl = U(c >> 31), U(c & (2**31 - 1)), x >> U(31), x & _LOW31
    middle = xh * cl + xl * ch
    return _reduced(U(2) * xh * ch + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + xl * cl)


def window_hashes(x: np.ndarray, width: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Rabin-Karp hash modulo the prime 2**61 - 1 of each run of width values, by doubling."""
    if len(x) < width:
        return np.empty(0, U)
    run = _reduced(x)
    out, done, size, run_power = None, 0, 1, int(base)
    while True:
        if width & size:
            if out is None:
                out, done = run, size
            else:  # out covers the first `done` values, run the next `size`
                n = len(x) - done - size + 1
                out = _reduced(times(out[:n], run_power) + run[done : done + n])
                done += size
        if size * 2 > width:
            return out[: len(x) - width + 1]
        run = _reduced(times(run[: len(run) - size], run_power) + run[size:])
        run_power, size = run_power**2 % int(P), size * 2


def _pack(name, hashes, keys, words, width, n_buckets):
    """One flush: rows for the buckets, and one row with the texts and the repeats seen here already.

    Its name follows from the partition and the texts, so that a task run again makes the same rows."""
    ends = np.cumsum(words)
    at = np.arange(max(0, len(hashes) - width + 1))
    room = np.repeat(ends, words)[: len(at)]
    fits = at + width <= room
    at = at[fits]
    strong = mix(window_hashes(hashes, width)[fits])
    side = mix(window_hashes(hashes, width, BASES[1])[fits]) >> U(64 - SIDE)
    order = np.argsort((side << U(64 - SIDE)) | (strong >> U(SIDE)), kind="stable")
    s, d = strong[order], side[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    local = np.sort(at[order[same[:-1] | same[1:]]])
    keep = np.sort(order[~same[:-1]])
    at, strong = at[keep], strong[keep]
    bucket = ((side[keep] * U(n_buckets)) >> U(SIDE)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    at, strong = at[order], strong[order]
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    docs = np.empty(len(words), _DOC)
    docs["k1"], docs["k2"], docs["words"] = keys[0], keys[1], words
    name = f"{name}-{hashlib.md5(docs.tobytes()).hexdigest()}"
    rows = [(int(name[-7:], 16) % n_buckets, name, docs.tobytes(), local.astype("<u4").tobytes(), b"", b"")]
    for b in np.flatnonzero(np.diff(cuts)):
        step = np.diff(at[cuts[b] : cuts[b + 1]], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
        # gaps between positions: low bytes, then the three others, which compress to almost nothing
        rows.append((int(b), name, None, step[:, 0].tobytes(), step[:, 1:].T.tobytes(), strong[cuts[b] : cuts[b + 1]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), *[pa.binary()] * 4))], ["bucket", "flush", "docs", "at_low", "at_high", "hashes"])


def _windows(width: int, n_buckets: int):
    flush_words = max(FLUSH_WORDS, FILL * n_buckets)

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        hashes, k1, k2, words, n = [], [], [], [], 0
        for batch in batches:
            h, w = word_hashes(batch["text"], lower=False)
            ends = np.cumsum(w)
            lo = 0
            while lo < len(w):  # a flush ends after the text that fills it
                hi = min(len(w), int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + flush_words - n)) + 1)
                a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
                hashes.append(h[a:b])
                words.append(w[lo:hi])
                k1.append(batch["_k1"].to_numpy(zero_copy_only=False)[lo:hi])
                k2.append(batch["_k2"].to_numpy(zero_copy_only=False)[lo:hi])
                n, lo = n + b - a, hi
                if n >= flush_words:
                    yield _pack(f"{part}-{count}", np.concatenate(hashes), (np.concatenate(k1), np.concatenate(k2)), np.concatenate(words), width, n_buckets)
                    hashes, k1, k2, words, n, count = [], [], [], [], 0, count + 1
        if words:
            yield _pack(f"{part}-{count}", np.concatenate(hashes), (np.concatenate(k1), np.concatenate(k2)), np.concatenate(words), width, n_buckets)

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """One bucket: positions of the hashes that more than one flush holds."""
    rows = table.to_pylist()
    out = [(r["flush"], r["docs"], r["at_low"]) for r in rows if r["docs"] is not None]
    blocks = [r for r in rows if r["docs"] is None]
    if blocks:
        sizes = [len(r["at_low"]) for r in blocks]
        hashes = np.frombuffer(b"".join(r["hashes"] for r in blocks), U)
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        hit = np.zeros(len(s), bool)
        hit[order] = same[1:] | same[:-1]
        lo = 0
        for r, n in zip(blocks, sizes):
            if (h := hit[lo : lo + n]).any():
                step = np.empty((n, 4), np.uint8)
                step[:, 0] = np.frombuffer(r["at_low"], np.uint8)
                step[:, 1:] = np.frombuffer(r["at_high"], np.uint8).reshape(3, n).T
                out.append((r["flush"], None, np.cumsum(step.view("<u4")[:, 0])[h].astype("<u4").tobytes()))
            lo += n
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["flush", "docs", "at"])


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        """One flush: the removal intervals of its texts, in words of the text."""
        rows = table.to_pylist()
        docs = np.frombuffer(next(r["docs"] for r in rows if r["docs"] is not None), _DOC)
        at = np.unique(np.frombuffer(b"".join(r["at"] for r in rows), "<u4")).astype(np.int64)
        ends = np.cumsum(docs["words"])
        out, owner = [], np.searchsorted(ends, at, "right")
        for i, lo, hi in zip(*(x.tolist() for x in _runs(owner))):
            a = at[lo:hi] - (ends[i] - docs["words"][i])
            cut = np.flatnonzero(np.diff(a) > width) + 1
            spans = np.stack([a[np.concatenate([[0], cut])], a[np.concatenate([cut - 1, [len(a) - 1]])] + width], 1)
            out.append((int(docs["k1"][i]), int(docs["k2"][i]), spans.astype("<i8").tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["_k1", "_k2", "spans"])

    return run


def _runs(x: np.ndarray):
    cut = np.flatnonzero(np.diff(x)) + 1
    lo = np.concatenate([[0], cut]) if len(x) else np.empty(0, np.int64)
    hi = np.concatenate([cut, [len(x)]]) if len(x) else np.empty(0, np.int64)
    return x[lo.astype(np.int64)], lo, hi


def removal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """(_k1, _k2, spans): maximal intervals of words under repeated windows, one row for each text that has any."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(text).alias("text"), *row_key(key, text))
    n = buckets(source, 1 << SIDE)
    packed = source.mapInArrow(_windows(width, n), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_repeats, _FOUND)
    spans = found.groupBy("flush").applyInArrow(_merge(width), _SPANS)
    return spans.groupBy("_k1", "_k2").agg(F.first("spans").alias("spans"))


def _kept(emit_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, out = [], [], []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                words = (text or "").encode().split()
                kept, at = words, 0
                if spans:
                    kept = []
                    for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                out.append(joined.decode() if emit_text else hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35, digest: bool = False) -> DataFrame:
    """Each row of docs without the words under windows of `width` words that start anywhere else too, itself included.

    Rows: key, n_words, n_removed, kept (the words left, joined by a space; with digest its SHA-256).
    Null and empty texts: no words.  Equal rows each keep their own row.  Other columns are not read.
    Equality of windows is equality of hashes, polynomials of the words' hashes modulo a prime: 61 bits, and as many
    bits of a second one as number the buckets (SIDE at most).  n windows have about n*n / 2**80 false pairs at
    2**SIDE buckets; texts are not compared again, since a third shuffle of them would not fit the disk."""
    spans = removal_spans(docs, key, text, width)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *row_key(key, text))
    joined = source.join(spans, ["_k1", "_k2"], "left").select("id", "text", "spans")
    kind = source.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_kept(not digest), f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", key)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
