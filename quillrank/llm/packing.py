"""Concatenate and cut: two-pass prefix sums over partition token totals, then fixed windows."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .vocabulary import added_tokens, encoder

VOCABULARY = "byte_bpe_50k"
#: Entries of a worker's cache of encoded words.
CACHE = 600_000
_encoders: dict = {}


def _encoder(name: str):
    """text -> ids as little-endian 16-bit bytes; equal to the tokenizer file's ids, its added tokens included."""
    if name not in _encoders:
        whole, added = encoder(name), added_tokens(name)
        stops = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

        class Words(dict):
            """' ' + word -> ids.  No match of the pattern goes over a single space between two non-space characters
            but from the space on, so such stretches encode by themselves."""

            def __missing__(self, word):
                if len(self) >= CACHE:
                    self.clear()
                plain = word and not word[0].isspace() and not word[-1].isspace()
                self[word] = got = packed(" " + word) if plain else None
                return got

        def as_bytes(ids) -> bytes:
            ids = array("H", ids)  # fails on an id of more than 16 bits
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()

        def packed(text: str) -> bytes:
            return as_bytes(whole(text))

        words = Words()

        def ordinary(text: str) -> bytes:
            first, *rest = text.split(" ")
            if first and not first[-1].isspace():
                try:
                    return b"".join(chain([packed(first)], map(words.__getitem__, rest)))
                except TypeError:  # other white space beside a space
                    pass
            return packed(text)

        def encode(text: str) -> bytes:
            if not any(t in text for t in added):
                return ordinary(text)
            return b"".join(as_bytes([added[part]]) if part in added else ordinary(part) for part in stops.split(text) if part)

        _encoders[name] = encode
    return _encoders[name]


def _tokens(name: str, end: int):
    def run(batches):
        encode, part, at = _encoder(name), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u2").tobytes()
        for batch in batches:
            ids = [encode(t or "") + tail for t in batch["text"].to_pylist()]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.full(len(n), part), pa.int64()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["id", "part", "at", "n", "ids"])

    return run


def _cut(offsets: np.ndarray, length: int):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for i, (part, at, n, ids) in enumerate(zip(*(batch[c].to_pylist() for c in ("part", "at", "n", "ids")))):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                lo, first = 0, int(offsets[part]) + at
                while lo < n:
                    sequence, offset = divmod(first + lo, length)
                    hi = min(n, lo + length - offset)
                    for column, value in zip(out, (i, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, sequence, offset)):
                        column.append(value)
                    lo = hi
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, end: int = 0) -> DataFrame:
    """(id, part, at, n, ids): whole texts as ids with the end id, and their place in their partition; written once."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return written(source.mapInArrow(_tokens(name, end), f"id {kind}, part long, at long, n long, ids binary"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 1024, name: str = VOCABULARY, end: int = 0) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents stand end to end in the order of their partitions; every sequence but the last is full, and a
    document over a boundary has a piece on either side.  Added tokens of the tokenizer file (<|endoftext|>) in a text
    are one id, as there.  Null texts are empty and have the end id alone; an empty table has no pieces.  Repeated rows
    are documents of their own.  Other columns are not read."""
    tokens = tokenized(docs, key, text, name, end)
    totals = {r["part"]: r["total"] for r in tokens.groupBy("part").agg(F.sum("n").alias("total")).collect()}  # a number a partition
    offsets = np.concatenate([[0], np.cumsum([totals.get(p, 0) for p in range(max(totals, default=0) + 1)])]).astype(np.int64)
    kind = tokens.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return tokens.mapInArrow(_cut(offsets, length), f"id {kind}, {columns}").withColumnRenamed("id", key)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
