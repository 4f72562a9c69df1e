"""Session settings, shared scratch tables, connected components and vectorised word hashing."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every contract here defines them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches (long texts) and lets local Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and
    driver and executors are one process.  On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillrank-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


#: Lists that written() notes its tables in, innermost last.
_noting: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, has size statistics."""
    path = f"{_scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    for paths in _noting[-1:]:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noted(paths: list[str]):
    """Adds to paths the tables that written() makes meanwhile."""
    _noting.append(paths)
    try:
        yield
    finally:
        _noting.pop()


def dropped(spark: SparkSession, paths: list[str], but: DataFrame) -> None:
    """Removes the tables in paths that `but` does not read, from the disk and from the list."""
    read = but.inputFiles()
    for path in [p for p in paths if not any(p in f for f in read)]:
        _remove(spark, path)
        paths.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Removes the tables that operators of this application wrote; call it when their results have been stored."""
    _remove(spark, _scratch(spark))


def _remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of stored input for each hash bucket.
BUCKET_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that df reads, as Spark knows them before it runs; those of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def buckets(df: DataFrame, most: int = 60000) -> int:
    """How many hash buckets the packed entries of df are dealt to: they grow with its input, so that one bucket fits a
    task at any size, and are four for each shuffle partition at least."""
    least = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(least, -(-input_bytes(df) // BUCKET_BYTES)))


def row_key(*columns: str) -> list[Column]:
    """96 bits that name a row by its content; equal rows share them."""
    return [F.xxhash64(*columns).alias("_k1"), F.hash(*reversed(columns)).alias("_k2")]


#: Links that one task can finish; components contracts any number of them to so few first.
FINISH = 16_000


def _forest(batches):
    """All remaining links in one task: every node with the smallest node it reaches."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["src"].to_pylist(), batch["dst"].to_pylist()):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "up"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(src, dst): rows (node, label), label the smallest node of the component.

    Each round hooks every node to its smallest neighbour and contracts, which at least halves the nodes of a
    component.  Aggregations combine before the shuffle and the joins can be split, so a node with very many
    links does not fill one task.  Once FINISH links or fewer are left, one task ends it."""
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges, labels = written(edges), None
    while left := edges.count():
        if left <= FINISH:
            parent = written(edges.coalesce(1).mapInArrow(_forest, "node long, up long"))
        else:
            both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
            parent = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("up")))
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            step = parent.select(F.col("node").alias("label"), "up")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        if left <= FINISH:
            break
        a = parent.select(F.col("node").alias("src"), F.col("up").alias("a"))
        b = parent.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        moved = edges.join(a, "src").join(b, "dst").where("a <> b")
        edges = written(moved.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    return labels


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
PIECE = 1 << 20
#: Words of more bytes are hashed by BLAKE2b, shorter ones by lanes of eight bytes.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def word_bounds(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word also starts at each position in first (texts' starts)."""
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    start[first] = word[first]
    last = first[first > 0] - 1
    end[last] = word[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a view."""
    return np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _piece_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word.  Lanes pass a non-linear bijection one by one, so no pattern in the letters cancels out."""
    starts, ends = word_bounds(data, first)
    size = ends - starts
    out, lanes = mix(size.astype(U) + U(0x9E3779B97F4A7C15)), _lanes(data)
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        out[live] = mix(out[live] * MIX2 ^ (lanes[starts[live] + at] & _MASK[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out, starts


def _bytes(column, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array (null: none), and where each text starts and the last ends."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, body = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return (LOWER[data] if lower else data), offsets - offsets[0]


def word_hashes(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of an Arrow string array, in order, and the number of words of each text (null: 0).

    Whole texts in UTF-8; no Python object for a word of up to LONG bytes."""
    data, offsets = _bytes(column, lower)
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not SPACE[data[to]]:
            i = np.searchsorted(offsets, to)  # a piece may end where a text does
            gap = np.flatnonzero(SPACE[data[to : to + PIECE]])
            nearest = to + gap[0] if len(gap) else min(len(data), to + PIECE)
            to = min(int(offsets[i]), int(nearest)) if i < len(offsets) else int(nearest)
            if i < len(offsets) and to == offsets[i]:
                break
        inside = offsets[(offsets >= at) & (offsets < to)] - at
        h, s = _piece_hashes(data[at:to], np.unique(inside))
        hashes.append(h)
        starts.append(s + at)
        at = to
    hashes = np.concatenate(hashes) if hashes else np.empty(0, U)
    starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def word_ids(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of an Arrow string array, equal for equal words and no others, and the number of words of each text.

    Words meet by hash, and every word is then compared with the first of its hash, byte by byte."""
    hashes, words = word_hashes(column, lower)
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    data, offsets = _bytes(column, lower)
    starts, ends = word_bounds(data, np.unique(offsets[:-1][offsets[:-1] < len(data)]))
    size, other, lanes = ends - starts, first[ids], _lanes(data)
    same, live = size == size[other], np.flatnonzero(other != np.arange(len(ids)))
    live = live[same[live]]
    long = live[size[live] > LONG]
    live = live[size[live] <= LONG]
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        same[live] &= (lanes[starts[live] + at] ^ lanes[starts[other[live]] + at]) & _MASK[np.minimum(size[live] - at, 8)] == 0
    for i in long.tolist():
        same[i] = data[starts[i] : ends[i]].tobytes() == data[starts[other[i]] : ends[other[i]]].tobytes()
    if not same.all():  # a hash stands for two words
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return ids, words
