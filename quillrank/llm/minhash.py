"""MinHash near-dedup with sequential Bayesian verification.

1. One pass makes each text's set of word shingles, its digest (the class of equal sets) and a MinHash
   signature; bands of it become packed (band hash, class) entries.  A flush sends each class once and, for a
   band hash that several of its classes share, one star of links and one entry, so that hot bands stay small.
2. Buckets link classes that share a band to the bucket's smallest class; connected components of these links
   are the candidate clusters.
3. Clusters are verified in blocks of bounded size.  Inside one, signatures are compared batch by batch; a pair
   goes when the posterior probability that its similarity reaches the threshold falls below `miss`; what stays
   is confirmed on the full sets of shingles of the texts' words, not of their hashes.  Pairs that are connected already need no test, so a group of copies costs
   about one test a member.
4. Clusters of more than one block share some members (hubs) between blocks; members that did not join their
   cluster's largest component meet every block again.  A pair is then either tested, or of one component."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, buckets, components, mix, prepare, word_hashes, word_ids, written

ROWS, BANDS = 7, 64
BATCH = 32
FLUSH_WORDS = 1_000_000
BLOCK, BLOCK_WORDS = 2048, 2_000_000
HUBS = 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)[:, None]
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS + 1), dtype=U) * U(2) + U(1)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of width words; of fewer words, of all of them as one."""
    if not len(words):
        return words
    n = min(width, len(words))
    run = np.full(len(words) - n + 1, n, U)
    for k in range(n):
        run = mix(run * U(0x9E3779B97F4A7C55) + words[k : len(words) - n + 1 + k])
    return np.unique(run)


def exact_sets(ids: np.ndarray, words: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text, given the ids of its words, sorted distinct codes of its shingles; equal codes are equal runs of words.

    A run's code is the rank of the run one shorter, joined with the next word's id; a text of fewer words than
    width has one code below zero, the same for the same words."""
    ends = np.cumsum(words)
    n, room = len(ids), int(ids.max(initial=0)) + 1
    code = ids.astype(np.int64)
    for k in range(1, width):
        step = code[: max(0, n - k)] * room + ids[k:]
        code = np.unique(step, return_inverse=True)[1] if k < width - 1 else step
    out, short = [], {}
    for end, w in zip(ends.tolist(), words.tolist()):
        if w >= width:
            out.append(np.unique(code[end - w : end - width + 1]))
        elif w:
            out.append(np.array([-1 - short.setdefault(ids[end - w : end].tobytes(), len(short))], np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def signature(shingle: np.ndarray, size: int) -> np.ndarray:
    """The first `size` MinHash values of a non-empty set."""
    x = np.unique((shingle >> U(32)).astype(np.uint32))[None, :]
    out = np.full(size, 2**32 - 1, np.uint32)
    for lo in range(0, x.shape[1], 512):
        h = _A[:size] * x[:, lo : lo + 512]
        h += _B[:size]
        np.minimum(out, h.min(1), out=out)
    return out


def _digest(shingle: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingle.tobytes(), digest_size=8).digest(), "little", signed=True)


_ENTRY = "row long, id {}, n long, class long, bucket int, hashes binary, classes binary, src long, dst long"
_FIELDS = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())


def _bands(width: int, n_buckets: int, id_type: pa.DataType):
    names = ["row", "id", "n", "class", "bucket", "hashes", "classes", "src", "dst"]

    def rows(columns, n):
        return pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(n, t) for c, t in zip(columns, (pa.int64(), id_type, *_FIELDS))], names)

    def flush(seen):
        classes = np.array(list(seen), np.int64)
        sigs = np.stack(list(seen.values())).reshape(-1, BANDS, ROWS).astype(U)
        hashes = mix((sigs * _BAND[:, :ROWS]).sum(2, dtype=U) + _BAND[:, ROWS]).ravel()
        owner = np.repeat(classes, BANDS)
        order = np.lexsort((owner, hashes))
        h, c = hashes[order], owner[order]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        hub = c[np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))]
        if again.any():
            links = np.unique(np.stack([c[again], hub[again]], 1), axis=0)
            yield rows([None] * 7 + [pa.array(links[:, 0]), pa.array(links[:, 1])], len(links))
        h, c = h[~again], c[~again]
        bucket = ((h >> U(32)) * U(n_buckets)) >> U(32)  # rises with h, so the buckets are runs
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1).astype(U))
        full = np.flatnonzero(np.diff(cuts))
        yield rows([None] * 4 + [pa.array(full, pa.int32()), pa.array([h[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), pa.array([c[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), None, None], len(full))

    def run(batches):
        seen, n = {}, 0
        for batch in batches:
            hashes, words = word_hashes(batch["text"], lower=True)
            sizes, classes, at = [], [], 0
            for w in words.tolist():
                s = shingles(hashes[at : at + w], width)
                at += w
                sizes.append(len(s))
                classes.append(_digest(s) if w else None)
                if w and classes[-1] not in seen:
                    seen[classes[-1]] = signature(s, ROWS * BANDS)
                    n += w
            yield rows([batch["row"], batch["id"], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *[None] * 5], len(sizes))
            if n >= FLUSH_WORDS or len(seen) >= 4096:
                yield from flush(seen)
                seen, n = {}, 0
        if seen:
            yield from flush(seen)

    return run


def _stars(table: pa.Table) -> pa.Table:
    """One bucket: links from the classes under each band hash to the smallest of them."""
    h = np.frombuffer(b"".join(table["hashes"].to_pylist()), U)
    c = np.frombuffer(b"".join(table["classes"].to_pylist()), np.int64)
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    hub = c[np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))]
    links = np.unique(np.stack([c[again], hub[again]], 1), axis=0)
    links = links[links[:, 0] != links[:, 1]]
    return pa.table({"src": links[:, 0], "dst": links[:, 1]})


def least_matches(threshold: float, miss: float, size: int, batch: int = BATCH) -> list[int]:
    """For each number of compared values, the fewest matches at which the posterior probability of a similarity
    of the threshold or more, from a flat prior, is at least miss.

    With m of n matches that is a Beta(m + 1, n - m + 1) tail, which equals a binomial sum."""
    out = []
    for n in range(batch, size + 1, batch):
        m, tail = 0, 0.0
        while m <= n:  # P(S >= t | m of n) = P(Bin(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _verify(width: int, percent: int, miss: float, size: int = 256):
    least = least_matches(percent / 100, miss, size)

    def run(table: pa.Table) -> pa.Table:
        """One block: links of a spanning forest of its similarity graph, and for each class its smallest linked class here."""
        column, classes = table["text"].combine_chunks(), table["class"].to_numpy()
        order = np.argsort(classes, kind="stable")
        hashes, words = word_hashes(column, lower=True)
        ends = np.cumsum(words)
        hashed = [shingles(hashes[end - w : end], width) for end, w in zip(ends.tolist(), words.tolist())]
        ids, _ = word_ids(column, lower=True)
        exact = exact_sets(ids, words, width)
        classes, sets, hashed = classes[order].tolist(), [exact[i] for i in order], [hashed[i] for i in order]
        sizes = np.array([len(s) for s in sets], np.int64)
        sigs = np.stack([signature(s, size) for s in hashed]) if sets else np.empty((0, size), np.uint32)
        root = np.arange(len(classes))
        for i in range(len(classes)):
            near = np.flatnonzero((root[i + 1 :] != root[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i]))) + i + 1
            matches = np.zeros(len(near), np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sigs[near, part] == sigs[i, part]).sum(1)
                near, matches = near[matches >= need], matches[matches >= need]
            for j in near.tolist():
                if root[j] != root[i]:
                    at = np.searchsorted(sets[j], sets[i])
                    both = int((sets[j][np.minimum(at, len(sets[j]) - 1)] == sets[i]).sum())
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((root[i], root[j]))
                        root[root == b] = a
        ids = np.array(classes, np.int64)
        first = table.slice(0, 1)
        return pa.table({"cluster": pa.array(first["cluster"].to_pylist() * len(ids), pa.int64()), "blocks": pa.array(first["blocks"].to_pylist() * len(ids), pa.int64()), "class": ids, "root": ids[root] if len(ids) else ids})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, miss: float = 1e-9) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the smallest key of the component), kept.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles, A-Z
    lower-cased.  A band agreement of 64 x 7 values misses a pair at 0.8 with probability 3e-7, at 0.9 with 1e-18.
    Sets of equal 64-bit digests count as equal (n different ones: about n*n / 2**65 false pairs); all other links are
    confirmed on words.  Texts without words (or null) link to nothing.  Rows of one key are kept or not together.
    Null keys stand for a component only where it has no other.  Empty tables give no rows; other columns are not read."""
    prepare(docs.sparkSession)
    source = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text")))
    found = _grouped(source, width, percent, miss)
    least = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least"))
    out = found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), least.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _grouped(source: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """source(row, id, text), a written table, as (row, id, n, label, least): the component's label, null without words, and its smallest id."""
    kind = source.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    n = buckets(source)
    made = written(source.mapInArrow(_bands(width, n, to_arrow_type(kind)), _ENTRY.format(kind.simpleString())))
    sets = made.where("n is not null").select("row", "id", "n", "class")
    stars = made.where("bucket is not null").groupBy("bucket").applyInArrow(_stars, "src long, dst long")
    links = made.where("src is not null").select("src", "dst").union(stars)
    clusters = components(links).withColumnsRenamed({"node": "class", "label": "cluster"})
    labels = _labels(source.select("row", "text"), sets, clusters, width, percent, miss)
    sets = sets.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = written(sets.where("label is not null").groupBy("label").agg(F.min("id").alias("least")))  # written: Spark can then split a large label in the join
    return sets.join(least, "label", "left").select("row", "id", "n", "label", "least")


def _labels(source: DataFrame, sets: DataFrame, clusters: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """(class, label) of the classes of candidate clusters; each class is read by the text of one of its rows."""
    found = "cluster long, blocks long, class long, root long"
    members = written(sets.join(clusters, "class").groupBy("class", "cluster").agg(F.min("row").alias("row"), F.first("n").alias("n")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("words"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).alias("blocks"), "members")
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), "blocks"))
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class", F.lit(2)), F.greatest(F.lit(1), F.floor(F.col("members") / HUBS))) == 0)
    blocks = F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = placed.select("row", "class", "cluster", "blocks", blocks.alias("at"))
    texts = placed.join(source.hint("merge"), "row").select("class", "cluster", "blocks", F.explode("at").alias("block"), "text")
    roots = written(texts.groupBy("cluster", "block").applyInArrow(_verify(width, percent, miss), found))
    labels = roots.where("blocks = 1").select("class", F.col("root").alias("label"))
    large = roots.where("blocks > 1")
    if large.isEmpty():
        return labels
    first = components(large.select(F.col("class").alias("src"), F.col("root").alias("dst")))
    large = large.select("class", "cluster", "blocks").distinct().join(first, F.col("class") == F.col("node"), "left").select("class", "cluster", "blocks", F.coalesce("label", "class").alias("label"))
    large = written(large)
    counted = large.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    most = counted.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
    left = written(large.join(most, "cluster").where("label <> most").select("class", "cluster", "blocks"))
    if not left.isEmpty():
        ids = members.select("class", "row")
        groups = left.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("groups"))
        probes = left.join(groups, "cluster").select("class", "cluster", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("class", F.lit(3)), "groups").alias("group"))
        # every block meets every group of at most about BLOCK probes
        bodies = large.select("class", "cluster", "blocks").join(groups, "cluster").select("class", "cluster", "blocks", F.pmod(F.xxhash64("class", F.lit(1)), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
        meet = probes.union(bodies.select(probes.columns)).distinct().join(ids, "class")
        texts = meet.join(source.hint("merge"), "row").select("class", "cluster", "blocks", "block", "group", "text")
        more = texts.groupBy("cluster", "block", "group").applyInArrow(_verify(width, percent, miss), found)
        edges = large.select(F.col("class").alias("src"), F.col("label").alias("dst")).union(more.select("class", "root"))
        again = components(edges)
        large = large.join(again, F.col("class") == F.col("node"), "left").select("class", F.coalesce(again["label"], large["class"]).alias("label"))
    return labels.union(large.select("class", "label"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-9) -> DataFrame:
    """docs with one row of each component, that of the smallest key (ties: the first row read; null keys last), and all
    rows without words.  Columns may have any name and stay as they are; an empty table stays empty."""
    prepare(docs.sparkSession)
    whole = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("row", F.monotonically_increasing_id())
    whole = written(whole)
    k, t = f"c{docs.columns.index(key)}", f"c{docs.columns.index(text)}"
    order = F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key"), F.col("row").alias("row"))
    found = _grouped(whole.select("row", order.alias("id"), F.col(t).alias("text")), width, percent, miss)
    kept = found.where("label is null or row = least.row").select("row")
    return whole.hint("merge").join(kept, "row", "left_semi").drop("row").toDF(*docs.columns)


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
