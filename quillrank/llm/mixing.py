"""Mixing sources to target weights by pivotal dependent rounding of fractional copy numbers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prepare, row_key, written

#: Rows that one task rounds together.
BLOCK = 4096
_ROUNDED = "row long, k1 long, k2 int, ord long, doc string, source string, size long, copies int, mass double, level int"


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, share `share` of all words by the repeating
    weights; a target stops at cap times the source's size and the rest is shared again until none is above.

    Sources may be many: ranges of names number them, and each round of sharing is one aggregate."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = written(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offset = per.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.pmod(F.col("offset") + F.col("inside") - 1, F.lit(len(weights))) + 1
    per = per.withColumn("inside", inside).join(offset, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")))
    per = written(per.select("source", "source_size", "weight", (cap * F.col("source_size")).alias("most")))
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share[0] / share[1]
    level, full = 0.0, -1  # words for each unit of weight
    while True:  # a source that is full at a level stays so at the higher ones
        over = F.col("most") < level * F.col("weight") if full >= 0 else F.lit(False)
        n, filled, rest = per.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not rest:
            break
        level, full = (total - (filled or 0)) / rest, n
    return per.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _pivot(seed: int):
    def run(key, rows):
        """Rounds one block: two rows with open mass meet, words move between them until one is whole, and the other
        goes on.  The block's words stay as they are; at most one row keeps open mass."""
        rows = rows.sort_values(["k1", "k2", "ord", "doc", "size"], kind="stable", na_position="last").reset_index(drop=True)
        draw = random.Random(f"{seed}/{key}").random
        mass, size, copies = rows["mass"].tolist(), rows["size"].tolist(), rows["copies"].tolist()
        held = None
        for j in range(len(rows)):
            if size[j] <= 0 or mass[j] <= 1e-9 * size[j]:
                mass[j] = 0.0
            elif mass[j] >= size[j] * (1 - 1e-9):
                copies[j], mass[j] = copies[j] + 1, 0.0
            elif held is None:
                held = j
            else:
                i = held
                gain, loss = min(size[i] - mass[i], mass[j]), min(size[j] - mass[j], mass[i])
                move = gain if draw() * (gain + loss) < loss else -loss
                mass[i], mass[j], held = mass[i] + move, mass[j] - move, None
                for k in (i, j):
                    if mass[k] <= 1e-9 * size[k]:
                        mass[k] = 0.0
                    elif mass[k] >= size[k] * (1 - 1e-9):
                        copies[k], mass[k] = copies[k] + 1, 0.0
                    else:
                        held = k
        return rows.assign(mass=mass, copies=copies, level=rows["level"] + 1).drop(columns=["block", "blocks"])

    return run


def copy_counts(sizes: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """sizes with copies: whole copy numbers whose words come to each source's target but for half a row.

    Blocks are rounded each by itself; their single open rows meet again in the next level of a tree, a
    thousandth as many, until each source has one open row, which goes to the nearer side.  Blocks follow from row content
    and the number of a row among equal ones, and the draws from the block, so reruns agree and equal rows spread over blocks."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = sizes["source"].eqNullSafe(targets["source"])
    counts = sizes.groupBy("source").count().withColumnRenamed("source", "_s")
    targets = targets.join(counts, targets["source"].eqNullSafe(counts["_s"])).drop("_s")
    names = ["row", "k1", "k2", "ord", "doc"]
    rows = sizes.join(targets, same).select(*names, sizes["source"], "size", F.floor(share).cast("int").alias("copies"), ((share - F.floor(share)) * F.col("size")).alias("mass"), F.lit(0).alias("level"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    done = None
    while True:
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("k1", "ord", "size", "level"), "blocks"))
        top = blocked.agg(F.max("blocks")).first()[0] or 0
        out = written(blocked.groupBy("source", "level", "block").applyInPandas(_pivot(seed), _ROUNDED))
        closed = out.where("mass = 0")
        done = closed if done is None else done.union(closed)
        still = out.where("mass > 0")
        if top <= 1:
            break
        counts = still.groupBy("source").count().withColumnRenamed("source", "_s")
        rows = still.join(counts, still["source"].eqNullSafe(counts["_s"])).select(*names, "source", "size", "copies", "mass", "level", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    last = still.withColumn("copies", F.col("copies") + (2 * F.col("mass") >= F.col("size")).cast("int"))
    return done.union(last).select("row", "doc", "source", "size", "copies")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(row, k1, k2, ...), a written table, with ord: the number of each row among those of its key.

    Parts of a key by the partition that read them are numbered by themselves, so a key of very many rows fills no task."""
    parted = rows.withColumn("part", F.shiftright("row", 33))
    inside = parted.withColumn("inside", F.row_number().over(Window.partitionBy("k1", "k2", "part").orderBy("row")))
    before = Window.partitionBy("k1", "k2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offset = parted.groupBy("k1", "k2", "part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return inside.join(offset, ["k1", "k2", "part"]).withColumn("ord", F.col("offset") + F.col("inside") - 1).drop("part", "inside", "offset")


def _sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """docs' rows as (row, k1, k2, ord, doc, source, size), written."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id().alias("row")
    k1, k2 = row_key(key, text, source)
    rows = written(docs.select(row, k1.alias("k1"), k2.alias("k2"), F.col(key).cast("string").alias("doc"), F.col(source).cast("string").alias("source"), size.alias("size")))
    return written(_numbered(rows))


def _renamed(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... and the new names of the given ones."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(c)}" for c in columns]


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of docs: key, size, source_size, target (its source's), taken (words the mix takes of it).

    Null texts have size 0 and give nothing.  Equal rows are rounded each by itself; which of them is taken is one choice
    among equals.  Other columns are not read; an empty table gives no rows."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType
    renamed, (k, t, s) = _renamed(docs.select(key, text, source), key, text, source)
    sizes = _sizes(renamed, k, t, s)
    targets = written(source_targets(sizes))
    out = copy_counts(sizes, targets)
    return out.join(targets, out["source"].eqNullSafe(targets["source"])).select(F.col("doc").cast(kind).alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix takes them: each row none, one or two times, in docs' columns, whatever their names.

    Every row is rounded by itself, equal ones too; of rows with one key, text and source the order in which they are read
    decides.  Null texts are never taken, and an empty table stays empty."""
    prepare(docs.sparkSession)
    renamed, (k, t, s) = _renamed(docs, key, text, source)
    whole = written(renamed.withColumn("row", F.monotonically_increasing_id()))
    sizes = _sizes(whole, k, t, s)
    copies = copy_counts(sizes, written(source_targets(sizes))).where("copies > 0").select("row", "copies")
    taken = whole.hint("merge").join(copies, "row").select(*renamed.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.drop("copy").toDF(*docs.columns)


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
