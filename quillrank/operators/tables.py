"""Relational operators over question-keyed tables: first rows of a key, membership, comparisons, set statistics, curves.

Each takes DataFrames and column names and returns a DataFrame.  Where a first row is wanted, a minimum of a struct is
taken in place of a window, since it combines before the shuffle; rows that only differ in their id meet as one row with a
count before a question is joined with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], *order: str | Column, name: str = "rn") -> DataFrame:
    """df with the place of each row within its keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, keys: list[str], *order: str | Column, n: int = 1, name: str = "rn") -> DataFrame:
    """The first n rows of each key, with their place."""
    return numbered(df, keys, *order, name=name).where(F.col(name) <= n)


def first_with_count(df: DataFrame, keys: list[str], order: list[str], count: str = "dup") -> DataFrame:
    """keys, the order columns of the first row, and how many rows share the keys (exact-key dedupe)."""
    found = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias(count))
    return found.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order], count)


def last_value(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Score lookup in which a later row replaces an earlier one."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def known(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key the other table has; a null key is never known."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def unknown(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key the other table has not; rows with a null key stay, and nulls in the other table exclude nothing."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def content_hash(df: DataFrame, columns: list[str], name: str = "row_sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256))


def alias_rows(gold: DataFrame, key: str = "question_id", group: str = "group_id") -> DataFrame:
    """One training row an alias, its id telling place and number of the question's aliases (PRJ14)."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    n = F.count("*").over(Window.partitionBy(key))
    return gold.withColumn("id", F.concat(F.col(key).cast("string"), F.lit("__alias_"), pad(F.col(group)), F.lit("_of_"), pad(n)))


def whitelisted(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, in their order; one that df lacks is an error."""
    return df.select(*allowed)


def reason_counts(df: DataFrame, reason: Column, name: str = "n", kept: str = "kept") -> DataFrame:
    """How many rows each reason excludes, and how many none does."""
    return df.groupBy(F.coalesce(reason, F.lit(kept)).alias("reason")).agg(F.count("*").alias(name))


def alias_coverage(gold: DataFrame, items: DataFrame, least: float = 0.0, key: str = "question_id") -> DataFrame:
    """Share of a question's gold aliases that items(key, item_key) hold, where at least `least`."""
    held = items.select(key, F.col("item_key").alias("alias_key"), F.lit(1.0).alias("_held")).distinct()
    share = gold.join(held, [key, "alias_key"], "left").groupBy(key).agg(F.avg(F.coalesce("_held", F.lit(0.0))).alias("coverage"))
    return share.where(F.col("coverage") >= least)


def membership(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Each key with each member, and whether rows have the two together; members are few."""
    have = rows.where(F.col(member).isNotNull()).groupBy(key).agg(F.collect_set(member).alias("_have"))
    every = rows.agg(F.collect_set(member).alias("_all"))  # one row
    grid = rows.select(key).distinct().join(have, key, "left").join(F.broadcast(every))
    return grid.select(key, F.explode("_all").alias(member), F.col("_have")).select(key, member, F.coalesce(F.array_contains("_have", F.col(member)), F.lit(False)).alias("present"))


def with_counts(every: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """All keys with the number of their rows, 0 where there are none: failures stay in the denominator."""
    return every.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def standard_scores(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with each named column as its distance from the mean in population standard deviations; a constant column is 0."""
    stats = df.agg(*[f(c).alias(f"_{name}_{n}") for name, c in columns.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    scored = df.join(F.broadcast(stats))
    z = {name: F.when(F.col(f"_{name}_s") == 0, F.lit(0.0)).otherwise((c - F.col(f"_{name}_m")) / F.col(f"_{name}_s")) for name, c in columns.items()}
    return scored.withColumns(z).drop(*stats.columns)


def scores_within(df: DataFrame, key: str, value: str, name: str = "z") -> DataFrame:
    """Standard scores within the classes of key; the classes' means come as one row each, so a large class fills no task."""
    stats = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).withColumnRenamed(key, "_key")
    joined = df.join(stats, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.when(F.col("_s") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_key")


def margins(pairs: DataFrame, scores: DataFrame, key: str, value: str, name: str = "margin") -> DataFrame:
    """pairs with the difference of the scores of chosen_id and rejected_id; a pair without both goes."""
    for side in ("chosen", "rejected"):
        pairs = pairs.join(scores.select(F.col(key).alias(f"{side}_id"), F.col(value).alias(f"_{side}")), f"{side}_id")
    return pairs.withColumn(name, F.col("_chosen") - F.col("_rejected"))


def dominated(rows: DataFrame, key: str, larger: list[str], name: str = "dominated") -> DataFrame:
    """For each key the number of ordered pairs where the first row is no worse in any column and better in one.

    Rows of equal values meet as one row with their number; a key without such a pair has no row."""
    alike = rows.groupBy(key, *larger).agg(F.count("*").alias("_n"))
    other = alike.select(key, *[F.col(c).alias(f"_{c}") for c in larger], F.col("_n").alias("_m"))
    no_worse, better = F.lit(True), F.lit(False)
    for c in larger:
        no_worse, better = no_worse & (F.col(c) >= F.col(f"_{c}")), better | (F.col(c) > F.col(f"_{c}"))
    return alike.join(other, key).where(no_worse & better).groupBy(key).agg(F.sum(F.col("_n") * F.col("_m")).alias(name))


def better_pairs(rows: DataFrame, key: str, unit: str, larger: str, no_more: str) -> DataFrame:
    """(key, x, y): all pairs where x has more of one column and no more of the other; the comparison meets values, not rows."""
    alike = rows.groupBy(key, larger, no_more).agg(F.collect_list(unit).alias("_ids"))
    other = alike.select(key, F.col(larger).alias("_l"), F.col(no_more).alias("_s"), F.col("_ids").alias("_others"))
    met = alike.join(other, key).where((F.col(larger) > F.col("_l")) & (F.col(no_more) <= F.col("_s")))
    return met.select(key, F.explode("_ids").alias("x"), "_others").select(key, "x", F.explode("_others").alias("y"))


def hard_negatives(positives: DataFrame, wrong: DataFrame, key: str, item: str, k: int = 3) -> DataFrame:
    """Each positive with the key's k most frequent wrong items, ties by item."""
    counted = wrong.groupBy(key, item).agg(F.count("*").alias("_n"))
    best = first_of(counted, [key], F.desc("_n"), item, n=k).select(key, F.col(item).alias("negative"), "rn")
    return positives.join(best, key)


def nearest_longer(rows: DataFrame, key: str, unit: str, length: str, near: list[str]) -> DataFrame:
    """For each key the pair of a shorter and a longer row that are nearest in `near`, in order, then in length, then by id.

    Rows of equal values are one, with their smallest id: no other of them can come first."""
    alike = rows.groupBy(key, length, *near).agg(F.min(unit).alias("_id"))
    other = alike.select(key, *[F.col(c).alias(f"_{c}") for c in (length, *near)], F.col("_id").alias("_other"))
    met = alike.join(other, key).where(F.col(length) < F.col(f"_{length}"))
    gap = [F.abs(F.col(c) - F.col(f"_{c}")).alias(f"g{i}") for i, c in enumerate(near)]
    order = F.struct(*gap, (F.col(f"_{length}") - F.col(length)).alias("more"), F.col("_id").alias("shorter"), F.col("_other").alias("longer"))
    return met.groupBy(key).agg(F.min(order).alias("_o")).select(key, "_o.shorter", "_o.longer")


def outer_differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two banks, or that only one has."""
    a, b = left.select(key, F.col(value).alias("left_n")), right.select(key, F.col(value).alias("right_n"))
    return a.join(b, key, "full").where(~F.col("left_n").eqNullSafe(F.col("right_n")))


def arm_values(rows: DataFrame, key: str, arm: str, value: Column, arms: dict[str, str]) -> DataFrame:
    """One row a key with a column for each arm: the largest value there, null without rows."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(arm) == a, value)).alias(name) for name, a in arms.items()])


def transitions(left: Column, right: Column) -> Column:
    """What happened between two arms, each right or not."""
    return F.when(left & right, "both").when(left, "lost").when(right, "gained").otherwise("neither")


def upsert(pool: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """All keys with what a merge of source into pool does to them."""
    a, b = pool.select(*on).distinct().withColumn("_old", F.lit(True)), source.select(*on).distinct().withColumn("_new", F.lit(True))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return a.join(b, on, "full").select(*on, action.alias("action"))


def numeric_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(key).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


def omissions(gold: DataFrame, best: DataFrame, items: DataFrame, key: str = "question_id") -> DataFrame:
    """Gold aliases that a question's best response lacks, and how many of them any response has (AGG10).

    best(key, item_key) are the items of the best responses, items(key, item_key) those of all."""
    aliases = known(gold, best, key).select(key, F.col("alias_key").alias("item_key"))
    lost = unknown(aliases, best, [key, "item_key"])
    said = items.select(key, "item_key", F.lit(1).alias("_said")).distinct()
    return lost.join(said, [key, "item_key"], "left").groupBy(key).agg(F.count("*").alias("missing"), F.count("_said").alias("recoverable"))


def bank_diversity(sets: DataFrame, key: str, unit: str, item: str) -> DataFrame:
    """For each key over all its units, as sets of items: units, distinct sets, pairs, mean Jaccard, and set edits (AGG11, SET05, SET06).

    The edits of all pairs follow from the units' sizes and the items' counts; units meet on items that they share, so
    pairs without a common item cost nothing."""
    sets = sets.select(key, unit, item).distinct()
    sized = sets.groupBy(key, unit).agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col(item).cast("string"))), "\x1f"), 256).alias("_set"))
    per = sized.groupBy(key).agg(F.count("*").alias("units"), F.countDistinct("_set").alias("distinct_sets"), F.sum("_n").alias("_total"))
    shared = sets.groupBy(key, item).agg(F.count("*").alias("_c")).groupBy(key).agg(F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_common"))
    a = sets.join(sized.drop("_set"), [key, unit])
    b = a.select(key, item, F.col(unit).alias("_unit"), F.col("_n").alias("_m"))
    both = a.join(b, [key, item]).where(F.col(unit) < F.col("_unit")).groupBy(key, unit, "_unit", "_n", "_m").agg(F.count("*").alias("_k"))
    alike = both.groupBy(key).agg(F.sum(F.col("_k") / (F.col("_n") + F.col("_m") - F.col("_k"))).alias("_alike"))
    pairs = F.floor(F.col("units") * (F.col("units") - 1) / 2)
    out = per.join(shared, key).join(alike, key, "left").withColumn("pairs", pairs)
    return out.select(
        key, "units", "distinct_sets", "pairs", F.when(F.col("pairs") > 0, F.round(F.coalesce("_alike", F.lit(0.0)) / F.col("pairs"), 9)).alias("jaccard"),
        ((F.col("units") - 1) * F.col("_total") - F.col("_common")).alias("set_edits"))


def bins(c: Column, edges: list[tuple[float, str]], over: str) -> Column:
    """The name of the first edge that c does not pass."""
    out = F.when(c <= edges[0][0], edges[0][1])
    for edge, name in edges[1:]:
        out = out.when(c <= edge, name)
    return out.otherwise(over)


def micro_macro(rows: DataFrame, cell: str, unit: str, right: Column) -> DataFrame:
    """Share of right rows in a cell over all rows, and as the mean over units."""
    per = rows.groupBy(cell, unit).agg(F.count("*").alias("_n"), F.count_if(right).alias("_k"))
    return per.groupBy(cell).agg(F.round(F.sum("_k") / F.sum("_n"), 6).alias("micro"), F.round(F.avg(F.col("_k") / F.col("_n")), 6).alias("macro"))


def recall_curve(ranks: DataFrame, most: int, rank: str = "first_rank") -> DataFrame:
    """covered and questions at each depth to `most`; rows at a depth are counted once and then added up."""
    at = ranks.groupBy(rank).agg(F.count("*").alias("_n"))  # one row a depth
    depth = at.agg(F.sequence(F.lit(1), F.lit(most)).alias("_k"), F.sum("_n").alias("questions"), F.map_from_entries(F.collect_list(F.when(F.col(rank).isNotNull(), F.struct(F.col(rank).cast("int"), "_n")))).alias("_at"))
    found = depth.select(F.explode("_k").alias("k"), "questions", "_at")
    upto = F.aggregate(F.map_entries("_at"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] <= F.col("k"), e["value"]).otherwise(F.lit(0).cast("long")))
    return found.select("k", upto.alias("covered"), "questions")


def prefix_coverage(hits: DataFrame, draws: DataFrame, key: str, draw: str) -> DataFrame:
    """covered keys by the first k draws: each key counts from its first hit on."""
    first = hits.groupBy(key).agg(F.min(draw).alias(draw)).groupBy(draw).agg(F.count("*").alias("_n"))
    every = draws.select(draw).where(F.col(draw).isNotNull()).distinct().join(first, draw, "left")  # one row a draw
    upto = Window.orderBy(draw).rowsBetween(Window.unboundedPreceding, 0)
    return every.select(F.col(draw).alias("k"), F.coalesce(F.sum("_n").over(upto), F.lit(0).cast("long")).alias("covered"))


def frequent_or_all(counted: DataFrame, key: str, count: str, least: int) -> DataFrame:
    """Rows counted `least` times or more, or all of a key that has none such."""
    most = counted.groupBy(key).agg(F.max(count).alias("_most"))
    return counted.join(most, key).where((F.col(count) >= least) | (F.col("_most") < least)).drop("_most")


def shared_between(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that stand in more than one part of a split, with the parts' names: a leak if there are any (SET03, FLT19)."""
    rows = None
    for name, part in parts.items():
        mine = part.select(key, F.lit(name).alias("part")).distinct()
        rows = mine if rows is None else rows.union(mine)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)


def half_overlapping(df: DataFrame, key: str, place: str, width: int = 2) -> DataFrame:
    """df once for each window that a row stands in: windows of `width` places start half a width apart, the first at 0."""
    half = max(1, width // 2)
    n = F.floor(F.col(place) / half)
    return df.withColumn("window_id", F.explode(F.filter(F.array(n, n - 1), lambda w: w >= 0)))


def next_in_ring(df: DataFrame, unit: str, cell: str, hashed: Column) -> DataFrame:
    """distractor of each row: the next one of its cell in hash order, the first for the last.

    Places come by hash prefix, so that a large cell is no single task."""
    from .ranking import hash_rank

    ranked = hash_rank(df, hashed, unit, within=(cell,), name="_rn")
    n = df.groupBy(F.col(cell).alias("_cell")).agg(F.count("*").alias("_size"))
    ranked = ranked.join(n, F.col(cell).eqNullSafe(F.col("_cell"))).drop("_cell")
    following = ranked.select(F.col(cell).alias("_c"), F.col("_rn").alias("_place"), F.col(unit).alias("distractor"))
    return ranked.join(following, F.col(cell).eqNullSafe(F.col("_c")) & (F.col("_place") == F.pmod(F.col("_rn"), F.col("_size")) + 1)).select(*df.columns, "distractor")


def panel(df: DataFrame, unit: str, stratum: str, n: int, hashed: Column, excluded: list[DataFrame], discovery: float = 0.5) -> DataFrame:
    """n rows of each stratum in hash order, none of them excluded, the first share of them for discovery and the rest for audit (SPL13)."""
    from .ranking import hash_rank

    for other in excluded:
        df = unknown(df, other, unit)
    rows = hash_rank(df, hashed, unit, within=(stratum,), name="place").where(F.col("place") <= n)
    return rows.withColumn("part", F.when(F.col("place") <= int(n * discovery), "discovery").otherwise("audit"))
