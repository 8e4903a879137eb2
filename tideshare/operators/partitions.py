"""Table operators on set partitions: enumeration, coarsening, dominance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.numbers import col
from tideshare.functions.partitions import (
    block_count,
    compose,
    cross_pairs,
    extension_counts,
    is_coarsening,
    label_pairs,
    merge_labels,
    rgs_key,
    star_pairs,
    to_rgs,
    together_pairs,
    unrank,
)
from tideshare.operators.counts import first_appearance_id
from tideshare.plans.series import materialise, spread

#: Partitions that one range of numbers holds at least.
RANGE = 4096


def enumerate_partitions(df: DataFrame, n: Column | str, max_n: int | None = None, at_most: Column | str | None = None,
                         exactly: Column | str | None = None, position: str | None = None, reverse: bool = False,
                         dealt: bool = True) -> DataFrame:
    """All label strings of length ``n`` per row (``n`` and the limits may differ from row to row).

    Numbers are made, not strings: a row counts its partitions, its numbers are cut into ranges of equal
    length, the ranges are dealt to all tasks (if ``dealt``) and each number is turned into its label
    string on its own. So every task gets the same share, nothing is collected, and the number
    gives the place: ``position`` names a column that counts from 1 in lexicographic order, or
    from the last string on with ``reverse``; no sort is needed for it.

    A row with a null ``n`` or one below 1 has no partitions; one with ``n > max_n``, or with more partitions
    than 64 bits can number (26 elements without a limit), fails the job instead of losing some.
    """
    n = col(n).cast("int")
    if max_n is not None:
        n = F.when(n > max_n, F.raise_error(F.lit(f"more than {max_n} elements")).cast("int")).otherwise(n)
    counted = df.withColumn("_n", n).withColumn("_ways", extension_counts("_n", at_most, exactly))
    first = F.get(F.element_at("_ways", -1), F.lit(1))
    too_many = F.raise_error(F.lit("more partitions than 64 bits can number")).cast("bigint")
    total = F.when(F.col("_n") >= 1, F.when(first >= 0, first).otherwise(too_many)).otherwise(F.lit(0).cast("bigint"))
    counted = counted.withColumn("_total", total)
    step = F.greatest(F.lit(RANGE), F.ceil(F.sqrt("_total")).cast("bigint"))
    starts = F.when(F.col("_total") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_total") - 1, step))
    ranges = counted.withColumn("_step", step).withColumn("_from", F.explode(starts))
    if dealt:
        ranges = spread(ranges)
    till = F.least(F.col("_from") + F.col("_step"), "_total") - 1
    numbered = ranges.withColumn("_rank", F.explode(F.sequence("_from", till)))
    rank = F.col("_total") - 1 - F.col("_rank") if reverse else F.col("_rank")
    out = numbered.withColumn("rgs", unrank(rank, "_n", "_ways"))
    if position:
        out = out.withColumn(position, F.col("_rank") + 1)
    return out.drop("_n", "_ways", "_total", "_step", "_from", "_rank")


def block_pairs(df: DataFrame, rgs: str = "rgs") -> DataFrame:
    """All label pairs s < t of each partition."""
    return df.withColumn("p", F.explode(label_pairs(rgs))).select("*", "p.s", "p.t").drop("p")


def merge_once(df: DataFrame, rgs: str = "rgs", out: str = "child") -> DataFrame:
    """One row per one-step coarsening."""
    return block_pairs(df, rgs).withColumn(out, merge_labels(rgs, "s", "t"))


def all_coarsenings(df: DataFrame, max_blocks: int | None = None, rgs: str = "rgs", out: str = "coarser") -> DataFrame:
    """The partition itself and every coarsening, each once.

    A coarsening is a partition of the blocks, so the enumeration of those gives all of them
    without a loop over levels and without a distinct.
    """
    inner = enumerate_partitions(
        df.withColumnRenamed(rgs, "_base"), F.array_max("_base") + 1, max_blocks, dealt=False
    )
    return inner.withColumn(out, compose("_base", "rgs")).drop("rgs").withColumnRenamed("_base", rgs)


def distinct_partitions(df: DataFrame, keys=("series_id",)) -> DataFrame:
    return df.dropDuplicates([*keys, "rgs"])


def labels_to_partition(params: DataFrame, value: str, order: str, keys=("series_id",)) -> DataFrame:
    """Equal values of ``value`` form one block; elements in the order of ``order``.

    Expects one row per element: the arrays hold the categories of a series, not raw rows.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v"))))
    return params.groupBy(*keys).agg(
        to_rgs(F.transform(items, lambda x: x["v"])).alias("rgs")
    ).withColumn("rgs_key", rgs_key("rgs"))


def labels_to_long(params: DataFrame, value: str, pos: str, keys=("series_id",)) -> DataFrame:
    """Long form of ``labels_to_partition``: a block number per element, no arrays."""
    labels = first_appearance_id(params, value, pos, list(keys))
    return params.join(labels, [*keys, value])


def common_coarsening(members: DataFrame, keys=("series_id",)) -> DataFrame:
    """Finest partition that coarsens all given ones, in long form: ``(*keys, pos, block)``, blocks by first appearance.

    ``members`` is ``(*keys, source, pos, label)``, one row per element and partition, any number of
    partitions. Elements and blocks are the nodes of a graph; in each round a block takes the smallest
    element of its members and an element the smallest of its blocks, and then the one that its
    element has (pointer jumping), so the rounds follow the logarithm of the longest chain. Each round is cut
    by a reliable checkpoint. No row holds a partition; the aggregates combine before the exchange, so a
    block of most elements is no hot key.
    """
    keys = list(keys)
    edges = materialise(members.select(*keys, "source", "label", "pos").distinct())
    roots = materialise(edges.select(*keys, "pos").distinct().withColumn("root", F.col("pos")))
    while True:
        here = edges.join(roots, [*keys, "pos"])
        lowest = here.groupBy(*keys, "source", "label").agg(F.min("root").alias("low"))
        joined = edges.join(lowest, [*keys, "source", "label"]).groupBy(*keys, "pos").agg(F.min("low").alias("low"))
        above = roots.select(*keys, F.col("pos").alias("low"), F.col("root").alias("next"))
        stepped = roots.join(joined, [*keys, "pos"]).join(above, [*keys, "low"], "left")
        found = materialise(stepped.select(*keys, "pos", F.col("root").alias("old"), F.least("low", F.coalesce("next", "low")).alias("root")))
        roots = found.drop("old")
        if found.filter("old <> root").isEmpty():
            break
    labels = first_appearance_id(roots, "root", "pos", keys)
    return roots.join(labels, [*keys, "root"]).select(*keys, "pos", F.col("label").alias("block"))


def drop_dominated(candidates: DataFrame, pruned: DataFrame, keys=("series_id",)) -> DataFrame:
    """Candidates that coarsen no pruned partition.

    A coarsening keeps together every pair the pruned partition keeps together. Each pruned
    partition is therefore sent to one such pair and meets only the candidates that share it:
    an equi join on (series, pair) instead of a comparison of all with all, which also splits a
    series over many keys. A pruned partition without any pair (all blocks single) is coarsened
    by everything and goes to the pair (0, 0).
    """
    keys = list(keys)
    whole = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))
    cand = candidates.select(
        *keys, "rgs", F.explode(F.concat(F.array(whole), together_pairs("rgs"))).alias("p")
    )
    pairs = F.col("pairs")
    any_pair = F.element_at(pairs, (F.pmod(F.hash("finer"), F.size(pairs)) + 1).cast("int"))
    bad = (
        pruned.select(*keys, F.col("rgs").alias("finer"))
        .distinct()
        .withColumn("pairs", together_pairs("finer"))
        .select(*keys, "finer", F.when(F.size(pairs) == 0, whole).otherwise(any_pair).alias("p"))
    )
    return without_hits(candidates, cand, bad, keys)


def without_hits(candidates: DataFrame, cand: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates minus those that share a pair with a pruned partition and coarsen it."""
    hit = (
        cand.join(bad, [*keys, "p"])
        .filter(is_coarsening("rgs", "finer"))
        .select(*keys, "rgs")
        .distinct()
    )
    return candidates.join(hit, [*keys, "rgs"], "left_anti")


def surviving_children(parents: DataFrame, pruned: DataFrame, keys=("series_id",)) -> DataFrame:
    """Distinct one-step coarsenings of ``parents`` that coarsen no pruned partition.

    Holds for parents that are not pruned and coarsen nothing pruned, as in the search. Then only
    the last merge can complete a pruned partition, so some pair of it crosses the two merged
    blocks: children go to their crossing pairs only, and pruned partitions to the pairs with the
    first element of each block. Both are far fewer than all pairs of a child. Several parents may
    give one child; any of them will do.
    """
    keys = list(keys)
    merges = merge_once(parents.select(*keys, "rgs")).groupBy(
        *keys, F.col("child").alias("_child")
    ).agg(F.min(F.struct("rgs", "s", "t")).alias("m"))
    children = merges.select(*keys, F.col("_child").alias("rgs"), "m")
    cand = children.select(*keys, "rgs", F.explode(cross_pairs("m.rgs", "m.s", "m.t")).alias("p"))
    bad = pruned.select(*keys, F.col("rgs").alias("finer"), F.explode(star_pairs("rgs")).alias("p"))
    return without_hits(children.select(*keys, "rgs"), cand, bad, keys)


def with_level(df: DataFrame, rgs: str = "rgs") -> DataFrame:
    """Level 1 is the finest partition; every merge goes one level up."""
    return df.withColumn("level", (F.size(rgs) - block_count(rgs)).cast("bigint"))
