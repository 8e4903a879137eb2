"""Set partitions as ``array<int>`` label strings (first label 0, new labels in order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideshare.functions.numbers import col, let


def is_rgs(a: Column | str) -> Column:
    """Whether the labels start at 0 and never jump past 1 + the largest label so far."""
    return F.aggregate(
        col(a),
        F.struct(F.lit(-1).alias("top"), F.lit(True).alias("ok")),
        lambda acc, x: F.struct(
            F.greatest(acc["top"], x.cast("int")).alias("top"),
            (acc["ok"] & (x >= 0) & (x <= acc["top"] + 1)).alias("ok"),
        ),
        lambda acc: acc["ok"],
    )


def to_rgs(a: Column | str) -> Column:
    """Relabel any array by order of first appearance."""
    a = col(a)
    return let(
        F.array_distinct(a),
        lambda names: F.transform(a, lambda x: (F.array_position(names, x) - 1).cast("int")),
    )


def extension_counts(n: Column | str, at_most: Column | str | None = None, exactly: Column | str | None = None) -> Column:
    """Entry ``b`` of row ``m``, both from 0: in how many ways ``m`` more elements extend a label string of ``b`` blocks.

    Rows 0 to ``n - 1``; row ``m`` ends at ``n - m`` blocks. The next element joins one of the ``b`` blocks or opens
    one. Numbers beyond 64 bits are -1.
    """
    n = col(n)
    if exactly is not None:
        fits = lambda b: b == col(exactly)
    else:
        fits = (lambda b: b <= col(at_most)) if at_most is not None else (lambda b: F.lit(True))

    def longer(rows: Column, m: Column) -> Column:
        def ways(b: Column) -> Column:
            joins, opens = (F.get(F.element_at(rows, -1), to) for to in (b, b + 1))
            both = F.try_add(F.try_multiply(b.cast("bigint"), joins), opens)
            return F.when((joins < 0) | (opens < 0), F.lit(-1).cast("bigint")).otherwise(F.coalesce(both, F.lit(-1).cast("bigint")))

        return F.array_append(rows, F.transform(F.sequence(F.lit(0), n - m), ways))

    none = F.transform(F.sequence(F.lit(0), n), lambda b: fits(b).cast("bigint"))
    return F.aggregate(F.filter(F.sequence(F.lit(0), n - 1), lambda m: m > 0), F.array(none), longer)


def unrank(rank: Column | str, n: Column | str, ways: Column | str) -> Column:
    """The label string of length ``n`` with the number ``rank`` (from 0, lexicographic); ``ways`` are its ``extension_counts``.

    A label that is taken stands for as many strings as the rest can be extended in, so the number is divided
    by that; what is beyond all taken labels belongs to the new one.
    """
    start = F.struct(col(rank).cast("bigint").alias("left"), F.lit(1).cast("bigint").alias("blocks"), F.array(F.lit(0)).alias("labels"))

    def step(acc: Column, m: Column) -> Column:
        each = F.get(F.get(col(ways), m - 1), acc["blocks"].cast("int"))
        taken = F.when(each > 0, F.least(F.call_function("div", acc["left"], each), acc["blocks"])).otherwise(acc["blocks"])
        return let(taken, lambda label: F.struct(
            (acc["left"] - label * each).alias("left"),
            F.greatest(acc["blocks"], label + 1).alias("blocks"),
            F.array_append(acc["labels"], label.cast("int")).alias("labels")))

    order = F.filter(F.sequence(col(n) - 1, F.lit(0)), lambda m: m > 0)
    return F.aggregate(order, start, step, lambda acc: acc["labels"])


def rgs_to_blocks(a: Column | str) -> Column:
    """One-based positions per label."""
    a = col(a)
    return F.transform(
        F.array_distinct(a),
        lambda v: F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.element_at(a, i) == v),
    )


def sort_partition(p: Column | str) -> Column:
    """Sort inside the blocks, then the blocks (disjoint, so by first element)."""
    return F.array_sort(F.transform(col(p), lambda b: F.array_sort(b)))


def ground_set(p: Column | str) -> Column:
    return F.array_sort(F.flatten(col(p)))


def blocks_to_rgs(p: Column | str) -> Column:
    """Label each element 1..max by the rank of its block."""
    return let(
        sort_partition(p),
        lambda s: F.transform(
            F.sequence(F.lit(1), F.array_max(F.flatten(s))),
            lambda e: (
                F.array_position(F.transform(s, lambda b: F.array_contains(b, e)), True) - 1
            ).cast("int"),
        ),
    )


def is_partition(p: Column | str, elements: Column | str) -> Column:
    """No empty block, and every listed element in exactly one block."""
    p = col(p)
    return F.forall(p, lambda b: F.size(b) > 0) & F.forall(
        col(elements),
        lambda e: F.size(F.filter(p, lambda b: F.array_contains(b, e))) == 1,
    )


def is_subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(col(a), col(b))) == 0


def is_coarsening(y: Column | str, x: Column | str) -> Column:
    """Whether every block of ``x`` lies inside one block of ``y``."""
    x, y = col(x), col(y)
    pairs = F.array_distinct(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.when(F.size(x) == F.size(y), F.size(pairs) == F.size(F.array_distinct(x))).otherwise(
        F.raise_error(F.lit("partitions of different length"))
    )


def is_refinement(x: Column | str, y: Column | str) -> Column:
    return is_coarsening(y, x)


def block_count(a: Column | str) -> Column:
    """Number of blocks besides the one that holds the first element."""
    return F.array_max(col(a))


def merge_labels(a: Column | str, s: Column | str, t: Column | str) -> Column:
    """Merge label t into label s < t and close the gap."""
    s, t = col(s), col(t)
    return F.transform(
        col(a), lambda x: F.when(x == t, s).when(x > t, x - 1).otherwise(x)
    )


def label_pairs(a: Column | str) -> Column:
    """All label pairs s < t as ``array<struct<s,t>>``."""
    top = F.array_max(col(a))
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), top),
            lambda s: F.transform(
                F.filter(F.sequence(F.lit(0), top), lambda t: t > s),
                lambda t: F.struct(s.alias("s"), t.alias("t")),
            ),
        )
    )


def one_step_merges(a: Column | str) -> Column:
    """All one-step coarsenings of one partition as ``array<array<int>>``."""
    a = col(a)
    return F.transform(label_pairs(a), lambda p: merge_labels(a, p["s"], p["t"]))


def compose(a: Column | str, outer: Column | str) -> Column:
    """Coarsen ``a`` by a partition of its own blocks."""
    outer = col(outer)
    return F.transform(col(a), lambda x: F.element_at(outer, x + 1))


def common_children(a: Column | str, b: Column | str) -> Column:
    """Shared one-step coarsenings of two partitions of equal level."""
    a, b = col(a), col(b)
    return F.when(
        F.array_max(a) == F.array_max(b), F.array_intersect(one_step_merges(a), one_step_merges(b))
    ).otherwise(F.raise_error(F.lit("partitions of different levels")))


def finest_common_coarsening(a: Column | str, b: Column | str) -> Column:
    """Finest partition that coarsens both: join labels of ``a`` along the blocks of ``b``."""
    a, b = col(a), col(b)

    def absorb(labels: Column, i: Column) -> Column:
        here = F.element_at(labels, i)
        root = F.element_at(labels, F.array_position(b, F.element_at(b, i)).cast("int"))
        return F.transform(
            labels,
            lambda x: F.when(x == F.greatest(here, root), F.least(here, root)).otherwise(x),
        )

    joined = F.aggregate(F.sequence(F.lit(1), F.size(a)), a, absorb)
    return F.when(F.size(a) == F.size(b), to_rgs(joined)).otherwise(
        F.raise_error(F.lit("partitions of different length"))
    )


def together_pairs(a: Column | str) -> Column:
    """All position pairs i < j that share a block."""
    a = col(a)
    places = F.sequence(F.lit(1), F.size(a))
    return F.flatten(
        F.transform(
            places,
            lambda i: F.transform(
                F.filter(places, lambda j: (j > i) & (F.element_at(a, i) == F.element_at(a, j))),
                lambda j: F.struct(i.alias("i"), j.alias("j")),
            ),
        )
    )


def star_pairs(a: Column | str) -> Column:
    """Each position paired with the first one of its block."""
    a = col(a)
    first = lambda j: F.array_position(a, F.element_at(a, j)).cast("int")
    later = F.filter(F.sequence(F.lit(1), F.size(a)), lambda j: first(j) < j)
    return F.transform(later, lambda j: F.struct(first(j).alias("i"), j.alias("j")))


def cross_pairs(a: Column | str, s: Column | str, t: Column | str) -> Column:
    """All position pairs i < j with one in block s and the other in block t."""
    a, s, t = col(a), col(s), col(t)
    places = F.sequence(F.lit(1), F.size(a))
    return F.flatten(
        F.transform(
            F.filter(places, lambda i: F.element_at(a, i) == s),
            lambda i: F.transform(
                F.filter(places, lambda j: F.element_at(a, j) == t),
                lambda j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")),
            ),
        )
    )


def rgs_key(a: Column | str) -> Column:
    return F.array_join(col(a), "-")


def parse_rgs(key: Column | str) -> Column:
    return F.split(col(key), "-").cast("array<int>")


def rgs_digest(a: Column | str) -> Column:
    """Hex SHA-1 of the label string."""
    return F.sha1(rgs_key(a))
