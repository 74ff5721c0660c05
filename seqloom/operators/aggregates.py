"""Aggregations over groups, profiles and hierarchies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.storage import cut, dealt

from .blocks import shared_counts

#: Pairs that a row may meet in a join; where there are more, blocks are compared.
MANY = 50


def in_file_order(df: DataFrame, out: str) -> DataFrame:
    """A table read from files with ``out``: each row's place in them, which settles what an order leaves open."""
    return df.withColumn(out, F.struct("_metadata.file_path", "_metadata.row_index"))


def ordered_mean(order: Column, value: Column) -> Column:
    """A group's mean, its doubles summed in the order of ``order``; nulls don't count.

    Sums of doubles depend on their order in the last digit, which decides at a limit.
    """
    held = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.cast("double").alias("x")))))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda total, r: total + r["x"]), F.size(held))


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties averaged, as doubles."""
    w = Window.partitionBy(*by)
    ordered = w.orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(ordered) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): Spearman's correlation of each group's rows with both values."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(rows, by, x, "__rx"), by, y, "__ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__rx", "__ry").alias("rho"))


def category_correlations(pairs: DataFrame, members: DataFrame, by: str, category: str, trait: str, x: str, y: str) -> DataFrame:
    """(by, category, rho): Spearman's correlation of both values over a category's traits, for every ``by`` and category.

    ``pairs``: (by, trait, x, y); ``members``: (category, trait). Null where it isn't above 0, or where
    a category has no trait, or only equal ones, in common with the pairs.
    """
    each = pairs.select(by, trait, x, y).join(members.select(category, trait).distinct(), trait)
    found = spearman(each, [by, category], x, y).select(by, category, "rho")
    known = members.agg(F.collect_set(category)).scalar()  # the names of categories
    every = pairs.select(by).distinct().withColumn(category, F.explode(known))
    return every.join(found, [by, category], "left").withColumn("rho", F.when(F.col("rho") > 0, F.col("rho")))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, entropy in bits) of a value's distribution in each group."""
    counts = df.groupBy(*by, value).count()
    total = F.sum("count").over(Window.partitionBy(*by))
    share = F.col("count") / total
    return counts.withColumn("__h", -share * F.log2(share)).groupBy(*by).agg(F.sum("__h").alias("entropy"))


def drilldown(df: DataFrame, levels: list[str], by: list[str], weight: str, share: float) -> DataFrame:
    """(by, depth, path): the deepest level at which the greatest child still has ``share`` of all.

    From the top, each level goes to the child of most weight (ties: the least name)
    and stops at the first that has less than ``share`` of the group's total.
    """
    paths = F.transform(
        F.sequence(F.lit(1), F.lit(len(levels))), lambda d: F.slice(F.array(*[F.col(c) for c in levels]), 1, d)
    )
    nodes = (
        df.select(*by, F.col(weight).alias("__w"), F.explode(paths).alias("path"))
        .groupBy(*by, "path")
        .agg(F.sum("__w").alias("__w"))
        .withColumn("depth", F.size("path"))
    )
    total = F.sum(F.when(F.col("depth") == 1, F.col("__w"))).over(Window.partitionBy(*by))
    siblings = Window.partitionBy(*by, F.slice("path", 1, F.col("depth") - 1)).orderBy(F.desc("__w"), "path")
    nodes = nodes.withColumn("__ok", (F.row_number().over(siblings) == 1) & (F.col("__w") >= share * total))
    passing = nodes.filter("__ok").select(*by, "path", "depth")
    # a node counts only if all its prefixes pass too
    kept = passing.filter("depth = 1")
    found = kept
    for depth in range(2, len(levels) + 1):
        parents = kept.select(*by, F.col("path").alias("__up"))
        mine = passing.filter(F.col("depth") == depth).withColumn("__up", F.slice("path", 1, depth - 1))
        kept = mine.join(parents, [*by, "__up"], "left_semi").select(*by, "path", "depth")
        found = found.unionByName(kept)
    return found.groupBy(*by).agg(F.max(F.struct("depth", "path")).alias("__m")).select(
        *by, F.col("__m.depth").alias("depth"), F.array_join("__m.path", "; ").alias("path")
    )


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n, total) over fixed, maybe uneven edges; the last bin holds its upper edge too."""
    case = None
    for i in range(len(edges) - 1):
        upper = F.col(value) <= edges[-1] if i == len(edges) - 2 else F.col(value) < edges[i + 1]
        inside = (F.col(value) >= edges[i]) & upper
        case = F.when(inside, i) if case is None else case.when(inside, i)
    return df.withColumn("bin", case).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum(value).alias("total")
    )


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts as a row x column table, 0 where nothing is found; ``values`` are fixed beforehand."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def collapsed_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals (inclusive ends) merged: (by, start, end)."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    runs = dealt(df, by, df.count()).withColumn("__open", opens).withColumn("__run", F.sum("__open").over(order))
    return runs.groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def covered(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, covered): places under at least one interval (inclusive ends)."""
    return collapsed_intervals(df, by, start, end).groupBy(*by).agg(
        F.sum(F.col(end) - F.col(start) + 1).alias("covered")
    )


def similarity_of_splits(splits: DataFrame, hits: DataFrame, min_identity: float, min_cover: float) -> DataFrame:
    """(query, reference, ani, af): identity and aligned fraction of a genome's pieces.

    ``splits``: (query, split, length); ``hits``: (query, split, reference, identity,
    length). The best hit of a piece is that of greatest identity times length; ani
    weighs identities by hit length over the matched pieces' length. Every query comes with
    every reference that has a hit at all; both are 0 where none passes.
    """
    best = hits.groupBy("query", "split", "reference").agg(
        F.max_by(F.struct("identity", F.col("length").alias("hit_length")), F.struct(F.col("identity") * F.col("length"), "length")).alias("h")
    )
    joined = splits.join(best, ["query", "split"])
    good = joined.filter(
        (F.col("h.identity") >= min_identity) & (F.col("h.hit_length") >= min_cover * F.col("length"))
    )
    total = splits.groupBy("query").agg(F.sum("length").alias("total"))
    sums = good.groupBy("query", "reference").agg(
        F.sum(F.col("h.identity") * F.col("h.hit_length")).alias("weighted"), F.sum("length").alias("matched")
    )
    # the result is a full matrix of genomes: a row for each query and reference
    references = hits.agg(F.collect_set("reference").alias("r"))
    every = total.withColumn("reference", F.explode(references.scalar()))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.join(sums, ["query", "reference"], "left").select(
        "query",
        "reference",
        zero(F.col("weighted") / F.col("matched")).alias("ani"),
        zero(F.col("matched") / F.col("total")).alias("af"),
    )


def relative_entropy(df: DataFrame, by: list[str], observed: str, expected: str) -> DataFrame:
    """(by, relative_entropy): sum of observed * ln(observed / expected)."""
    term = F.when(F.col(observed) > 0, F.col(observed) * F.ln(F.col(observed) / F.col(expected))).otherwise(0.0)
    return df.groupBy(*by).agg(F.sum(term).alias("relative_entropy"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def shared_clusters(df: DataFrame, member: str, cluster: str) -> DataFrame:
    """(a, b, shared): in how many clusters two members lie together (pairs that share any).

    The result holds every such pair. Where clusters are small, pairs within them are counted, map-side
    first; else members are compared block by block, so that only they are shuffled.
    """
    rows = cut(df.select(member, cluster).distinct())
    sizes = rows.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").cast("double").alias("n"))
    met = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("met")).first()["met"]
    if met > MANY * rows.count():
        return shared_counts(rows, member, cluster, lambda n, m, shared: np.where(shared > 0, shared, -1), "shared")
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col(f"x.{cluster}") == F.col(f"y.{cluster}")) & (F.col(f"x.{member}") < F.col(f"y.{member}")))
    return pairs.groupBy(F.col(f"x.{member}").alias("a"), F.col(f"y.{member}").alias("b")).agg(F.count("*").alias("shared"))
