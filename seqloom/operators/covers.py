"""Greedy orders of members (genomes) by the items (clusters) that they have."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqloom.storage import cut

from .windows import numbered

#: Pairs that one task may hold; more are handled in distributed rounds.
FEW = 500_000


def _picks(pairs: pd.DataFrame, taken: Callable[[set, set], set]) -> list[tuple]:
    """(member, count) in greedy order: most of the remaining items first (ties: the greatest name).

    ``taken(remaining, of)`` are the items that go when a member with the items ``of`` is picked.
    Counts only fall, so that a member is asked again only when it leads.
    """
    has, holders = defaultdict(set), defaultdict(list)
    for item, member in zip(pairs["item"], pairs["member"]):
        has[member].add(item)
        holders[item].append(member)
    names = {m: i for i, m in enumerate(sorted(has))}
    remaining = set(holders)
    counts = {m: len(s) for m, s in has.items()}
    heap = [(-n, -names[m], m) for m, n in counts.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        n, name, member = heapq.heappop(heap)
        if -n != counts[member]:
            heapq.heappush(heap, (-counts[member], name, member))
            continue
        out.append((member, -n))
        gone = taken(remaining, has[member])
        remaining -= gone
        for item in gone:
            for other in holders[item]:
                counts[other] -= 1
    return out


def _finish(pairs: DataFrame, taken: Callable[[set, set], set]) -> DataFrame:
    """(member, n, step): the greedy order of at most FEW pairs, in one task."""
    kind = dict(pairs.dtypes)["member"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        picks = _picks(rows, taken)
        return pd.DataFrame({"member": [m for m, _ in picks], "n": [n for _, n in picks], "step": range(len(picks))})

    return pairs.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"member {kind}, n long, step long")


def _pairs(df: DataFrame, item: str, member: str) -> DataFrame:
    return cut(df.select(F.col(item).alias("item"), F.col(member).alias("member")).dropna().distinct())


def greedy_cover(df: DataFrame, item: str, member: str, rounds: int | None = None, few: int = FEW) -> DataFrame:
    """(place, member, new, total): members by how many uncovered items they add.

    The member with most new items comes next (ties: the greatest name), until
    nothing is left or, if given, ``rounds`` members are placed. Adding a member changes only the gains of
    those that share an uncovered item with it. A round therefore fixes, at once, all
    members that lead each of their items; later gains being smaller, the order is that of (gain, name). What
    is left of at most ``few`` pairs is finished in one task.
    """
    left, fixed = _pairs(df, item, member), []
    while left.count() > few:
        gains = left.groupBy("member").agg(F.count("*").alias("n"))
        mine = F.struct("n", "member")
        rows = left.join(gains, "member")
        leaders = rows.groupBy("item").agg(F.max(mine).alias("lead"))
        led = leaders.groupBy(F.col("lead.member").alias("member"), F.col("lead.n").alias("n")).agg(F.count("*").alias("k"))
        first = cut(led.filter("k = n").select("member", "n"))
        fixed.append(first)
        gone = left.join(first, "member", "left_semi").select("item")
        left = cut(left.join(gone, "item", "left_anti"))
    rest = _finish(left, lambda remaining, of: remaining & of).filter("n > 0").select("member", "n")
    for some in fixed:
        rest = rest.unionByName(some)
    placed = numbered(rest, [F.desc("n"), F.desc("member")], total="n")
    if rounds is not None:
        placed = placed.filter(F.col("place") <= rounds)
    return placed.select(F.col("place").cast("int").alias("place"), F.col("member").alias(member), F.col("n").alias("new"), "total")


def greedy_core(df: DataFrame, item: str, member: str, few: int = FEW) -> DataFrame:
    """(place, member, total): members in the order that keeps most items common to all so far.

    Starts with the member of most items; the one that has most of the core comes next (ties:
    the greatest name), and the core shrinks to what it has. All members get a place, those without any
    of the core last. While more than ``few`` pairs of core items are left, each round places one
    member; the core then is no larger than the smallest share of it that any had.
    """
    left, fixed, total = _pairs(df, item, member), [], 0
    members = cut(left.select("member").distinct())
    size = members.count()
    while left.count() > few:
        best = left.groupBy("member").count().orderBy(F.desc("count"), F.desc("member")).first()
        fixed.append((best["member"], best["count"]))
        core = left.filter(F.col("member") == best["member"]).select("item")
        left = cut(left.join(core, "item", "left_semi").filter(F.col("member") != best["member"]))
    kind = dict(members.dtypes)["member"]
    begun = df.sparkSession.createDataFrame([(m, n, i) for i, (m, n) in enumerate(fixed)], f"member {kind}, n long, step long")
    later = _finish(left, lambda remaining, of: remaining - of).filter("n > 0").withColumn("step", F.col("step") + len(fixed))
    some = cut(begun.unionByName(later))
    none = members.join(some, "member", "left_anti").select("member", F.lit(0).cast("long").alias("n"), F.lit(size).cast("long").alias("step"))
    placed = numbered(some.unionByName(none), [F.col("step"), F.desc("member")])
    return placed.select(F.col("place").cast("int").alias("place"), F.col("member").alias(member), F.col("n").alias("total"))
