"""Trees of any depth: walks go as far as they can in a task, then from block to block or by doubling their reach.

Joins with a round's table are sorted and merged by a hint: its files are small for their rows, so that
Spark would take it for a table to broadcast and bring it to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.storage import stored

#: Links that one task follows at a time.
BLOCK = 300_000


def written(df: DataFrame) -> DataFrame:
    """Written once: a checkpoint would compute each round twice."""
    return stored(df, "hierarchy")


def _edges(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("to"))
    return rows.filter("node <> to").distinct()  # no parent, or itself: a root


def jumps(edges: DataFrame) -> list[DataFrame]:
    """Of (node, to) the steps of 1, 2, 4, ... edges; a cycle is an error.

    A path without a cycle has fewer edges than there are nodes with one.
    """
    steps = [written(edges.select("node", "to"))]
    most = steps[0].count()
    while not steps[-1].isEmpty():
        if 2 ** (len(steps) - 1) > most:
            raise ValueError("parents go in a circle")
        on = steps[-1].select(F.col("node").alias("__via"), F.col("to").alias("__to"))
        steps.append(written(steps[-1].join(on.hint("merge"), F.col("to") == F.col("__via")).select("node", F.col("__to").alias("to"))))
    return steps[:-1]


def closure(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) for every node, itself at depth 0.

    Ancestors within a reach are those within half of it, and those of the node that far above.
    Rounds grow with the logarithm of the depth; parents in a circle are an error.
    """
    edges = _edges(nodes, node, parent)
    own = nodes.select(F.col(node).alias("node"))
    every = own.union(edges.select("to")).distinct()  # with parents that aren't nodes themselves
    found = every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    for k, step in enumerate(jumps(edges)):
        on = found.select(F.col("node").alias("__n"), "ancestor", "depth")
        further = step.join(on.hint("merge"), F.col("to") == F.col("__n")).select("node", "ancestor", (F.col("depth") + 2**k).alias("depth"))
        found = written(found.unionByName(further))
    return own.join(found.hint("merge"), "node").select("node", "ancestor", "depth")


def _plus(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a + b, a, b)


def _taken_over(links: DataFrame) -> DataFrame:
    """Links that aren't done, moved on by what the link at their end has reached."""
    on = links.select(*[F.col(c).alias(f"__{c}") for c in links.columns])
    moved = links.filter("NOT done").join(on.hint("merge"), F.col("to") == F.col("__node")).select(
        "node", F.col("__to").alias("to"), F.col("__done").alias("done"),
        (F.col("steps") + F.col("__steps")).alias("steps"), _plus("length", "__length").alias("length"),
    )
    return links.filter("done").unionByName(moved)


def _local(node: pd.Series, to: pd.Series, open_: np.ndarray) -> np.ndarray:
    """The place, among these, of the link at the end of each open one; -1 where there is none or more than one."""
    lone = np.flatnonzero(~node.duplicated(keep=False).to_numpy())
    at = pd.Index(node.iloc[lone]).get_indexer(to)
    return np.where(open_ & (at >= 0), lone[at] if len(lone) else -1, -1)


def _in_blocks(links: DataFrame, n: int) -> DataFrame:
    """Links followed, in memory, as long as they stay in a block of neighbouring nodes; with ``first`` and ``block``.

    Where parents have names near those of their children few links leave their block. A circle is left as it is.
    """
    links = links.select("node", "to", "done", "steps", "length", F.col("to").alias("first"))
    ranged = links.repartitionByRange(max(math.ceil(n / BLOCK), 1), "node").withColumn("block", F.spark_partition_id())

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        rows = pa.Table.from_batches(found)
        done = rows["done"].to_numpy()
        steps, sums = rows["steps"].to_numpy().copy(), rows["length"].fill_null(0).to_numpy().copy()
        none = rows["length"].is_null().to_numpy().copy()
        at = _local(rows["node"].to_pandas(), rows["to"].to_pandas(), ~done)
        end, rounds = np.arange(len(at)), 0
        while len(i := np.flatnonzero(at >= 0)):
            if 2**rounds > len(at):
                yield from found
                return
            j, rounds = at[i], rounds + 1
            for held in (steps, sums):
                held[i] += held[j]
            none[i] &= none[j]
            end[i], at[i] = end[j], at[j]
        made = {"to": rows["to"].take(end), "done": pa.array(done[end]), "steps": pa.array(steps), "length": pa.array(sums, mask=none)}
        for name, column in made.items():
            rows = rows.set_column(rows.column_names.index(name), rows.schema.field(name), column)
        yield from rows.combine_chunks().to_batches(20_000)

    return written(ranged.mapInArrow(follow, ranged.schema))


def ended(links: DataFrame) -> DataFrame:
    """(node, to, steps, length): links followed until one that is done, steps and lengths added up.

    ``links``: (node, to, done, steps, length); where a link isn't done, ``to`` has one itself.
    Links are followed within blocks; what leaves them leads to few others, which are followed by
    themselves, and all take over what these have reached. Links in a circle are an error.
    """
    most = (links := written(links.select("node", "to", "done", "steps", "length"))).count()
    met = _in_blocks(links, most)
    away = met.filter("NOT done")
    if away.isEmpty():
        return met.select("node", "to", "steps", "length")
    onward = written(met.drop("first", "block").join(away.select(F.col("to").alias("node")).distinct().hint("merge"), "node", "left_semi"))
    found = ended(onward) if onward.count() <= most // 2 else _doubled(onward)
    on = found.select(*[F.col(c).alias(f"__{c}") for c in found.columns])
    moved = away.join(on.hint("merge"), F.col("to") == F.col("__node")).select(
        "node", F.col("__to").alias("to"), (F.col("steps") + F.col("__steps")).alias("steps"), _plus("length", "__length").alias("length")
    )
    return met.filter("done").select("node", "to", "steps", "length").unionByName(moved)


def _doubled(links: DataFrame) -> DataFrame:
    """``ended`` where names say nothing of what is near: a link takes over what the one at its end has reached, twice a round.

    Rounds grow with the logarithm of the way.
    """
    most, reach = links.count(), 1
    while not links.filter("NOT done").isEmpty():
        if reach > most:
            raise ValueError("parents go in a circle")
        links = written(_taken_over(_taken_over(links)))
        reach *= 4
    return links.drop("done")


def at_or_above(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(node): those of ``marked`` (node) and all that lie above them by the edges (node, to).

    Within blocks marks rise in memory; between them by way of the few nodes that edges of another block lead to.
    """
    most = (edges := written(edges.select("node", "to"))).count()
    met = _in_blocks(edges.select("node", "to", F.lit(False).alias("done"), F.lit(1).cast("long").alias("steps"), F.lit(0).alias("length")), most)
    entered = met.select(F.col("to").alias("node")).distinct()
    onward = written(met.join(entered.hint("merge"), "node", "left_semi").select("node", "to"))
    marked = written(marked.select("node").distinct())
    if onward.count() > most // 2:  # names say nothing of what is near: marks rise by 1, 2, 4, ... edges
        for step in jumps(edges):
            risen = step.join(marked.hint("merge"), "node").select(F.col("to").alias("node"))
            marked = written(marked.union(risen).distinct())
        return marked
    out = met.join(marked.hint("merge"), "node", "left_semi").select(F.col("to").alias("node")).distinct()
    marked = written(marked.union(out if onward.isEmpty() else at_or_above(onward, out)).distinct())

    def rise(group: pd.DataFrame) -> pd.DataFrame:
        at, on = _local(group["node"], group["to"], np.ones(len(group), bool)), group["on"].to_numpy().copy()
        while (at >= 0).any():
            on[at[on & (at >= 0)]] = True
            at = np.where(at >= 0, at[at], -1)
        return group.loc[on, ["node"]]

    flagged = met.select("node", F.col("first").alias("to"), "block").join(marked.withColumn("__on", F.lit(True)).hint("merge"), "node", "left")
    flagged = flagged.select("node", "to", "block", F.coalesce("__on", F.lit(False)).alias("on"))
    risen = flagged.groupBy("block").applyInPandas(rise, flagged.select("node").schema)
    return marked.union(risen).distinct()


def roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of every node: the top of its tree and how far below it lies.

    A parent that isn't a node itself is a top.
    """
    edges = _edges(nodes, node, parent)
    on = edges.select(F.col("node").alias("to"), F.lit(True).alias("__on")).distinct()
    links = edges.join(on.hint("merge"), "to", "left").select(
        "node", "to", F.col("__on").isNull().alias("done"), F.lit(1).cast("long").alias("steps"), F.lit(0.0).alias("length")
    )
    below = ended(links).select("node", F.col("to").alias("root"), F.col("steps").alias("depth"))
    tops = nodes.select(F.col(node).alias("node")).distinct().join(below.select("node").hint("merge"), "node", "left_anti")
    return below.unionByName(tops.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth")))


def lineage_sums(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, n, ancestors, depth): how many nodes (whole numbers) its lineage has, itself included, their sum and the depth.

    The same as over ``closure``, but no row for each pair of node and ancestor is made.
    """
    edges = _edges(nodes, node, parent)
    on = edges.select(F.col("node").alias("to"), F.lit(True).alias("__on")).distinct()
    links = edges.join(on.hint("merge"), "to", "left").select(
        "node", "to", F.col("__on").isNull().alias("done"), F.lit(1).cast("long").alias("steps"), F.col("to").cast("long").alias("length")
    )
    own = nodes.select(F.col(node).alias("node"))
    above = own.join(ended(links).select("node", "steps", "length").hint("merge"), "node", "left")
    depth = F.coalesce("steps", F.lit(0).cast("long"))
    return above.select("node", (depth + 1).alias("n"), (F.col("node") + F.coalesce("length", F.lit(0))).alias("ancestors"), depth.cast("int").alias("depth"))


def taxonomy(nodes: DataFrame, root: str) -> DataFrame:
    """(taxid, parent, rank, name, depth) of the nodes (taxid, parent, rank, name) at or below ``root``.

    The root has no parent and the rank "root"; a superkingdom right below it is a kingdom.
    """
    is_root = F.col("taxid") == root
    cleared = nodes.select("taxid", F.when(~is_root, F.col("parent")).alias("parent"), "rank", "name")
    found = roots(cleared, "taxid", "parent").filter(F.col("root") == root).select(F.col("node").alias("taxid"), "depth")
    rank = F.when(is_root, "root").when((F.col("depth") == 1) & (F.col("rank") == "superkingdom"), "kingdom").otherwise(F.col("rank"))
    return cleared.join(found, "taxid").select("taxid", "parent", rank.alias("rank"), "name", "depth")


def pruned(nodes: DataFrame, names: DataFrame | None = None, pattern: str | None = None, remove: bool = False) -> DataFrame:
    """(tree, node, parent, name, length) of trees without the unwanted leaves, however deep.

    Leaves in ``names`` (name, maybe new_name) are kept and renamed, or dropped with
    ``remove``; those whose name matches ``pattern`` from its start are treated alike. Inner
    nodes left without leaves go; one left with a single child is joined with it,
    their lengths being summed. The root stays.
    """
    key = F.concat(F.col("tree").cast("string"), F.lit(":"))
    rows = written(nodes.select("*", F.concat(key, "node").alias("__n"), F.when(F.col("parent").isNotNull(), F.concat(key, "parent")).alias("__p")))
    inner = rows.filter("__p IS NOT NULL").select(F.col("__p").alias("__n")).distinct()
    leaves = rows.join(inner.hint("merge"), "__n", "left_anti")
    listed = F.lit(False)
    if names is not None:
        renamed = names if "new_name" in names.columns else names.withColumn("new_name", F.lit(None).cast("string"))
        renamed = renamed.dropDuplicates(["name"]).select("name", "new_name", F.lit(True).alias("__in"))
        leaves = leaves.join(renamed, "name", "left")
        listed = F.coalesce("__in", F.lit(False))
    else:
        leaves = leaves.withColumn("new_name", F.lit(None).cast("string"))
    if pattern is not None:
        listed = listed | F.col("name").rlike(f"^(?:{pattern})")
    kept = written(leaves.filter(~listed if remove else listed).select("__n", "new_name"))
    # what lies above a kept leaf lives
    alive = at_or_above(_edges(rows, "__n", "__p"), kept.select(F.col("__n").alias("node"))).withColumnRenamed("node", "__n")
    alive = alive.union(rows.filter("__p IS NULL").select("__n")).distinct()
    living = written(rows.join(alive.hint("merge"), "__n", "left_semi"))
    children = living.filter("__p IS NOT NULL").groupBy(F.col("__p").alias("__n")).agg(F.count("*").alias("__c"))
    stays = living.join(children.hint("merge"), "__n", "left").filter("__p IS NULL OR __c IS NULL OR __c > 1")
    stays = written(stays.join(kept.hint("merge"), "__n", "left").select("__n", "tree", "node", F.coalesce("new_name", "name").alias("name")))
    # the first node above that stays is the new parent; lengths on the way to it are summed
    ends = stays.select(F.col("__n").alias("__p"), F.lit(True).alias("__end"))
    links = living.filter("__p IS NOT NULL").join(ends.hint("merge"), "__p", "left").select(
        F.col("__n").alias("node"), F.col("__p").alias("to"), F.col("__end").isNotNull().alias("done"),
        F.lit(1).cast("long").alias("steps"), F.col("length"),
    )
    found = ended(links).select(F.col("node").alias("__n"), F.col("to").alias("__to"), "length")
    above = stays.select(F.col("__n").alias("__to"), F.col("node").alias("parent"))
    return stays.join(found.hint("merge"), "__n", "left").join(above.hint("merge"), "__to", "left").select("tree", "node", "parent", "name", "length")


def newick(nodes: DataFrame) -> DataFrame:
    """(tree, newick) of a node table (tree, node, parent, name, length), siblings in order of their nodes.

    The tour round a tree enters and leaves every node once. Each of these events knows the next one;
    how far it is from the tour's end, found by doubled links, is the place of its
    text, so that deep trees take no more rounds than broad ones. A name with a character that the format
    uses is an error, and so is a tree without one root.
    """
    by_parent = Window.partitionBy("tree", "parent").orderBy("node")
    wrong = F.coalesce(F.col("name"), F.lit("")).rlike(r"[(),:;\s]")
    name = F.when(wrong, F.raise_error(F.concat(F.lit("no newick name: "), "name"))).otherwise(F.coalesce("name", F.lit("")))
    label = F.concat(name, F.when(F.col("length").isNotNull(), F.concat(F.lit(":"), F.col("length").cast("string"))).otherwise(""))
    rows = written(
        nodes.select(
            "tree", "node", "parent", label.alias("label"),
            F.lead("node").over(by_parent).alias("next"), (F.row_number().over(by_parent) == 1).alias("first"),
        )
    )
    tops = rows.filter("parent IS NULL").groupBy("tree").agg(F.count("*").alias("n"))
    more = tops.filter("n > 1").first()
    if more is not None or rows.select("tree").distinct().join(tops, "tree", "left_anti").head(1):
        raise ValueError("a tree without one root")
    child = rows.filter("first AND parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.col("node").alias("child"))
    rows = written(rows.join(child.hint("merge"), ["tree", "node"], "left"))
    event = lambda side, node: F.concat_ws(":", F.col("tree").cast("string"), F.col(node).cast("string"), F.lit(side))
    inner, top = F.col("child").isNotNull(), F.col("parent").isNull()
    comma = F.when(top | F.col("first"), "").otherwise(",")
    enter = rows.select(
        "tree", event("in", "node").alias("node"), F.concat(comma, F.when(inner, "(").otherwise("")).alias("text"),
        F.when(inner, event("in", "child")).otherwise(event("out", "node")).alias("to"),
    )
    leave = rows.select(
        "tree", event("out", "node").alias("node"), F.concat(F.when(inner, ")").otherwise(""), "label", F.when(top, ";").otherwise("")).alias("text"),
        F.when(F.col("next").isNotNull() & ~top, event("in", "next")).when(~top, event("out", "parent")).alias("to"),
    )
    events = written(enter.unionByName(leave))
    last = events.filter("to IS NULL").select(F.col("node").alias("to"), F.lit(True).alias("__end"))
    links = events.filter("to IS NOT NULL").join(last.hint("merge"), "to", "left").select(
        "node", "to", F.col("__end").isNotNull().alias("done"), F.lit(1).cast("long").alias("steps"), F.lit(0.0).alias("length")
    )
    placed = events.join(ended(links).select("node", "steps").hint("merge"), "node", "left").select("tree", "text", F.coalesce(-F.col("steps"), F.lit(0)).alias("at"))
    return placed.groupBy("tree").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda e: e["text"]), "").alias("newick")
    )
