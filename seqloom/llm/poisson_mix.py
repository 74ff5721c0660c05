"""Mixing sources to target weights by Poisson replication (operator 5).

A source's rate is its share of the wanted rows over its rows at hand. Each
document draws its count from the Poisson distribution of that mean by inverting
its cumulative distribution at a uniform number hashed from seed and id, so that
counts don't depend on partitions or on other documents. Rows are exploded by
their counts and dealt out by a hash of (seed, id, copy), then sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Standard deviations above the mean where the distribution's table ends.
TAIL = 12
#: Parts of a source's rows where documents have to be joined by source.
SALTS = 256


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 up to 1 (52 bits) hashed from seed and parts."""
    return hashed(seed, *parts) / F.lit(float(1 << 52))


def hashed(seed: int, *parts: Column) -> Column:
    """The first 52 bits of an MD5, as a long."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(F.encode(joined, "UTF-8")), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(source, n, rate): rows at hand and mean copies of each source.

    ``epochs`` times all rows are wanted, shared out by weights; sources without a
    weight get 1 (None: all equal).
    """
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    all_rows = Window.partitionBy(F.lit(0))  # a row per source
    return counts.withColumn("weight", weight).select(
        "source",
        "n",
        (F.sum("n").over(all_rows) * epochs * F.col("weight") / F.sum("weight").over(all_rows) / F.col("n")).alias("rate"),
    )


def inversions(rated: DataFrame) -> DataFrame:
    """(source, cdf): P(count <= k) for k = 0, 1, ... up to TAIL deviations above the mean."""
    terms = rated.select(
        "source",
        "rate",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + TAIL * F.sqrt("rate") + TAIL).cast("int"))).alias("k"),
    )
    by_k = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = F.sum(F.when(F.col("k") > 0, F.ln(F.col("rate") / F.col("k"))).otherwise(0.0)).over(by_k) - F.col("rate")
    cdf = terms.withColumn("p", F.exp(log_p)).withColumn("c", F.sum("p").over(by_k))
    return cdf.groupBy("source").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf")
    )


def free_name(name: str, taken: list[str]) -> str:
    """The name, behind as many underscores as set it apart from those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def replicate(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 17,
    max_broadcast: int = 2_000_000,
) -> DataFrame:
    """Rows of ``docs`` (all columns) times their counts, in a global random order.

    Adds ``copy_no`` (from 0) and ``shuffle_key``; where docs has such a column, the
    added one gets underscores in front. A null source is a source of its own. Rows
    that repeat an id have equal counts; a null id draws as the text "null" does. Null,
    empty and very long texts are rows like others. Weights must be positive. An empty
    table gives an empty result.

    Distributions go to all tasks as long as they have at most ``max_broadcast``
    entries in all (16 MB), so that documents are shuffled once. Beyond that they are
    joined by source, the rows of a source being split over SALTS tasks.
    """
    if any(w <= 0 for w in (weights or {}).values()):
        raise ValueError("weights must be positive")
    tables = cut(inversions(rates(docs, source_col, weights, epochs)))
    entries = tables.agg(F.sum(F.size("cdf") + 2)).first()[0] or 0
    taken = list(docs.columns)
    for name in ("mix_source", "mix_cdf", "mix_salt", "mix_n", "copy_no", "shuffle_key"):
        taken.append(free_name(name, taken))
    source, cdf, salt, n, copy_no, shuffle_key = taken[-6:]
    tables = tables.select(F.col("source").alias(source), F.col("cdf").alias(cdf))
    same = docs[source_col].cast("string").eqNullSafe(tables[source])
    if entries <= max_broadcast:
        joined = docs.join(F.broadcast(tables), same)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        each = tables.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        joined = salted.join(each, salted[source_col].cast("string").eqNullSafe(each[source]) & (salted[salt] == each[salt])).drop(salt)
    u = uniform(seed, F.col(id_col))
    copies = joined.withColumn(n, F.size(F.filter(cdf, lambda c: c <= u))).filter(F.col(n) > 0)
    out = copies.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy_no))
    out = out.withColumn(shuffle_key, hashed(seed + 1, F.col(id_col), F.col(copy_no)))
    return out.repartition(shuffle_key).sortWithinPartitions(shuffle_key)
