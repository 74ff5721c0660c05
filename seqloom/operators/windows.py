"""Operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.storage import cut


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before (the first row stays)."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*by).orderBy(*order))
    marked = df.withColumn("__before", before)
    same = F.col(f"__before.{value}").eqNullSafe(F.col(value))
    return marked.filter(F.col("__before").isNull() | ~same).drop("__before")


def first_rows(df: DataFrame, by: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def islands(df: DataFrame, by: list[str], order: list[str], good: Column, min_length: int = 1) -> DataFrame:
    """(by, first, last, n): maximal runs of consecutive rows where ``good`` holds.

    first and last are positions from 0 in the group's order; a run still open at
    the end counts.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    placed = df.withColumn("__at", F.row_number().over(w) - 1).filter(good)
    runs = placed.withColumn("__run", F.col("__at") - F.row_number().over(w))
    return (
        runs.groupBy(*by, "__run")
        .agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_length)
        .drop("__run")
    )


def carried_forward(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null value up to and with each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def z_scores(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Deviations from the group's mean in population standard deviations; 0 where all are equal."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    z = F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
    return df.withColumn(out, z)


def length_quintile(df: DataFrame, by: list[str], value: str, tie: str, out: str, floor: int) -> DataFrame:
    """0 to 5: the fifth of the group that a row's rank lies in; 0 up to ``floor``."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(value, tie)) / F.count("*").over(w)
    return df.withColumn(out, F.when(F.col(value) <= floor, 0).otherwise(F.ceil(place * 5)).cast("int"))


def rarefied(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group without replacement, by a seeded MD5 of the key."""
    return first_rows(df, by, [_drawn(seed, key), key], n)


def _drawn(seed: int, *keys: str) -> Column:
    """A random order that the seed and the keys alone decide."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def curve(df: DataFrame, item: str, member: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, place, total): distinct items seen after the first ``place`` members.

    Members come in a seeded random order for each replicate. An item is new at the
    first of its members. A row meets its member's places in all orders at once, as columns, so
    that no row is repeated for each replicate.
    """
    members = df.select(member).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = Window.partitionBy("replicate").orderBy(_drawn(seed, "replicate", member), member)
    ranked = members.withColumn("place", F.row_number().over(order))
    names = [f"__{r}" for r in range(replicates)]
    places = ranked.groupBy(member).agg(*[F.max(F.when(F.col("replicate") == r, F.col("place"))).alias(c) for r, c in enumerate(names)])
    first = df.select(item, member).join(places, member).groupBy(item).agg(*[F.min(c).alias(c) for c in names])
    new = first.select(F.posexplode(F.array(*names)).alias("replicate", "place"))
    counts = new.groupBy("replicate", "place").agg(F.count("*").alias("new"))
    every = ranked.select("replicate", "place").join(counts, ["replicate", "place"], "left")
    run = Window.partitionBy("replicate").orderBy("place")
    return every.select("replicate", "place", F.sum(F.coalesce("new", F.lit(0))).over(run).alias("total"))


def core_curve(df: DataFrame, item: str, member: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, place, total): items that each of the first ``place`` members has."""
    pairs = df.select(item, member).distinct().withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    )
    members = pairs.select("replicate", member).distinct()
    order = Window.partitionBy("replicate").orderBy(_drawn(seed, "replicate", member), member)
    ranked = members.withColumn("place", F.row_number().over(order))
    held = pairs.join(ranked, ["replicate", member])
    # an item holds up to the place before the first gap in the places of its members
    own = Window.partitionBy("replicate", item).orderBy("place")
    prefix = held.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") == F.col("place"))
    return (
        ranked.select("replicate", "place")
        .join(prefix.groupBy("replicate", "place").agg(F.count("*").alias("total")), ["replicate", "place"], "left")
        .select("replicate", "place", F.coalesce("total", F.lit(0)).alias("total"))
    )


def numbered(df: DataFrame, order: list[Column], total: str | None = None) -> DataFrame:
    """Rows with ``place`` (from 1) in a total order, and ``total``, the running sum of that column, if named.

    Rows are dealt into ranges of the order; each is numbered for itself and moved on by what
    the ranges before it hold, so that no task gets more than a range.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    amount = F.col(total) if total else F.lit(0)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.sum(amount).alias("__s"))
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__range").orderBy(*order)
    joined = ranged.join(F.broadcast(sizes), "__range")  # a row for each range
    placed = joined.withColumn("place", (F.row_number().over(own) + F.col("__n")).cast("long"))
    if total:
        run = F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("total", (run + F.col("__s")).cast("long"))
    return placed.drop("__range", "__n", "__s")
