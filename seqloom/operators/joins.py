"""Joins that Spark has no operator for, composed of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def range_join(
    left: DataFrame, right: DataFrame, on: list[str], at_left: str, at_right: str, low: int, high: int
) -> DataFrame:
    """Pairs with equal ``on`` and ``at_right - at_left`` from ``low`` to ``high`` (both inclusive).

    Points are cut into buckets as wide as the span, so that each left row meets the
    two or three buckets that its span can touch instead of all rows of its key.
    Clashing columns of the right side get the prefix ``r_``.
    """
    width = max(1, high - low + 1)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    probes = F.sequence(bucket(F.col(at_left) + low), bucket(F.col(at_left) + high))
    a = left.withColumn("__bucket", F.explode(probes))
    b = right.select(
        *[F.col(c).alias(c if c in on else f"r_{c}" if c in left.columns else c) for c in right.columns],
        bucket(F.col(at_right)).alias("__bucket"),
    )
    point = f"r_{at_right}" if at_right in left.columns else at_right
    return a.join(b, [*on, "__bucket"]).filter((F.col(point) - F.col(at_left)).between(low, high)).drop("__bucket")


def point_in_interval(
    points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, width: int, how: str = "left"
) -> DataFrame:
    """Points with the intervals (both ends inclusive) that hold them; ``how``: left or inner.

    Intervals are cut into buckets of ``width``, a point looks in its own bucket.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = points.withColumn("__bucket", bucket(F.col(at))).alias("p")
    i = intervals.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end))))).alias("i")
    condition = F.col(f"p.{at}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    for key in [*on, "__bucket"]:
        condition = condition & (F.col(f"p.{key}") == F.col(f"i.{key}"))
    taken = [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    return p.join(i, condition, how).select(*[F.col(f"p.{c}") for c in points.columns], *taken)


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether half-open intervals overlap."""
    return (a_start < b_end) & (b_start < a_end)


def divided(rows: DataFrame, item: str, by: str, divisor: DataFrame) -> DataFrame:
    """Relational division: items that come with every ``by`` of the divisor."""
    wanted = divisor.select(by).distinct()
    total = wanted.agg(F.count("*").alias("n")).scalar()
    return (
        rows.join(wanted, by, "left_semi")
        .groupBy(item)
        .agg(F.count_distinct(by).alias("n_found"))
        .filter(F.col("n_found") == total)
        .select(item)
    )


def converted(
    df: DataFrame, column: str, table: DataFrame, source: str, target: str, missing: Column | None = None, order: str | None = None
) -> DataFrame:
    """Replace values by a dimension's; without ``missing`` an unknown value is an error.

    Of several rows of a key the first by ``order`` counts; without an order they are an error.
    """
    best = F.min_by(target, order) if order else F.min(target)
    first = table.groupBy(F.col(source).alias("__from")).agg(best.alias("__to"), F.count_distinct(target).alias("__n"))
    kind = table.schema[target].dataType
    shown = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    twice = F.raise_error(F.concat(F.lit("more than one conversion for "), shown)).cast(kind)
    to = F.col("__to") if order else F.when(F.col("__n") > 1, twice).otherwise(F.col("__to"))
    joined = df.join(first, df[column].eqNullSafe(first["__from"]), "left")
    unknown = F.raise_error(F.concat(F.lit("no conversion for "), shown))
    fallback = unknown.cast(kind) if missing is None else missing
    return joined.select(*[F.coalesce(to, fallback).alias(c) if c == column else df[c] for c in df.columns])


def merged_sources(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join in which the first source's non-null value wins for each column."""
    out = frames[0]
    for other in frames[1:]:
        columns = [c for c in dict.fromkeys([*out.columns, *other.columns]) if c not in on]
        a, b = out.alias("a"), other.alias("b")
        joined = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on], "full")
        pick = lambda c, one=out, two=other: F.coalesce(*[F.col(f"{n}.{c}") for n, d in (("a", one), ("b", two)) if c in d.columns])
        out = joined.select(*[pick(c).alias(c) for c in [*on, *columns]])
    return out


def symmetric(similarity: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a, b, distance) with a < b: 1 minus the mean of both directions' similarities."""
    ends = similarity.filter(F.col(a) != F.col(b))
    pair = ends.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), (1 - F.col(value)).alias("d"))
    return pair.groupBy(a, b).agg(F.avg("d").alias("distance"))
