"""Shards of nearly equal bytes by best-fit-decreasing packing (operator 7).

Rows with equal texts form an indivisible group. Groups in order of size, the
largest first, enter the shard with the tightest remaining capacity that takes them.
Capacity is the least one for which that needs no more than the wanted number of
shards (found by bisection, as in multifit), so that shards come out nearly equal.

Every group is packed so, whatever the corpus, but only a histogram (size, number of
groups) reaches the driver: groups of one size go one after the other into the same
tightest shard until it is full, so that one search places a run of them. The result
says for each size how many groups go to which shard; groups are numbered within
their size, in hashed buckets, and look their number up. Sizes are kept to DIGITS
binary digits, rounded up: exact below ``1 << DIGITS`` bytes, else at most one part
in ``1 << (DIGITS - 1)`` too large, so that a histogram has some 200,000 rows at most.

A group larger than a shard can't stay whole: it is split by a hash of ids.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

DIGITS, BUCKETS = 14, 256

#: Groups of more than this share of all rows (so fewer than its inverse) are joined by broadcast.
HOT = 1000


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, n_shards: int) -> list[list[tuple[int, int]]] | None:
    """For each (size, number of groups), its runs (shard, groups); None if they don't fit.

    ``sizes`` must be in decreasing order. Shards are opened only as needed; remaining
    capacities are kept in order and searched by bisection.
    """
    free: list[tuple[int, int]] = []  # (remaining capacity, shard)
    runs = []
    for size, n in sizes:
        own = []
        while n:
            i = bisect.bisect_left(free, (size, -1))
            if i < len(free):
                left, shard = free.pop(i)
            elif len(free) < n_shards and size <= capacity:
                left, shard = capacity, len(free)
            else:
                return None
            k = min(n, left // size)  # after one of them it is the tightest still
            bisect.insort(free, (left - k * size, shard))
            own.append((shard, k))
            n -= k
        runs.append(own)
    return runs


def pack(sizes: list[tuple[int, int]], n_shards: int) -> list[list[tuple[int, int]]]:
    """Multifit: the runs at the least capacity at which all groups fit."""
    total = sum(size * n for size, n in sizes)
    largest = sizes[0][0] if sizes else 0
    low = max(-(-total // n_shards), largest)
    high = 2 * low + largest  # always enough: no shard is left with room for the largest group
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(sizes, mid, n_shards) is not None:
            high = mid
        else:
            low = mid + 1
    return best_fit_decreasing(sizes, low, n_shards)


def rounded(size: Column) -> Column:
    """A size to DIGITS binary digits, rounded up."""
    drop = F.greatest(F.floor(F.log2(size)).cast("int") + 1 - DIGITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return (F.ceil(size / unit) * unit).cast("long")


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 16,
) -> DataFrame:
    """Shards by bytes: (id_col, size, text_crc32, shard, slot), a row per row of ``docs``.

    size is the text's UTF-8 bytes plus 1 (1 for a null text); slot numbers a shard's
    rows from 0 without gaps. Equal texts (and all null texts) share a shard, unless
    together they are larger than a shard: then rows are dealt out one by one. text_crc32 of a null text is that of the
    empty one. Rows that repeat an id are rows like others; other columns are
    ignored, so their names can't clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.when(F.col(text_col).isNotNull(), F.unhex(F.md5(text))).otherwise(F.lit(b"")).alias("text_key"),
            # rows that repeat an id and a text are spread too: each has a number, stored with it
            F.pmod(F.xxhash64(F.monotonically_increasing_id(), id_col, text), F.lit(1 << 20)).cast("int").alias("spread"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    share = max(1, -(-(total or 0) // n_shards))
    whole = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    # a group beyond a shard's share is split into parts of about a sixteenth of a share
    parts = F.ceil(16 * F.col("bytes") / F.lit(share)).cast("int")
    oversize = whole.filter(F.col("bytes") > share).select("text_key", parts.alias("parts"))  # under n_shards rows
    rows = rows.join(F.broadcast(oversize), "text_key", "left").withColumn(
        "part", F.when(F.col("parts").isNotNull(), F.pmod("spread", "parts")).otherwise(0)
    )
    groups = stored(
        rows.groupBy("text_key", "part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select("text_key", "part", "n", rounded(F.col("bytes")).alias("bytes"))
        .withColumn("bucket", F.pmod(F.xxhash64("text_key", "part"), F.lit(BUCKETS))),
        "shard-groups",
    )
    cells = stored(groups.groupBy("bytes", "bucket").agg(F.count("*").alias("cell")), "shard-cells")
    histogram = cells.groupBy("bytes").agg(F.sum("cell").alias("n")).orderBy(F.desc("bytes")).collect()
    runs = pack([(r.bytes, r.n) for r in histogram], n_shards)

    table = []  # by size: the shard of the groups up to each number
    for r, own in zip(histogram, runs):
        ends, end = [], 0
        for _, k in own:
            ends.append(end := end + k)
        table.append((r.bytes, ends, [s for s, _ in own]))
    lookup = spark.createDataFrame(table, "bytes long, ends array<long>, shards array<int>")
    before = Window.partitionBy("bytes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.withColumn("first", F.coalesce(F.sum("cell").over(before), F.lit(0)))
    own = Window.partitionBy("bytes", "bucket").orderBy("text_key", "part")
    numbered = groups.withColumn("place", F.row_number().over(own) - 1).join(first, ["bytes", "bucket"])
    placed = stored(
        numbered.join(F.broadcast(lookup), "bytes").select(
            "text_key",
            "part",
            "n",
            F.get("shards", F.size(F.filter("ends", lambda e: e <= F.col("first") + F.col("place")))).alias("shard"),
        ),
        "shard-placed",
    )
    hot = placed.filter(F.col("n") * HOT > n).select("text_key", "part", F.col("shard").alias("hot_shard"))
    rest = placed.filter(F.col("n") * HOT <= n).select("text_key", "part", "shard")
    looked = rows.join(F.broadcast(hot), ["text_key", "part"], "left")
    keep = ("id", "size", "crc", "spread")
    out = (
        looked.filter("hot_shard IS NULL").join(rest, ["text_key", "part"]).select(*keep, "shard")
        .union(looked.filter("hot_shard IS NOT NULL").select(*keep, "hot_shard"))
    )
    return slots(out).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps (columns shard, spread, id).

    Rows are numbered within (shard, bucket); buckets start where those before end.
    """
    rows = stored(rows.withColumn("bucket", F.col("spread") % 256), "shard-slots")
    counts = rows.groupBy("shard", "bucket").count()  # at most 256 rows a shard
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("spread", "id", "crc")
    return rows.join(F.broadcast(first), ["shard", "bucket"]).withColumn(
        "slot", (F.col("first") + F.row_number().over(own) - 1).cast("long")
    )
