"""Operators on hits, classifications, bins and alignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.functions.sequences import kmers
from seqloom.storage import cut, stored

#: Comparators by their signs (fixed values).
COMPARATORS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def thresholds(df: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """Rows that meet every (column, comparator, value)."""
    for column, sign, value in limits:
        df = df.filter(COMPARATORS[sign](F.col(column), F.lit(value)))
    return df


def projected(df: DataFrame, places: list[int]) -> DataFrame:
    """Columns by 0-based place, in the order asked for."""
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in places])


def bin_class(complete: Column, contam: Column) -> Column:
    """quality, contaminated, sibling, incomplete or junk.

    Bins under 30 complete are junk, those of 80 or more are full. A full bin is of
    quality up to a contamination of 15 percent of its completeness, a sibling's mix
    from 75 percent on, and contaminated between; others are incomplete or junk.
    """
    ratio = F.try_divide(contam, complete)
    full = F.when(ratio <= 0.15, "quality").when(ratio >= 0.75, "sibling").otherwise("contaminated")
    return F.when((complete < 30) | ratio.isNull(), "junk").when(complete >= 80, full).otherwise(
        F.when(ratio <= 0.15, "incomplete").otherwise("junk")
    )


def plasmid_by_votes(votes: list[tuple[Column, int]], least: int = 13) -> Column:
    """Plasmid if the points of the tests that hold reach ``least``, else Chromosome; a null test doesn't hold."""
    points = [F.when(test, n).otherwise(0) for test, n in votes]
    return F.when(reduce(lambda a, b: a + b, points) >= least, "Plasmid").otherwise("Chromosome")


def filtered_hits(hits: DataFrame, min_length: float, min_bits: float, max_evalue: float, min_identity: float) -> DataFrame:
    """Hits (start, end, subject_length, bitscore, evalue, identity) that pass all limits.

    A ``min_length`` below 1 is a fraction of the subject's length, else base pairs.
    """
    length = F.col("end") - F.col("start")
    least = F.col("subject_length") * min_length if min_length < 1 else F.lit(min_length)
    return hits.filter(
        (length >= least)
        & (F.col("bitscore") >= min_bits)
        & (F.col("evalue") <= max_evalue)
        & (F.col("identity") >= min_identity)
    )


def best_hits(hits: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """The first hit of each query in the given order."""
    w = Window.partitionBy(query).orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def clade_confidence(reads: DataFrame, lineage: DataFrame) -> DataFrame:
    """(name, in_clade, total, confidence) of reads (name, taxid, hits): the share of a read's
    k-mers whose taxon lies at or below the assigned one; ambiguous ones (A) don't count."""
    each = reads.select("name", "taxid", F.explode_outer("hits").alias("h"))  # a read without hits has its row too
    below = lineage.select(F.col("node").alias("__hit"), F.col("ancestor").alias("__clade"))
    joined = each.join(
        below, (each["h"]["taxid"] == below["__hit"]) & (each["taxid"] == below["__clade"]), "left"
    )
    n = F.when(F.col("h.taxid") != "A", F.col("h.n"))
    sums = joined.groupBy("name").agg(
        F.sum(F.when(F.col("__hit").isNotNull(), n).otherwise(0)).alias("in_clade"), F.sum(n).alias("total")
    )
    return sums.select(
        "name",
        F.coalesce("in_clade", F.lit(0)).alias("in_clade"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.try_divide(F.col("in_clade").cast("double"), F.col("total").cast("double")).alias("confidence"),
    )


def most_frequent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): each group's commonest value, the least of equals."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def small_groups_to_parents(df: DataFrame, levels: list[str], weight: str, least: float) -> DataFrame:
    """(path, weight): sums by path, those under ``least`` handed to their parent, deepest first.

    A root keeps its sum whatever its size.
    """
    filled = F.filter(F.array(*[F.col(c) for c in levels]), lambda x: x.isNotNull())
    sums = df.select(filled.alias("path"), F.col(weight).alias("w")).groupBy("path").agg(F.sum("w").alias("w"))
    for depth in range(len(levels), 1, -1):
        small = (F.size("path") == depth) & (F.col("w") < least)
        sums = sums.select(F.when(small, F.slice("path", 1, depth - 1)).otherwise(F.col("path")).alias("path"), "w")
        sums = sums.groupBy("path").agg(F.sum("w").alias("w"))
    return sums.select(F.array_join("path", "; ").alias("path"), F.col("w").alias(weight))


def first_mismatch(df: DataFrame, text: str, prefixes: list[str]) -> DataFrame:
    """(place, n): how many texts stop matching at each of ever longer patterns; null if all match."""
    place = F.lit(None).cast("int")
    for i in reversed(range(len(prefixes))):
        place = F.when(~F.col(text).rlike(prefixes[i]), i).otherwise(place)
    return df.groupBy(place.alias("place")).agg(F.count("*").alias("n"))


def pieces(df: DataFrame, key: str, seq: str, length: int) -> DataFrame:
    """(key, piece, start, seq): whole pieces of about ``length``, what is left over spread over them."""
    n = F.floor(F.char_length(seq) / F.lit(length)).cast("int")
    total = F.char_length(seq)
    each = df.select(key, seq, n.alias("__n"), total.alias("__t")).filter("__n > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("piece")
    )
    at = lambda i: F.floor(i * F.col("__t") / F.col("__n")).cast("int")
    start, stop = at(F.col("piece")), at(F.col("piece") + 1)
    return each.select(key, "piece", start.alias("start"), F.substr(F.col(seq), start + 1, stop - start).alias("seq"))


def contained_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y): names x of ``a`` that contain the name y of ``b``, or lie within it, however short.

    Names of a length are looked up among the longer names' pieces of that length, by an equi-join;
    only lengths that occur are cut out. Empty names are left out.
    """

    def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
        lengths = inner.agg(F.sort_array(F.collect_set(F.char_length("name"))).alias("l")).scalar()  # up to the longest name's
        name = F.col("name")
        fitting = outer.select(name.alias("outer"), F.explode(lengths).alias("n")).filter("n <= char_length(outer)")
        starts = F.sequence(F.lit(1), F.char_length("outer") - F.col("n") + 1)
        pieces = fitting.select("outer", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("outer", i, F.col("n"))))).alias("inner"))
        return pieces.join(inner.select(name.alias("inner")), "inner")

    a, b = (df.select("name").filter("name <> ''").distinct() for df in (a, b))
    held = within(a, b).select(F.col("outer").alias("x"), F.col("inner").alias("y"))
    return held.union(within(b, a).select(F.col("inner").alias("x"), F.col("outer").alias("y"))).distinct()


def similar_names(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(name, match): each name of ``a`` with the name of ``b`` that it is most like.

    First a name that it contains whole, or that contains it: the one that has most letters in common
    with it (ties: the least). Names without one get the name of ``b`` that shares most of
    their k-mers (ties: the least); those that share none are left out.
    """
    common = F.least(F.char_length("x"), F.char_length("y"))
    best = F.min_by("y", F.struct((-common).alias("n"), F.col("y").alias("y")))
    whole = cut(contained_names(a, b).groupBy(F.col("x").alias("name")).agg(best.alias("match")))
    grams = lambda df, c: df.select(F.col("name").alias(c)).distinct().withColumn("g", F.explode(F.array_distinct(kmers(F.col(c), k))))
    rest = a.select("name").distinct().join(whole, "name", "left_anti")
    shared = grams(rest, "x").join(grams(b, "y"), "g").groupBy("x", "y").agg(F.count("*").alias("n"))
    most = F.min_by("y", F.struct((-F.col("n")).alias("n"), F.col("y").alias("y")))
    return whole.unionByName(shared.groupBy(F.col("x").alias("name")).agg(most.alias("match")))


def repeated_k_means(df: DataFrame, key: str, columns: list[str], k: int = 2, runs: int = 10, rounds: int = 10, seed: int = 1) -> DataFrame:
    """(key, clusters): the cluster of each row in each of ``runs`` runs of k-means, an array of 0 to k - 1.

    Columns are divided by their standard deviation (population). A run starts at the k rows of
    least MD5 of seed, run and key. All runs go through a round together: one pass over the rows
    compares each with the centres of every run, and only centres (runs * k) pass the
    driver. In every run clusters are numbered in order of their last centres, so that
    numbers of different runs can be averaged. Rows with a null are left out; an empty
    cluster keeps its centre. Fewer than k rows are an error.
    """
    rows = cut(df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna())
    names = [f"v{i}" for i in range(len(columns))]
    spread = rows.agg(*[F.stddev_pop(c) for c in names]).first()
    scaled = rows.select("key", F.array(*[F.col(c) / F.lit(s or 1.0) for c, s in zip(names, spread)]).alias("v"))
    centres = []
    for run in range(runs):
        drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(run)), F.col("key").cast("string")))
        centres.append([list(r.v) for r in scaled.orderBy(drawn, "key").limit(k).collect()])
    if len(centres[0]) < k:
        raise ValueError(f"fewer than {k} rows")

    def clusters(now: list) -> Column:
        far = lambda c: sum((F.get("v", F.lit(i)) - F.lit(x)) ** 2 for i, x in enumerate(c))
        nearest = lambda run: F.least(*[F.struct(far(c).alias("d"), F.lit(j).alias("c")) for j, c in enumerate(run)])["c"]
        return F.array(*[nearest(run) for run in now])

    for _ in range(rounds):
        each = scaled.select("v", F.posexplode(clusters(centres)).alias("run", "cluster"))
        means = each.groupBy("run", "cluster").agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(len(columns))])
        new = {(r.run, r.cluster): [r[f"m{i}"] for i in range(len(columns))] for r in means.collect()}  # runs * k rows at most
        moved = [[new.get((r, j), c) for j, c in enumerate(run)] for r, run in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return scaled.select(F.col("key").alias(key), clusters([sorted(run) for run in centres]).alias("clusters"))


def two_means(df: DataFrame, columns: list[str], seed: int = 1, k: int = 2) -> DataFrame:
    """Rows with ``cluster`` by one run of k-means on scaled columns; null for rows with a null."""
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "k-means-rows")
    found = repeated_k_means(rows, "__row", columns, k, runs=1, rounds=20, seed=seed)
    return rows.join(found, "__row", "left").withColumn("cluster", F.get("clusters", 0)).drop("__row", "clusters")


def mean_cluster(assigned: DataFrame, key: str) -> DataFrame:
    """(key, mean): the mean number of a row's cluster over all runs."""
    total = F.aggregate("clusters", F.lit(0), lambda s, c: s + c)
    return assigned.select(key, (total / F.size("clusters")).alias("mean"))


def co_assigned(assigned: DataFrame, pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pairs of keys with ``share``, that of the runs in which both are in one cluster."""
    of = lambda side, out: assigned.select(F.col(key).alias(side), F.col("clusters").alias(out))
    joined = pairs.join(of(a, "__x"), a).join(of(b, "__y"), b)
    same = F.filter(F.zip_with("__x", "__y", lambda x, y: x == y), lambda s: s)
    return joined.select(*pairs.columns, (F.size(same) / F.size("__x")).alias("share"))


def aligned_columns(df: DataFrame, by: str, seq: str, max_gaps: float, gaps: tuple[str, ...] = ("-", "N")) -> DataFrame:
    """Alignment rows without the columns in which ``max_gaps`` or more of the rows that reach them have a gap.

    Rows stay whole in their tasks; what each column's rows have is summed, and the
    verdicts (a boolean a column) go to all tasks.
    """
    cells = df.select(F.posexplode(F.split(seq, "")).alias("at", "nt"))
    good = cells.groupBy("at").agg((F.avg(F.col("nt").isin(*gaps).cast("int")) < max_gaps).alias("good"))
    flags = good.agg(F.sort_array(F.collect_list(F.struct("at", "good"))).alias("f")).select(F.col("f.good").alias("good"))
    kept = F.filter(F.split(seq, ""), lambda _, i: F.get("__flags", i))
    return df.withColumn("__flags", flags.scalar()).select(by, F.array_join(kept, "").alias(seq))


def gappy_rows(df: DataFrame, seq: str, max_gaps: float, gaps: str = "-N") -> DataFrame:
    """Alignment rows of which less than ``max_gaps`` are gaps; empty rows are left out."""
    n = F.char_length(seq)
    return df.filter((n > 0) & ((n - F.char_length(F.translate(seq, gaps, ""))) < max_gaps * n))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how often two assignments agree, differ, or only one of them has a value."""
    joined = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return joined.agg(
        F.count_if(both & (F.col("x") == F.col("y"))).alias("same"),
        F.count_if(both & (F.col("x") != F.col("y"))).alias("different"),
        F.count_if(F.col("y").isNull() & F.col("x").isNotNull()).alias("first_only"),
        F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("second_only"),
    )


def valid_amplicons(df: DataFrame, amplicon: str, genome: str, seq: str, genomes: DataFrame) -> DataFrame:
    """(amplicon, n_unique, n_duplicated, n_ambiguous) of those found once in every genome."""
    total = genomes.select(genome).distinct().agg(F.count("*").alias("n")).scalar()
    per = df.groupBy(amplicon).agg(
        F.count("*").alias("n"), F.count_distinct(genome).alias("g"),
        F.sum(F.char_length(F.regexp_replace(seq, "[^N]", ""))).alias("n_ambiguous"),
    )
    valid = per.filter((F.col("n") == F.col("g")) & (F.col("g") == total))
    same = df.groupBy(amplicon, seq).agg(F.count("*").alias("k"))
    unique = same.groupBy(amplicon).agg(F.count_if(F.col("k") == 1).alias("n_unique"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("n_duplicated"))
    return valid.join(unique, amplicon).select(amplicon, "n_unique", "n_duplicated", "n_ambiguous")
