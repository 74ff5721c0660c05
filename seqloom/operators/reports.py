"""Pivots, comparisons and reports over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import numbered


def pivoted(df: DataFrame, row: list[str], column: str, values: list, cell: Column, missing=None) -> DataFrame:
    """A table with a column for each of ``values``; cells that nothing falls into hold ``missing``."""
    wide = df.groupBy(*row).pivot(column, values).agg(cell)
    if missing is None:
        return wide
    return wide.select(*row, *[F.coalesce(F.col(f"`{v}`"), F.lit(missing)).alias(str(v)) for v in values])


def named_pivot(df: DataFrame, row: str, key: str, value: str, names: DataFrame, values: list, default: str) -> DataFrame:
    """Sums by row and name: keys (names: key, name) that share a name are merged, unknown ones are ``default``."""
    named = df.join(names, key, "left").withColumn("name", F.coalesce("name", F.lit(default)))
    return pivoted(named, [row], "name", values, F.sum(value), 0)


def ratios(df: DataFrame, base: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column over the base's of the same key; a value that only one side has counts as 0 on the other.

    Null where both are missing or the base is 0.
    """
    a, b = df.alias("a"), base.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")

    def ratio(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        some = x.isNotNull() | y.isNotNull()
        return F.when(some, F.try_divide(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)))).alias(c)

    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[ratio(c) for c in columns])


def fold_changes(df: DataFrame, key: str, is_new: str, fields: list[str]) -> DataFrame:
    """(key, fields): (new - old) / old of the rows that share a key; fields with a minus sign in front are better small."""
    value = lambda c, flag: F.max(F.when(F.col(is_new) == flag, F.col(c)))
    sign = lambda c: -1 if c.startswith("-") else 1
    change = lambda c: sign(c) * F.try_divide(value(c.lstrip("-"), True) - value(c.lstrip("-"), False), value(c.lstrip("-"), False))
    pairs = df.groupBy(key).agg(*[change(c).alias(c.lstrip("-")) for c in fields], F.count_distinct(is_new).alias("__sides"))
    return pairs.filter("__sides = 2").drop("__sides")


def column_means(df: DataFrame, suffix: str) -> DataFrame:
    """(column, mean) of the columns whose names end in ``suffix``."""
    wanted = [c for c in df.columns if c.endswith(suffix)]
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in wanted])
    return means.unpivot([], [F.col(f"`{c}`") for c in wanted], "column", "mean")


def bracketed(df: DataFrame, columns: list[str], total: str) -> DataFrame:
    """A row with the sum of the given columns, missing ones counting 0."""
    return df.withColumn(total, reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns]))


def annotated(counts: DataFrame, annotation: DataFrame, key: str, order: str) -> DataFrame:
    """Every annotated row in its order with its counts, 0 where it has none (a right outer join)."""
    numbers = [c for c, t in counts.dtypes if c != key and t in ("int", "bigint", "double", "float")]
    return counts.join(annotation, key, "right").fillna(0, numbers).orderBy(order)


def checked_keys(df: DataFrame, key: str) -> DataFrame:
    """The rows, with an error as soon as a row is read whose key comes twice."""
    twice = F.raise_error(F.concat(F.lit(f"{key} comes twice: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    counted = df.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    return counted.filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(twice.cast("boolean"))).drop("__n")


def resolved(df: DataFrame, names: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their name, rows whose name is unknown); a name with two keys is an error."""
    table = checked_keys(names.select(name, key).distinct(), name)
    return df.join(table, name), df.join(table, name, "left_anti")


def list_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): only1, only2 or both; a key that a list holds twice is an error."""
    one = checked_keys(a.select(key), key).withColumn("__a", F.lit(True))
    two = checked_keys(b.select(key), key).withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "only1").when(F.col("__a").isNull(), "only2").otherwise("both")
    return one.join(two, key, "full").select(key, side.alias("side"))


def matrix_faults(matrix: DataFrame, row: str, column: str) -> DataFrame:
    """(name, as_row, as_column, wanted): names that lack a partner in a matrix that should hold all pairs of names."""
    cells = matrix.select(row, column).distinct()
    side = lambda c, out: cells.groupBy(F.col(c).alias("name")).agg(F.count("*").alias(out))
    both = side(row, "as_row").join(side(column, "as_column"), "name", "full").fillna(0)
    wanted = both.withColumn("wanted", both.agg(F.count("*").alias("n")).scalar())
    return wanted.filter("as_row < wanted OR as_column < wanted")


def by_file_name(tables: dict[str, DataFrame], path: str, pattern: str) -> DataFrame:
    """(name, one path for each table) of files whose names agree in what the pattern captures."""
    sides = [
        t.select(F.regexp_extract(path, pattern, 1).alias("name"), F.col(path).alias(label)).filter("name <> ''")
        for label, t in tables.items()
    ]
    return reduce(lambda a, b: a.join(b, "name"), sides)


def missing_files(files: DataFrame, isolate: str, kind: str, kinds: list[str]) -> DataFrame:
    """(isolate, found, missing): sorted lists of file types."""
    found = files.groupBy(isolate).agg(F.sort_array(F.collect_set(kind)).alias("found"))
    wanted = F.array(*map(F.lit, sorted(kinds)))
    return found.withColumn("missing", F.array_except(wanted, "found"))


def newest(files: DataFrame, by: list[str], time: str, name: str) -> DataFrame:
    """The newest file of each group, the least name of those equally new."""
    w = Window.partitionBy(*by).orderBy(F.desc(time), name)
    return files.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def serials(df: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """Rows numbered from 1 within their type."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def roll_call(df: DataFrame, category: str, name: str, categories: list[str]) -> DataFrame:
    """(place, category, n, at, name): a row for each name, numbered within its category, in the given order of categories.

    A category without names has one row, with n 0 and no name. Categories not asked for are left out.
    """
    spark = df.sparkSession
    order = spark.createDataFrame([(i, c) for i, c in enumerate(categories)], f"place int, {category} string")
    sizes = df.groupBy(category).agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy(category).orderBy(name)).alias("at")
    asked = order.join(sizes, category, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return asked.join(df.select(category, name, at), category, "left").select("place", category, "n", "at", name)


def files_by_rank(files: DataFrame, name: str, lineage: str, level: int) -> DataFrame:
    """(taxon, at, name): file names of each taxon at a level of ``a; b; c`` (0 is the top), numbered in their order."""
    taxon = F.coalesce(F.get(F.split(lineage, "; *"), F.lit(level)), F.lit("unknown")).alias("taxon")
    own = Window.partitionBy("taxon").orderBy(name)
    return files.select(taxon, name).select("taxon", F.row_number().over(own).alias("at"), name)


def shuffled(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Rows with their ``place`` (from 1) in a random order that only the seed and the keys decide."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return numbered(df, [order, *[F.col(k) for k in key]])


def sampled(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Each row with probability ``share``, decided by a hash of seed and key."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.filter(u < int(share * (1 << 32)))


def random_pieces(df: DataFrame, key: str, seq: str, length: int, n: int, seed: int) -> DataFrame:
    """(key, piece, start, seq): ``n`` pieces of each sequence long enough, at places hashed from seed, key and number."""
    room = F.char_length(seq) - length + 1
    each = df.filter(room > 0).select(key, seq, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("piece"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("piece").cast("string"))), 1, 8), 16, 10)
    start = (u.cast("long") % room).cast("int")
    return each.select(key, "piece", start.alias("start"), F.substr(F.col(seq), start + 1, F.lit(length)).alias("seq"))


def interleaved(lanes: dict[str, DataFrame], header: str) -> DataFrame:
    """All lanes' rows, headers prefixed with their lane."""
    named = [df.withColumn(header, F.concat(F.lit(f"{lane}_"), F.col(header))) for lane, df in lanes.items()]
    return reduce(DataFrame.unionByName, named)


def curve_bands(curves: DataFrame) -> DataFrame:
    """(place, mean, sd) of replicated curves (replicate, place, total)."""
    return curves.groupBy("place").agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"))


def reshaped(df: DataFrame, key: str, pattern: str, values: list, field: str) -> DataFrame:
    """Keys such as ``genome_cov5`` as a row (first group) by column (second group) table of one field."""
    parts = df.select(
        F.regexp_extract(key, pattern, 1).alias("row"), F.regexp_extract(key, pattern, 2).alias("column"), field
    ).filter("row <> ''")
    return pivoted(parts, ["row"], "column", values, F.first(field))


def trait_table(counts: DataFrame, genome: str, ko: str, kos: list[str]) -> tuple[DataFrame, DataFrame]:
    """(genome x ko table of counts, 0 where there is none; (genome, misses) counts of KOs outside the list)."""
    clean = counts.withColumn(ko, F.regexp_replace(ko, "^KO:", ""))
    misses = clean.filter(~F.col(ko).isin(kos)).groupBy(genome).agg(F.count("*").alias("misses"))
    return pivoted(clean, [genome], ko, kos, F.sum("n"), 0), misses


def common_samples(counts: DataFrame, sample: str, otu: str, n: str, least: int) -> DataFrame:
    """(sample, otu, n, share) of samples with ``least`` reads or more, without OTUs that are empty there."""
    totals = counts.groupBy(sample).agg(F.sum(n).alias("__total")).filter(F.col("__total") >= least)
    kept = counts.join(totals, sample).filter(F.col(n) > 0)
    return kept.withColumn("share", 100 * F.col(n) / F.col("__total")).drop("__total")


def exact_matches_only(predicted: DataFrame, copies: DataFrame, key: str, distance: str, default: int = 1) -> DataFrame:
    """(key, copies) of predictions that were made from the genome itself (distance 0)."""
    own = predicted.filter(F.col(distance) == 0).select(key)
    return own.join(copies, key, "left").withColumn("copies", F.coalesce("copies", F.lit(default)))


def chained_regions(annotation: DataFrame, features: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated genes with their regions' sequences, and what the chain lost.

    ``annotation`` (gene, term), ``features`` (gene, contig, start, end, strand; 0-based
    half-open), ``contigs`` (contig, seq). Returns (gene, term, contig, seq), genes
    without a feature, features without a contig.
    """
    from seqloom.functions.sequences import reverse_complement

    placed = annotation.join(features, "gene")
    joined = placed.join(contigs, "contig")
    part = F.substr(F.col("seq"), F.col("start") + 1, F.col("end") - F.col("start"))
    found = joined.select("gene", "term", "contig", F.when(F.col("strand") < 0, reverse_complement(part)).otherwise(part).alias("seq"))
    no_feature = annotation.join(features, "gene", "left_anti").select("gene").distinct()
    no_contig = placed.join(contigs, "contig", "left_anti").select("gene", "contig").distinct()
    return found, no_feature, no_contig
