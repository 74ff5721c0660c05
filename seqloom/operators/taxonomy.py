"""Lookups and rollups over taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.functions import text as X
from seqloom.storage import cut


def found_taxa(names: DataFrame, taxa: DataFrame, name: str = "name", rank: str | None = None) -> DataFrame:
    """Rows of ``names`` with the taxid of their name, whatever its case; null if unknown.

    ``taxa``: (taxid, name, rank). A name that several taxa bear is an error.
    """
    table = taxa if rank is None else taxa.filter(F.col("rank") == rank)
    by_name = table.groupBy(F.lower("name").alias("__name")).agg(F.count_distinct("taxid").alias("__n"), F.min("taxid").alias("taxid"))
    joined = names.join(by_name, F.lower(names[name]) == by_name["__name"], "left")
    wrong = F.raise_error(F.concat(F.lit("more than one taxon is called "), F.col(name)))
    taxid = F.when(F.col("__n") > 1, wrong.cast(taxa.schema["taxid"].dataType)).otherwise(F.col("taxid"))
    return joined.select(*[names[c] for c in names.columns], taxid.alias("taxid"))


def found_lineages(strings: DataFrame, taxa: DataFrame, text: str) -> DataFrame:
    """Rows of ``strings`` with the taxid and rank of their lineage (``k__A; p__B``), at its deepest known rank.

    ``taxa``: (taxid, lineage), lineage being a taxonomy string of the same kind. Null if
    no part is known; a lineage that several taxa have is an error.

    Strings are parsed once each: the distinct ones are computed first, or Spark would test
    each row's string before it takes them together.
    """
    prefixes = lambda ranks: X.let(ranks, lambda m: F.transform(
        F.array(*map(F.lit, X.TAGS)), lambda r: F.struct(r.alias("r"), F.try_element_at(m, r).alias("v"))
    ))
    tagged = lambda df, c: df.withColumn("__parts", F.filter(prefixes(X.tax_map(F.col(c))), lambda e: e["v"].isNotNull()))
    whole = F.array_join(F.transform("__parts", lambda e: F.concat(e["r"], F.lit("__"), e["v"])), "; ")
    known = tagged(taxa, "lineage").select(whole.alias("__key"), "taxid")
    known = known.groupBy("__key").agg(F.count_distinct("taxid").alias("__n"), F.min("taxid").alias("taxid"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("__parts")),
        lambda n: F.struct(
            n.alias("depth"),
            F.array_join(F.transform(F.slice("__parts", F.lit(1), n), lambda e: F.concat(e["r"], F.lit("__"), e["v"])), "; ").alias("key"),
        ),
    )
    wanted = tagged(cut(strings.select(text).distinct()), text).filter(F.size("__parts") > 0).select(text, F.explode(cuts).alias("c"))
    met = wanted.join(known, wanted["c"]["key"] == known["__key"])
    best = met.groupBy(text).agg(F.max_by(F.struct("__n", "taxid", F.col("c.key").alias("key")), "c.depth").alias("b"))
    wrong = F.raise_error(F.concat(F.lit("more than one taxon has the lineage "), F.col("b.key")))
    taxid = F.when(F.col("b.__n") > 1, wrong.cast(taxa.schema["taxid"].dataType)).otherwise(F.col("b.taxid"))
    rank = F.regexp_extract("b.key", r"([kpcofgs])__[^;]*$", 1)
    return strings.join(best.select(text, taxid.alias("taxid"), rank.alias("rank")), text, "left")


def rolled_up(df: DataFrame, by: list[str], taxstring: str, letter: str, value: str) -> DataFrame:
    """(by, taxon, value): sums of all taxonomy strings that read the same down to a rank."""
    taxon = X.cut_at_rank(X.tax_map(F.col(taxstring)), letter)
    return df.groupBy(*by, taxon.alias("taxon")).agg(F.sum(value).alias(value))


def tree_counts(df: DataFrame, levels: list[str], weight: str) -> DataFrame:
    """(path, depth, n, children, only): weights of every prefix of the levels.

    ``only`` marks a node that is its parent's only child with all of its weight; a
    collapsed listing leaves the parents of such nodes out.
    """
    filled = F.filter(F.array(*[F.col(c) for c in levels]), lambda x: x.isNotNull())
    rows = df.select(filled.alias("p"), F.col(weight).alias("w")).groupBy("p").agg(F.sum("w").alias("w")).filter(F.size("p") > 0)
    nodes = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", F.lit(1), n))).alias("p"), "w")
    nodes = nodes.groupBy("p").agg(F.sum("w").alias("n"))
    up = F.slice("p", F.lit(1), F.size("p") - 1)
    per = nodes.filter(F.size("p") > 1).groupBy(up.alias("__up")).agg(F.count("*").alias("children"), F.max("n").alias("__most"))
    below = nodes.join(per, nodes["p"] == per["__up"], "left").select("p", "n", F.coalesce("children", F.lit(0)).alias("children"))
    parents = below.select(F.col("p").alias("__up"), F.col("children").alias("__c"), F.col("n").alias("__n"))
    joined = below.join(parents, F.slice(below["p"], F.lit(1), F.size(below["p"]) - 1) == parents["__up"], "left")
    return joined.select(
        F.array_join("p", "; ").alias("path"),
        F.size("p").alias("depth"),
        "n",
        "children",
        F.coalesce((F.col("__c") == 1) & (F.col("__n") == F.col("n")), F.lit(False)).alias("only"),
    )


def of_kingdom(df: DataFrame, taxstring: str, kingdom: str) -> DataFrame:
    """Rows whose taxonomy string names this kingdom."""
    return df.filter(X.tax_at(X.tax_map(F.col(taxstring)), "k") == kingdom)


def significant(df: DataFrame, by: str, q: str, lineage: str, most: float = 0.05) -> DataFrame:
    """(by, lineage), each once: lineages with a q-value below the limit."""
    return df.filter(F.col(q) < most).select(by, F.col(lineage).alias("lineage")).distinct()


def divergence(a: DataFrame, b: DataFrame, key: str, taxstring: str) -> DataFrame:
    """(rank, n): at which rank two assignments of the same key part; null where they agree to the end."""
    joined = a.select(key, X.tax_map(F.col(taxstring)).alias("x")).join(b.select(key, X.tax_map(F.col(taxstring)).alias("y")), key)
    return joined.groupBy(X.lineage_divides_at(F.col("x"), F.col("y")).alias("rank")).agg(F.count("*").alias("n"))


def confidence_table(reads: DataFrame, confidence: DataFrame, lineage: DataFrame) -> DataFrame:
    """(name, lineage, confidence) with confidence as ``a/b``: ``unclassified`` and ``0/0`` where nothing is known.

    ``reads``: (name, taxid); ``confidence``: (name, in_clade, total); ``lineage``: (taxid, lineage).
    """
    joined = reads.join(lineage, "taxid", "left").join(confidence, "name", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return joined.select(
        "name",
        F.coalesce("lineage", F.lit("unclassified")).alias("lineage"),
        F.when(F.col("lineage").isNull(), "0/0").otherwise(F.concat(number("in_clade"), F.lit("/"), number("total"))).alias("confidence"),
    )
