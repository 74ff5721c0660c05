"""Operators on aligned reads, their pairs, contigs and taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import first_rows

#: Flags of SAM (fixed values): first and second read of a pair; an unmapped pair's first read.
FIRST, SECOND, UNMAPPED = 64, 128, 77


def passing_reads(
    sam: DataFrame, flags: tuple[int, ...] = (83, 99), min_length: int = 145, max_mismatches: int = 0, min_mapq: int = 30
) -> DataFrame:
    """Alignments with one of the flags, long enough, with few mismatches (tag NM) and well placed.

    A read without the tag, or without any of the values, is left out.
    """
    nm = F.try_element_at("attributes", F.lit("NM"))
    mismatches = F.regexp_replace(nm, "^i:", "").try_cast("int")
    return sam.filter(
        F.col("flag").isin(*flags)
        & (F.char_length("seq") >= min_length)
        & (mismatches <= max_mismatches)
        & (F.col("mapq") >= min_mapq)
    )


def flag_counts(sam: DataFrame) -> DataFrame:
    """(flag, n, unmapped): reads of each flag."""
    return sam.groupBy("flag").agg(F.count("*").alias("n")).withColumn("unmapped", F.col("flag") == UNMAPPED)


def read_pairs(sam: DataFrame, order: str) -> DataFrame:
    """(qname, first, second): each pair's first record (by ``order``) of either mate; null where a mate is missing."""
    mate = F.when(F.col("flag").bitwiseAND(FIRST) > 0, "first").when(F.col("flag").bitwiseAND(SECOND) > 0, "second")
    record = lambda m: F.min_by(F.struct("seq", "qual"), F.when(F.col("mate") == m, F.col(order))).alias(m)
    held = lambda m: F.when(F.count_if(F.col("mate") == m) > 0, record(m)).alias(m)
    return sam.withColumn("mate", mate).groupBy("qname").agg(held("first"), held("second"))


def pairs_by_bin(sam: DataFrame, bins: DataFrame, order: str) -> DataFrame:
    """(bin, qname, first, second): whole pairs of which either mate has an alignment to a contig of the bin.

    ``bins``: (contig, bin), a contig may lie in many. Each pair comes once in a bin.
    """
    hit = sam.join(bins, sam["rname"] == bins["contig"]).select("bin", "qname").distinct()
    return hit.join(read_pairs(sam, order), "qname").select("bin", "qname", "first", "second")


def first_class(classes: DataFrame, read: str, taxid: str, classified: str, order: str) -> DataFrame:
    """(read, taxid): a read's first classification, unclassified ones only if there is no other."""
    return first_rows(classes, [read], [F.desc(classified), order]).select(read, taxid)


def contig_taxa(alignments: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((contig, taxid, n) of reads (read, contig) with a class (read, taxid); reads without one)."""
    placed = alignments.select("read", "contig").distinct()
    named = classes.dropDuplicates(["read"])
    counts = placed.join(named, "read").groupBy("contig", "taxid").agg(F.count("*").alias("n"))
    return counts, placed.join(named, "read", "left_anti").select("read").distinct()


def last_listed(ids: Column) -> Column:
    """The last of a list such as ``562;561``."""
    return F.element_at(F.split(ids, ";"), -1)


def taxid_totals(hits: DataFrame, ids: str, length: str) -> DataFrame:
    """(taxid, n, total): hits and summed lengths by the last taxid of each list."""
    return hits.groupBy(last_listed(F.col(ids)).alias("taxid")).agg(F.count("*").alias("n"), F.sum(length).alias("total"))


def class_lengths(records: DataFrame, taxid: str, classified: str, length: str) -> DataFrame:
    """(taxid, n, mean_length) with ``unclassified`` as one taxon."""
    name = F.when(F.col(classified), F.col(taxid).cast("string")).otherwise("unclassified")
    return records.groupBy(name.alias("taxid")).agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"))


def isolate_totals(hits: DataFrame, by: str, isolate: str, length: str, passing: Column) -> DataFrame:
    """(by, isolate, n, total, major): passing hits of each isolate.

    ``major`` is whether they make up more than half of the length of all hits of
    ``by``, those that fail included.
    """
    every = hits.groupBy(by).agg(F.sum(length).alias("every"))
    found = hits.filter(passing).groupBy(by, isolate).agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    return found.join(every, by).select(by, isolate, "n", "total", (F.col("total") > F.col("every") / 2).alias("major"))


def gene_rows(
    rows: DataFrame, gene: str, product: str, genome: str, include: list | None = None, exclude: list | None = None, drop_trna: bool = False
) -> DataFrame:
    """Rows that lie in a gene, of the genomes asked for."""
    kept = rows.filter(F.col(gene) != "Nongene")
    if drop_trna:
        kept = kept.filter(~F.coalesce(F.col(product).contains("tRNA"), F.lit(False)))
    if include is not None:
        kept = kept.filter(F.col(genome).isin(include))
    return kept.filter(~F.col(genome).isin(exclude)) if exclude else kept


def coverage_class(total: Column, samples: list[Column], min_coverage: float, min_share: float) -> Column:
    """Whether a contig could have been assembled, and from how many samples.

    Enough coverage in all: asm_in_multiple, asm_in_single or asm_by_group by the samples
    that have enough alone; else no_asm_single if one sample gives ``min_share`` of it,
    or no_asm_multi.
    """
    each = F.array(*samples)
    enough = F.size(F.filter(each, lambda x: x >= min_coverage))
    one = F.exists(each, lambda x: F.try_divide(x, total) >= min_share)
    alone = F.when(enough > 1, "asm_in_multiple").when(enough == 1, "asm_in_single").otherwise("asm_by_group")
    return F.when(total >= min_coverage, alone).when(one, "no_asm_single").otherwise("no_asm_multi")


def replicon(found: Column, identity: Column, coverage: Column, min_identity: float = 90, min_coverage: float = 95) -> Column:
    """Chromosome for a hit that is alike and long enough, else Plasmid; also without a hit."""
    good = found & (identity >= min_identity) & (coverage >= min_coverage)
    return F.when(F.coalesce(good, F.lit(False)), "Chromosome").otherwise("Plasmid")


def barcode(reads: DataFrame, pattern: str, frameshifts: tuple[int, int] = (1, 4), kept: int = 2, trim_to: int = 0) -> DataFrame:
    """Reads with ``barcode`` and ``trimmed``, both null where the pattern doesn't match.

    The barcode joins what the pattern's groups capture: a frameshift group of at most
    two letters reads ``1,2,3``, a longer one ``4,5,6``; the group ``kept`` stands between
    them as it is. ``trim_to`` is the group that is left of the sequence, 0 for all of it.
    """
    group = lambda i: F.regexp_extract("seq", pattern, i)
    shift = lambda i: F.when(F.char_length(group(i)) <= 2, "1,2,3").otherwise("4,5,6")
    first, second = frameshifts
    matches = F.col("seq").rlike(pattern)
    code = F.concat_ws("-", shift(first), group(kept), shift(second))
    return reads.withColumn("barcode", F.when(matches, code)).withColumn(
        "trimmed", F.when(matches, group(trim_to) if trim_to else F.col("seq"))
    )


def routed(barcoded: DataFrame, samples: DataFrame) -> DataFrame:
    """Reads with ``sample``: that of their barcode (samples: barcode, sample), partially_undetermined if
    no sample has it, undetermined without one."""
    known = samples.dropDuplicates(["barcode"])
    return barcoded.join(known, "barcode", "left").withColumn(
        "sample",
        F.when(F.col("barcode").isNull(), "undetermined").otherwise(F.coalesce("sample", F.lit("partially_undetermined"))),
    )


def hit_counts(names: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """(name, n): hits of every known name, 0 without any."""
    counts = hits.groupBy(name).agg(F.count("*").alias("n"))
    return names.select(name).distinct().join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def term_counts(rows: DataFrame, terms: str) -> DataFrame:
    """(term, n): how many rows carry each term of a ``|`` list."""
    each = rows.select(F.explode(F.array_distinct(F.split(terms, r"\|"))).alias("term")).filter("term <> ''")
    return each.groupBy("term").agg(F.count("*").alias("n"))


def subjects_of(hits: DataFrame, source: str = "Pfam") -> DataFrame:
    """(subject, query), each once, of hits (query, source, subject) of one source."""
    return hits.filter((F.col("source") == source) & F.col("subject").isNotNull()).select("subject", "query").distinct()


def annotation_coverage(coverage: DataFrame, contig: str, depth: str, annotation: DataFrame) -> DataFrame:
    """(annotation, total): coverage summed by annotation (contig, annotation), cut to whole numbers."""
    joined = coverage.join(annotation, contig)
    return joined.groupBy("annotation").agg(F.sum(depth).cast("long").alias("total"))


def features_of(records: DataFrame) -> DataFrame:
    """(locus, organism, type, start, end, strand, locus_tag, product) of annotated records; a qualifier's first value counts."""
    each = records.select("locus", "organism", F.explode("features").alias("f"))
    tag = lambda name: F.get(F.try_element_at("f.qualifiers", F.lit(name)), 0).alias(name)
    return each.select("locus", "organism", "f.type", "f.start", "f.end", "f.strand", tag("locus_tag"), tag("product"))


def chosen_features(features: DataFrame, kinds: list[str] | None = None, loci: list[str] | None = None, product: str | None = None) -> DataFrame:
    """Features of the given types, with one of the locus tags, whose product holds a text."""
    if kinds is not None:
        features = features.filter(F.col("type").isin(kinds))
    if loci is not None:
        features = features.filter(F.col("locus_tag").isin(loci))
    return features if product is None else features.filter(F.col("product").contains(product))
