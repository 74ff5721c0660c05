"""Scalar functions on sequences, k-mers and alignments, as Column expressions."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import let


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def pieces_for_kmers(seq: Column, k: int, length: int = 512) -> Column:
    """Pieces of about ``length`` letters that overlap by k - 1, so that each k-mer lies in one.

    A sequence is cut once; letters within a piece are then near its start, so that the
    work grows with the sequence and not with its square.
    """
    cut = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{max(length, 4 * k)}}}"), F.lit(0))
    lap = lambda i: F.coalesce(F.substring(F.get(cut, i + 1), 1, k - 1), F.lit(""))
    return F.transform(cut, lambda p, i: F.concat(p, lap(i)))


def kmers_of_piece(piece: Column, k: int) -> Column:
    last = F.char_length(piece) - k + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(piece, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>")
    )


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; an empty array for shorter sequences."""
    return F.flatten(F.transform(pieces_for_kmers(seq, k), lambda p: kmers_of_piece(p, k)))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def strand(kmer: Column) -> Column:
    return F.when(kmer <= reverse_complement(kmer), 1).otherwise(-1)


def kmer_id(kmer: Column, alphabet: str = "ACGT") -> Column:
    """The number a k-mer spells in the alphabet's base (up to 31 letters of base 4)."""
    digits = "0123456789"[: len(alphabet)]
    return F.conv(F.translate(kmer, alphabet, digits), len(alphabet), 10).cast("long")


def kmer_of(number: Column, k: int, alphabet: str = "ACGT") -> Column:
    digits = "0123456789"[: len(alphabet)]
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, len(alphabet)), k, "0"), digits, alphabet)


def fuzzy_kmers(kmer: Column, k: int, stable: int, n: int = 1) -> Column:
    """Copies with exactly ``n`` Ns outside the ``stable`` letters at either end."""
    chosen = list(combinations(range(stable + 1, k - stable + 1), n))
    places = F.from_json(F.lit(json.dumps(chosen)), "array<array<int>>")
    return F.transform(places, lambda p: F.aggregate(p, kmer, lambda s, i: F.overlay(s, F.lit("N"), i, F.lit(1))))


def mismatch_kmers(kmer: Column, k: int, alphabet: str = "ACGT") -> Column:
    """The k-mer and all that differ from it in one letter, each once."""
    letters = F.array(*map(F.lit, alphabet))
    each = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda i: F.transform(letters, lambda x: F.overlay(kmer, x, i, F.lit(1))),
    )
    return F.array_distinct(F.flatten(each))


def all_kmers(spark: SparkSession, k: int, alphabet: str = "ACGT") -> DataFrame:
    """(kmer): every k-mer of the alphabet."""
    return spark.range(len(alphabet) ** k).select(kmer_of(F.col("id"), k, alphabet).alias("kmer"))


def gc_content(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.try_divide(
        F.char_length(F.regexp_replace(seq, "[^GgCc]", "")).cast("double"), F.char_length(seq).cast("double")
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length."""
    return F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x
    )


def gapped_distance(a: Column, b: Column, max_gap: int = 3) -> Column:
    """Differing share of two aligned rows; runs of more than ``max_gap`` gaps are left out.

    A gap is a place where either row has one; where both have, they are alike. Null if nothing is left.
    """
    place = lambda x, y: (
        F.when((x == "-") & (y == "-"), "b").when((x == "-") | (y == "-"), "g").when(x == y, "m").otherwise("x")
    )
    places = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), place), "")
    left = F.regexp_replace(places, f"[bg]{{{max_gap + 1},}}", "")
    differing = F.char_length(F.regexp_replace(left, "[bm]", ""))
    return F.try_divide(differing.cast("double"), F.char_length(left).cast("double"))


def cigar_ops(cigar: Column) -> Column:
    """Operations as array<struct<n int, op string>>."""
    found = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(
        found,
        lambda o: F.struct(
            F.substr(o, F.lit(1), F.char_length(o) - 1).cast("int").alias("n"), F.substring(o, -1, 1).alias("op")
        ),
    )


def cigar_count(cigar: Column, ops: str) -> Column:
    """Summed lengths of the operations named in ``ops``."""
    return _summed(cigar_ops(cigar), ops)


def _summed(found: Column, ops: str) -> Column:
    return F.aggregate(found, F.lit(0), lambda s, o: F.when(o["op"].isin(*ops), s + o["n"]).otherwise(s))


def alignment_stats(cigar: Column, mismatches: Column) -> Column:
    """struct<length, matches, mismatches, soft, identity, local_identity>.

    With = and X operations counts are exact; with M the mismatches come from NM.
    Operations are read once.
    """
    sums = {"length": "MIS=X", "soft": "S", "plain": "M", "gaps": "ID", "unlike": "X", "alike": "="}
    counts = let(
        cigar_ops(cigar), lambda found: F.struct(cigar.rlike("[=X]").alias("exact"), *[_summed(found, ops).alias(c) for c, ops in sums.items()])
    )

    def stats(n: Column) -> Column:
        wrong = F.when(n["exact"], n["unlike"]).otherwise(F.greatest(mismatches - n["gaps"], F.lit(0)))
        right = F.when(n["exact"], n["alike"]).otherwise(n["plain"] - wrong)
        share = lambda of: F.try_divide(right.cast("double"), of.cast("double"))
        return F.struct(
            n["length"].alias("length"),
            right.alias("matches"),
            wrong.alias("mismatches"),
            n["soft"].alias("soft"),
            share(n["length"]).alias("identity"),
            share(n["length"] - n["soft"]).alias("local_identity"),
        )

    return let(counts, stats)


def cigar_x_to_m(cigar: Column) -> Column:
    """= and X operations as M, equal neighbours merged."""
    state = lambda text, n, op: F.struct(text.alias("text"), n.alias("n"), op.alias("op"))
    # the text before the last operation, and that operation; none at first
    text = lambda s: F.when(s["op"] == "", s["text"]).otherwise(F.concat(s["text"], s["n"].cast("string"), s["op"]))
    return F.aggregate(
        cigar_ops(F.translate(cigar, "=X", "MM")),
        state(F.lit(""), F.lit(0), F.lit("")),
        lambda s, o: F.when(s["op"] == o["op"], state(s["text"], s["n"] + o["n"], s["op"])).otherwise(state(text(s), o["n"], o["op"])),
        text,
    )


def primer_mask(left: Column, between: Column, right: Column) -> Column:
    return F.concat(left, F.call_function("repeat", F.lit("N"), between), right)


def shannon_entropy(counts: Column) -> Column:
    """Entropy (base 2) of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    return -F.aggregate(counts, F.lit(0.0), lambda s, n: s + F.when(n > 0, n / total * F.log2(n / total)).otherwise(0.0))


#: IUPAC ambiguity codes by their sorted bases (fixed values).
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K",
    "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N",
}


def iupac_consensus(bases: Column) -> Column:
    """The code of a column's bases; a gap anywhere gives a gap."""
    letters = F.array_join(F.array_sort(F.array_distinct(bases)), "")
    codes = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    return F.when(F.array_contains(bases, "-"), "-").otherwise(F.coalesce(F.try_element_at(codes, letters), F.lit("N")))


def primer_span(mask: Column) -> Column:
    """struct<start, end> (0-based half-open) of the run of Ns between the primers of a mask; nulls without any."""
    start = F.locate("N", mask) - 1
    end = F.char_length(mask) - F.locate("N", F.reverse(mask)) + 1
    found = start >= 0
    return F.struct(F.when(found, start).alias("start"), F.when(found, end).alias("end"))


def centred_window(start: Column, end: Column, total: Column, width: int = 50) -> Column:
    """struct<start, end> of ``width`` places about the middle of a region, moved inside the sequence."""
    low = F.floor((start + end - width) / 2).cast("int")
    low = F.greatest(F.lit(0), F.least(low, total - width))
    return F.struct(low.alias("start"), F.least(low + width, total).alias("end"))
