"""Sequence and text functions against hand-worked values."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S, text as X


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column).first()[0]


def test_kmers_and_ids(one):
    lit = F.lit
    assert value(one, S.reverse_complement(lit("ACGTN"))) == "NACGT"
    assert value(one, S.kmers(lit("ACGTA"), 3)) == ["ACG", "CGT", "GTA"]
    assert value(one, S.kmers(lit("AC"), 3)) == []
    assert value(one, S.kmer_id(lit("ACGT"))) == 27
    assert value(one, S.kmer_id(lit("ANGT"), "ACGNT")) == int("0324", 5)
    assert value(one, S.kmer_of(lit(27), 4)) == "ACGT"
    assert value(one, S.fuzzy_kmers(lit("ACGTACG"), 7, 2)) == ["ACNTACG", "ACGNACG", "ACGTNCG"]
    assert value(one, S.canonical(lit("TTG"))) == "CAA" and value(one, S.strand(lit("TTG"))) == -1
    assert value(one, S.gc_content(lit("ACGTGG"))) == pytest.approx(4 / 6)
    assert value(one, S.gc_content(lit(""))) is None


def test_alignments(one):
    lit = F.lit
    exact = value(one, S.alignment_stats(lit("10=2X3S"), lit(None).cast("int")))
    assert (exact.length, exact.matches, exact.mismatches, exact.soft) == (15, 10, 2, 3)
    assert exact.identity == pytest.approx(10 / 15) and exact.local_identity == pytest.approx(10 / 12)
    plain = value(one, S.alignment_stats(lit("8M2I"), lit(3)))
    assert (plain.length, plain.mismatches, plain.matches) == (10, 1, 7) and plain.identity == pytest.approx(0.7)
    assert value(one, S.cigar_x_to_m(lit("5=1X4=1I3="))) == "10M1I3M"
    assert value(one, S.hamming(lit("ACGT"), lit("AGGA"))) == 2
    assert value(one, S.gapped_distance(lit("AC--GT"), lit("ACT-GA"))) == pytest.approx(2 / 6)
    assert value(one, S.gapped_distance(lit("AC----GT"), lit("ACTTTTGT"))) == 0
    assert value(one, S.iupac_consensus(F.array(*map(lit, "AACG")))) == "V"
    assert value(one, S.iupac_consensus(F.array(*map(lit, "A-AA")))) == "-"
    assert value(one, S.shannon_entropy(F.array(lit(2.0), lit(1.0), lit(1.0)))) == pytest.approx(1.5)
    assert value(one, S.primer_mask(lit("AC"), lit(3), lit("GT"))) == "ACNNNGT"


def test_taxonomy_strings(one):
    ranks = X.tax_map(F.lit("k__Bacteria; p__Proteobacteria; c__; o__Rhizobiales"))
    assert value(one, X.tax_string(ranks)) == "k__Bacteria; p__Proteobacteria"
    assert value(one, X.tax_string(ranks, stop_at_gap=False)) == "k__Bacteria; p__Proteobacteria; o__Rhizobiales"
    assert value(one, X.tax_string(ranks, trim_to="o", keep_empty=True)) == "k__Bacteria; p__Proteobacteria; c__; o__Rhizobiales"
    other = X.tax_map(F.lit("Bacteria;Firmicutes"))
    assert value(one, X.lineage_divides_at(ranks, other)) == "p"


def test_names_and_headers(one):
    names = ["K10", "K2", "K1", "a2b10", "a2b9"]
    assert sorted(names, key=lambda n: value(one, X.natural_key(F.lit(n)))) == ["K1", "K2", "K10", "a2b9", "a2b10"]
    fields = value(one, X.contig_fields(F.lit("NODE_1_len_200_cov_3.5")))
    assert (fields.prefix, fields.length, fields.coverage) == ("NODE", 200, 3.5)
    assert value(one, X.base_name(F.lit("/x/y/reads.fa"))) == "reads"
    region = value(one, X.region_of_header(F.lit("genome=a|b|slice=[3:9]")))
    assert (region.genome, region.start, region.stop) == ("a|b", 3, 9)
    assert str(value(one, X.listing_time(F.lit("Tue Feb 18 13:05:00 PST 2014")))) == "2014-02-18 13:05:00"
    assert value(one, X.guessed_number(F.lit("x1"))) is None
