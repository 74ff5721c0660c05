"""Operators on hits, classifications and alignments."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import covers as C, domain as D, graph as G, hierarchy as H


def test_bin_classes(spark):
    pairs = [(95, 3), (80, 12), (95, 20), (90, 80), (60, 5), (60, 20), (20, 0), (0, 5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c int, x int")
    got = [r.k for r in df.orderBy("i").select(D.bin_class(F.col("c"), F.col("x")).alias("k")).collect()]
    assert got == ["quality", "quality", "contaminated", "sibling", "incomplete", "junk", "junk", "junk"]


def test_clade_confidence(spark):
    hits = "array<struct<taxid:string,n:int>>"
    reads = spark.createDataFrame(
        [("r1", "562", [("562", 13), ("561", 4), ("A", 31), ("0", 1), ("562", 3)]), ("r2", "0", [])], f"name string, taxid string, hits {hits}"
    )
    lineage = H.closure(spark.createDataFrame([("561", None), ("562", "561"), ("0", None)], "t string, p string"), "t", "p")
    got = {r.name: (r.in_clade, r.total, r.confidence) for r in D.clade_confidence(reads, lineage).collect()}
    assert got["r1"] == (16, 21, pytest.approx(16 / 21)) and got["r2"] == (0, 0, None)


def test_hits(spark):
    hits = spark.createDataFrame([(0, 50, 100, 80.0, 1e-9, 0.9), (0, 20, 100, 80.0, 1e-9, 0.9)], "start int, end int, subject_length int, bitscore double, evalue double, identity double")
    assert D.filtered_hits(hits, 0.5, 50, 1e-5, 0.8).count() == 1
    assert D.filtered_hits(hits, 10, 50, 1e-5, 0.8).count() == 2


def test_greedy_cover(spark):
    c = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "c"), ("g2", "c"), ("g2", "d"), ("g3", "a")], "g string, c string")
    assert [(r.g, r.total) for r in C.greedy_cover(c, "c", "g", 5).orderBy("place").collect()] == [("g1", 3), ("g2", 4)]


def test_names_and_columns(spark):
    a = spark.createDataFrame([("contig_0001_sample",), ("zzz",)], "name string")
    b = spark.createDataFrame([("contig_0001",), ("contig_0002",)], "name string")
    assert [tuple(r) for r in D.similar_names(a, b).collect()] == [("contig_0001_sample", "contig_0001")]
    msa = spark.createDataFrame([(1, "A-CN"), (2, "AGC-"), (3, "A-C-")], "id int, seq string")
    assert {r.seq for r in D.aligned_columns(msa, "id", "seq", 0.5).collect()} == {"AC"}
    points = spark.createDataFrame([(float(i), float(i)) for i in [*range(5), *range(100, 105)]], "x double, y double")
    got = D.two_means(points, ["x", "y"]).groupBy(F.col("x") < 50).agg(F.count_distinct("cluster").alias("n")).collect()
    assert [r.n for r in got] == [1, 1]


def test_clusters(spark):
    d = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.2), ("a", "c", 0.9), ("c", "d", 0.8)], "a string, b string, distance double")
    assert {tuple(r) for r in G.single_linkage(d, 0.5).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.85), ("b", "c", 0.9), ("c", "d", 0.2)], "query string, reference string, af double")
    members = spark.createDataFrame([(x,) for x in "abcd"], "genome string")
    assert {tuple(r) for r in G.dereplicated(pairs, members, 0.8).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    hits = spark.createDataFrame([("s", 1, 0, 1000), ("s", 2, 90, 1080), ("s", 3, 180, 1150), ("s", 4, 500, 1000), ("t", 5, 0, 1000)], "subject string, id int, s int, e int")
    assert {tuple(r) for r in G.alignment_clusters(hits, "id", "s", "e", 100).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    sets = spark.createDataFrame([("x", i) for i in range(5)] + [("y", i) for i in range(1, 6)] + [("z", 0)], "m string, i int")
    assert [tuple(r) for r in G.near_equal_sets(sets, "m", "i", 2).collect()] == [("x", "y", 2)]
