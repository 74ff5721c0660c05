"""Relational, window and graph operators against small tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import aggregates as A, graph as G, hierarchy as H, intervals as I, joins as J, windows as W


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_range_join_meets_brute_force(spark):
    a = [(i % 3, i * 7 % 50) for i in range(40)]
    b = [(i % 3, i * 11 % 60) for i in range(40)]
    left, right = (spark.createDataFrame(x, "k int, at long") for x in (a, b))
    got = rows(J.range_join(left, right, ["k"], "at", "at", 2, 9), "k", "at", "r_at")
    assert got == sorted([(k, x, y) for k, x in a for j, y in b if k == j and 2 <= y - x <= 9], key=str)


def test_points_in_intervals(spark):
    points = spark.createDataFrame([("c", 5), ("c", 20), ("d", 5), ("c", 0)], "k string, at long")
    genes = spark.createDataFrame([("c", 0, 10, "g1"), ("c", 5, 19, "g2")], "k string, s long, e long, g string")
    got = rows(J.point_in_interval(points, genes, ["k"], "at", "s", "e", 7), "k", "at", "g")
    assert got == sorted([("c", 5, "g1"), ("c", 5, "g2"), ("c", 20, None), ("d", 5, None), ("c", 0, "g1")], key=str)


def test_division_conversion_and_merging(spark):
    have = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "z")], "i int, g string")
    assert rows(J.divided(have, "i", "g", spark.createDataFrame([("a",), ("b",)], "g string")), "i") == [(1,)]
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, t string")
    assert rows(J.converted(have.filter("g <> 'z'"), "g", table, "s", "t"), "i", "g") == [(1, "x"), (1, "y"), (2, "x")]
    with pytest.raises(Exception, match="no conversion"):
        J.converted(have, "g", table, "s", "t").collect()
    one = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(1, "c", 5), (3, "d", 6)], "k int, v string, w int")
    assert rows(J.merged_sources([one, two], ["k"]), "k", "v", "w") == [(1, "c", 5), (2, "b", None), (3, "d", 6)]
    s = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.8)], "a string, b string, s double")
    assert J.symmetric(s, "a", "b", "s").first().distance == pytest.approx(0.15)


def test_drilldown(spark):
    d = spark.createDataFrame(
        [(0, "B", "P", "A", 6), (0, "B", "P", "G", 3), (0, "B", "F", None, 1)], "q int, k string, p string, c string, w int"
    )
    assert A.drilldown(d, ["k", "p", "c"], ["q"], "w", 0.8).first().path == "B; P"
    assert A.drilldown(d, ["k", "p", "c"], ["q"], "w", 0.5).first().path == "B; P; A"


def test_intervals_and_similarity(spark):
    i = spark.createDataFrame([("s", 1, 10), ("s", 5, 20), ("s", 30, 40)], "k string, s int, e int")
    assert A.covered(i, ["k"], "s", "e").first().covered == 31
    splits = spark.createDataFrame([("q", 0, 1000), ("q", 1, 1000), ("q", 2, 500)], "query string, split int, length int")
    hits = spark.createDataFrame(
        [("q", 0, "r", 0.9, 1000), ("q", 1, "r", 0.8, 600), ("q", 2, "r", 0.95, 500)],
        "query string, split int, reference string, identity double, length int",
    )
    got = A.similarity_of_splits(splits, hits, 0.7, 0.7).first()
    assert got.ani == pytest.approx(0.916667, abs=1e-6) and got.af == pytest.approx(0.6)
    ranks = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 1.0), (1, 2.0, 4.0), (1, 3.0, 8.0)], "g int, x double, y double")
    assert A.spearman(ranks, ["g"], "x", "y").first().rho == pytest.approx(0.632456, abs=1e-5)


def test_windows(spark):
    e = spark.createDataFrame(list(enumerate("aabbbcab")), "at int, v string").withColumn("g", F.lit(1))
    assert [r.at for r in W.changes(e, ["g"], ["at"], "v").orderBy("at").collect()] == [0, 2, 5, 6, 7]
    assert rows(W.islands(e, ["g"], ["at"], F.col("v") != "c", 2), "first", "last", "n") == [(0, 4, 5), (6, 7, 2)]
    assert W.z_scores(e.withColumn("x", F.lit(3.0)), ["g"], "x", "z").first().z == 0
    assert W.rarefied(e, ["v"], "at", 2, 1).count() == 5
    clusters = [("g1", "a"), ("g1", "b"), ("g1", "c"), ("g2", "c"), ("g2", "d"), ("g3", "a")]
    c = spark.createDataFrame(clusters, "genome string, cluster string")
    seen, core = ({(r.replicate, r.place): r.total for r in f(c, "cluster", "genome", 5, 2).collect()} for f in (W.curve, W.core_curve))
    assert all(seen[i, 3] == 4 and core[i, 3] == 0 for i in range(5))
    assert all(seen[i, 1] == core[i, 1] and seen[i, 1] <= seen[i, 2] for i in range(5))


def test_graphs(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "n string, p string")
    closure = H.closure(nodes, "n", "p")
    assert rows(closure.filter("node = 'c'"), "ancestor", "depth") == [("a", 2), ("b", 1), ("c", 0)]
    pair = spark.createDataFrame([("c", "d")], "a string, b string")
    assert G.common_ancestors(pair, closure).first().lca == "a"
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a int, b int")
    assert {tuple(r) for r in G.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    d = spark.createDataFrame([(1, "a", "b", 5.0), (1, "a", "c", 9.0), (1, "b", "c", 10.0)], "g int, a string, b string, distance double")
    assert G.trees(d, "g", "upgma").first().newick == "(c:4.75,(a:2.5,b:2.5):2.25);"
    tree = G.trees(d, "g").withColumnRenamed("g", "tree").selectExpr("cast(tree AS long) AS tree", "newick")
    names = {r.name: r.length for r in G.newick_nodes(tree).collect()}
    assert {"a", "b", "c"} <= set(names)
    i = spark.createDataFrame([("k", 0, 10, 1), ("k", 5, 8, 2), ("k", 10, 12, 3)], "k string, s int, e int, id int")
    assert {r.id: r.tier for r in I.interval_tiers(i, "k", "s", "e", "id").collect()} == {1: 0, 2: 1, 3: 0}
