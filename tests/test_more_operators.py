"""Operators that no SQL states, against plain Python; errors that have to be raised; ranges of record files."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as Q, text as X
from seqloom.operators import aggregates as A, covers as C, domain as D, genomes as N, graph as G, hierarchy as H, intervals as I, joins as J, reports as P, taxonomy as T, windows as W
from seqloom.sources import records, tables as S


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_kmers_of_long_sequences(spark):
    draw = np.random.default_rng(1)
    seqs = ["".join(draw.choice(list("ACGT"), n)) for n in (0, 3, 4, 511, 512, 513, 515, 516, 1030, 80_000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    for k in (1, 4, 300):
        got = {r.i: r.k for r in df.select("i", Q.kmers(F.col("s"), k).alias("k")).collect()}
        assert got == {i: [s[j : j + k] for j in range(len(s) - k + 1)] for i, s in enumerate(seqs)}


def test_fuzzy_and_mismatch_kmers(spark):
    one = spark.range(1).select(Q.fuzzy_kmers(F.lit("ACGTACG"), 7, 2).alias("a"), Q.fuzzy_kmers(F.lit("ACGTACG"), 7, 1, 2).alias("b"), Q.mismatch_kmers(F.lit("ACG"), 3).alias("c")).first()
    assert one.a == ["ACNTACG", "ACGNACG", "ACGTNCG"]
    assert sorted(one.b) == sorted("".join("N" if i in p else c for i, c in enumerate("ACGTACG")) for p in combinations(range(1, 6), 2))
    assert sorted(one.c) == sorted({"".join(x) for x in product("ACGT", repeat=3) if sum(a != b for a, b in zip(x, "ACG")) <= 1})
    assert Q.all_kmers(spark, 5).distinct().count() == 4**5


def test_interval_tiers_are_those_of_the_greedy_rule(spark):
    draw = np.random.default_rng(2)
    spans = [(k, int(s), int(s + draw.integers(1, 30)), i) for i, (k, s) in enumerate(zip(draw.integers(0, 3, 300), draw.integers(0, 400, 300).astype(int)))]
    got = {r.id: r.tier for r in I.interval_tiers(spark.createDataFrame([(int(k), s, e, i) for k, s, e, i in spans], "k int, s int, e int, id int"), "k", "s", "e", "id").collect()}
    for key in range(3):
        tiers: list[list] = []
        for _, s, e, i in sorted((x for x in spans if x[0] == key), key=lambda x: (x[1] - x[2], x[3])):
            at = next((n for n, t in enumerate(tiers) if all(e <= s2 or e2 <= s for s2, e2 in t)), len(tiers))
            if at == len(tiers):
                tiers.append([])
            tiers[at].append((s, e))
            assert got[i] == at


def test_pruned_trees(spark):
    texts = spark.createDataFrame([(1, "((a:1,b:2)x:3,(c:4,d:5)y:6,e:7)r;"), (2, "((a:1,q:1)z:1,w:2);")], "tree long, newick string")
    nodes = G.newick_nodes(texts)
    drop = spark.createDataFrame([("b",), ("q",)], "name string")

    def named(df):
        name = {(r.tree, r.node): r.name for r in df.collect()}
        return sorted((r.tree, r.name, r.length, name.get((r.tree, r.parent))) for r in df.collect() if r.parent is not None)

    assert named(H.pruned(nodes, drop, remove=True)) == [
        (1, "a", 4.0, "r"), (1, "c", 4.0, "y"), (1, "d", 5.0, "y"), (1, "e", 7.0, "r"), (1, "y", 6.0, "r"), (2, "a", 2.0, ""), (2, "w", 2.0, "")
    ]
    assert named(H.pruned(nodes, pattern="[ab]$|e")) == [(1, "a", 1.0, "x"), (1, "b", 2.0, "x"), (1, "e", 7.0, "r"), (1, "x", 3.0, "r"), (2, "a", 2.0, "")]


def test_leaf_orders_and_cut(spark):
    at = {"a": 0.0, "b": 1.0, "c": 10.0, "d": 11.5, "e": 30.0}
    pairs = [(1, x, y, abs(at[x] - at[y])) for x, y in combinations(at, 2)]
    df = spark.createDataFrame(pairs, "g int, a string, b string, distance double")
    for method in ("single", "complete", "average"):
        got = sorted((r.place, r.name, r.cluster) for r in G.leaf_orders(df, "g", method).collect())
        # e joins last but is the earlier cluster, being a leaf
        assert [n for _, n, _ in got] == ["e", "a", "b", "c", "d"]
        assert [c for *_, c in got] == [1, 2, 2, 2, 2]
    near = {r.name: r.cluster for r in G.leaf_orders(df, "g", "single", 0.2).collect()}
    assert near["a"] == near["b"] and near["c"] == near["d"] and len(set(near.values())) == 3


def test_near_equal_sets_even_without_a_shared_item(spark):
    draw = np.random.default_rng(3)
    sets = {m: set(draw.choice(12, draw.integers(1, 6), replace=False).tolist()) for m in range(40)}
    df = spark.createDataFrame([(m, int(i)) for m, s in sets.items() for i in s], "m int, i int")
    want = sorted((a, b, len(sets[a] ^ sets[b])) for a, b in combinations(sets, 2) if len(sets[a] ^ sets[b]) <= 4)
    assert rows(G.near_equal_sets(df, "m", "i", 4), "a", "b", "differing") == want


def test_greedy_cover_and_curves(spark):
    genomes = {"g1": "abc", "g2": "cd", "g3": "a"}
    df = spark.createDataFrame([(i, g) for g, s in genomes.items() for i in s], "item string, genome string")
    assert rows(C.greedy_cover(df, "item", "genome"), "place", "genome", "new", "total") == [(1, "g1", 3, 3), (2, "g2", 1, 4)]
    bands = P.curve_bands(W.curve(df, "item", "genome", 50, 1))
    assert rows(bands.filter("place = 3"), "mean", "sd") == [(4.0, 0.0)]
    core = W.core_curve(df, "item", "genome", 20, 1).filter("place = 3")
    assert {r.total for r in core.collect()} == {0}


def brute_chain(pieces, before, after):
    """Longest chain of placements that fit each other; ties by the pieces next to the run, then the first."""
    beside = lambda x, y: x[1] == y[1] and abs(x[2] - y[2]) == 1
    fit = lambda x, y: 3 if beside(x, y) else 1 if x[2] in (0, x[3]) and y[2] in (0, y[3]) else 0
    best = (0, -1)
    for n in range(1, len(pieces) + 1):
        for chain in combinations(pieces, n):
            if all(a[0] < b[0] and fit(a, b) for a, b in zip(chain, chain[1:])):
                score = (fit(before, chain[0]) if before else 0) + (fit(chain[-1], after) if after else 0)
                best = max(best, (n, score))
    return best, fit


def test_chosen_placements_against_all_chains(spark):
    draw = np.random.default_rng(4)
    data, want = [], {}
    for k in range(12):
        before, after = (1, "x", int(draw.integers(0, 6)), 5), (6, "x", int(draw.integers(0, 6)), 5)
        inside = sorted({(p, str(draw.choice(["x", "y"])), int(draw.integers(0, 6)), 5) for p in range(2, 6) for _ in range(3)})
        inside = [x for x in inside if sum(y[0] == x[0] for y in inside) > 1]
        used = {x[0] for x in inside}
        # a run has neighbours only where its pieces follow each other
        if used != {2, 3, 4, 5}:
            continue
        data += [(k, *x) for x in (before, *inside, after)]
        want[k] = brute_chain(inside, before, after)
    df = spark.createDataFrame(data, "k int, piece int, contig string, node int, last int")
    got: dict = {}
    for r in N.chosen_placements(df, "k").collect():
        got.setdefault(r.k, []).append((r.piece, r.contig, r.node, 5))
    assert want
    for k, ((length, score), fit) in want.items():
        own = sorted(got[k])
        chain = [x for x in own if 1 < x[0] < 6]
        assert own[0][0] == 1 and own[-1][0] == 6 and len(chain) == length
        assert all(fit(a, b) for a, b in zip(chain, chain[1:])) and fit(own[0], chain[0]) + fit(chain[-1], own[-1]) == score


def test_least_unique_regions(spark):
    msa = ["A" * 30 + x + "C" * 30 for x in ("ACGT", "ACGA", "TCGA")] + ["G" * 64]
    df = spark.createDataFrame([(1, s) for s in msa] + [(2, "A" * 40), (2, "A" * 40)], "k int, s string")
    got = {r.k: (r.start, r.end) for r in N.least_unique_regions(df, "k", "s", 5, 2).collect()}
    start, end = got[1]
    assert got[2] == (None, None) and start <= 30 and end >= 34 and end - start <= 12 and len({s[start:end] for s in msa}) == 4


def test_least_distances(spark):
    draw = np.random.default_rng(7)
    seqs = ["".join(draw.choice(list("ACGT"), 20)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    want = min(sum(x != y for x, y in zip(a, b)) for a, b in combinations(seqs, 2))
    assert N.least_distance(df, "k", "s", 20) == want
    assert N.least_distance(df.union(df), "k", "s", 20) == 0 and N.least_distance(df.limit(1), "k", "s", 20) is None


def test_similarity_has_a_row_for_every_pair(spark):
    splits = spark.createDataFrame([("q", 0, 1000.0), ("q", 1, 1000.0), ("q", 2, 500.0), ("z", 0, 10.0)], "query string, split int, length double")
    hits = spark.createDataFrame([("q", 0, "r", 0.9, 1000.0), ("q", 1, "r", 0.8, 600.0), ("q", 2, "r", 0.95, 500.0)], "query string, split int, reference string, identity double, length double")
    got = {(r.query, r.reference): (round(r.ani, 6), r.af) for r in A.similarity_of_splits(splits, hits, 0.7, 0.7).collect()}
    assert got == {("q", "r"): (0.916667, 0.6), ("z", "r"): (0.0, 0.0)}


def test_errors_that_have_to_be_raised(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, k int")
    some = spark.createDataFrame([("a",), ("b",)], "name string")
    for wrong in (
        lambda: P.checked_keys(twice, "name").collect(),
        lambda: P.list_sides(twice, some, "name").collect(),
        lambda: P.resolved(some, twice, "name", "k")[0].collect(),
        lambda: J.converted(some, "name", twice, "name", "k").collect(),
        lambda: T.found_taxa(some, twice.selectExpr("k AS taxid", "name", "'x' AS rank")).collect(),
        lambda: T.found_lineages(spark.createDataFrame([("k__A",)], "l string"), spark.createDataFrame([(1, "k__A"), (2, "k__A")], "taxid int, lineage string"), "l").collect(),
    ):
        with pytest.raises(Exception):
            wrong()
    assert rows(J.converted(some, "name", twice, "name", "k", order="k"), "name") == [(1,), (3,)]
    assert rows(P.resolved(some, twice.filter("k > 1"), "name", "k")[1], "name") == []


def test_repeated_ranks_and_tags_do_not_end_the_job(spark):
    df = spark.createDataFrame([("k__A; k__B; p__C",)], "t string")
    ranks = X.tax_map(F.col("t"))
    one = df.select(ranks.alias("m"), X.tax_at(ranks, "d").alias("d"), X.lowest_rank(ranks).alias("low"), X.cut_at_rank(ranks, "k").alias("cut")).first()
    assert (one.m, one.d, one.low, one.cut) == ({"k": "A", "p": "C"}, "A", "p", "k__A")


def test_names_spelt_nearly_alike(spark):
    from difflib import SequenceMatcher

    names = ["Rhizobium", "Rhizobum", "Bacillus", "rhizobium", "Rhizobiales"]
    df = spark.createDataFrame(list(product(names, names)), "a string, b string")
    got = {(r.a, r.b): r.same for r in df.select("a", "b", X.same_tax(F.col("a"), F.col("b")).alias("same")).collect()}
    assert got == {(a, b): a == b or SequenceMatcher(None, a, b).ratio() > 0.9 for a, b in product(names, names)}
    assert got["Rhizobium", "Rhizobum"] and not got["Rhizobium", "Bacillus"]


def test_record_files_are_read_by_ranges(spark, tmp_path):
    records.register(spark)
    draw = np.random.default_rng(8)
    letters = lambda n, of: "".join(draw.choice(list(of), n))
    fasta = [(f"s{i} x", letters(int(draw.integers(0, 200)), "ACGT")) for i in range(200)]
    (tmp_path / "a.fasta").write_text("".join(f">{h}\n" + "".join(s[i : i + 50] + "\n" for i in range(0, len(s), 50)) for h, s in fasta))
    fastq = [(f"r{i}", letters(20, "ACGT"), letters(20, "@+I")) for i in range(300)]
    (tmp_path / "b.fastq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in fastq))
    for size in (64, 1000, 10**6):
        read = lambda kind, name: spark.read.format("records").option("kind", kind).option("split_bytes", size).load(str(tmp_path / name))
        assert rows(read("fasta", "a.fasta"), "id", "seq") == sorted((h.split()[0], s) for h, s in fasta)
        assert rows(read("fastq", "b.fastq"), "id", "seq", "qual") == sorted(fastq)
    only = spark.read.format("records").option("kind", "fasta").option("extensions", "fasta").load(str(tmp_path))
    assert only.count() == 200
    assert rows(S.record_counts(spark, str(tmp_path)), "file", "n") == [("a.fasta", 200), ("b.fastq", 300)]


def test_trait_tables_and_lineages(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("entry\tK1\tK1\ng\t1\t2\n")
    with pytest.raises(ValueError):
        S.trait_matrix(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "good.tsv").write_text("entry\tK1\tK2\ng\t1\tx\n")
    assert rows(S.trait_matrix(spark, str(tmp_path / "good.tsv")), "entry", "column", "text") == [("g", "K1", "1"), ("g", "K2", "x")]
    (tmp_path / "kos.tsv").write_text("lineage\tkos\nk__A\tK1;K2\nk__B\t\n")
    assert {r.lineage: r.kos for r in S.lineage_kos(spark, str(tmp_path / "kos.tsv")).collect()} == {"k__A": ["K1", "K2"], "k__B": []}
    with pytest.raises(ValueError):
        S.ko_functions(spark, str(tmp_path / "kos.tsv"), 4)


def test_windows_about_a_region(spark):
    df = spark.createDataFrame([(10, 30, 200), (0, 10, 200), (190, 200, 200), (5, 15, 30)], "s int, e int, n int")
    got = [tuple(r.w) for r in df.select(Q.centred_window(F.col("s"), F.col("e"), F.col("n")).alias("w")).collect()]
    assert got == [(0, 50), (0, 50), (150, 200), (0, 30)]


def test_means_by_cluster(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.1, 0.0), (5.0, 5.1), (5.1, 5.0)], "x double, y double")
    clusters = {(r.x, r.y): r.cluster for r in D.two_means(df, ["x", "y"]).collect()}
    assert clusters[0.0, 0.1] == clusters[0.1, 0.0] != clusters[5.0, 5.1] == clusters[5.1, 5.0]
