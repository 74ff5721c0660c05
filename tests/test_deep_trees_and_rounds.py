"""Trees of any depth, greedy orders, tiers, names, distances and ranges of files, against plain Python."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as Q
from seqloom.operators import covers as C, domain as D, genomes as N, graph as G, hierarchy as H, intervals as I, reads as R, windows as W
from seqloom.sources import records, tables as S


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_chains_thousands_deep(spark):
    n = 5000
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(n, n)], "n long, p long")
    assert rows(H.roots(df, "n", "p")) == sorted([(i, 0, i) for i in range(n)] + [(n, n, 0)], key=str)
    assert H.closure(df.filter("n < 200"), "n", "p").count() == 200 * 201 // 2
    far = H.roots(spark.createDataFrame([("a", "b"), ("b", "out")], "n string, p string"), "n", "p")
    assert rows(far) == [("a", "out", 2), ("b", "out", 1)]


@pytest.mark.parametrize("walk", [H.roots, H.closure])
def test_circles_are_errors(spark, walk):
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "n long, p long")
    with pytest.raises(ValueError, match="circle"):
        walk(circle, "n", "p").count()


def test_deep_trees_are_pruned_and_written(spark):
    n = 300  # a comb: leaf l_i at every inner node i
    nodes = [(1, 2 * i, 2 * i - 2 if i else None, f"o{i}", 1.0) for i in range(n)] + [(1, 2 * i + 1, 2 * i, f"l{i}", 0.5) for i in range(n)]
    df = spark.createDataFrame(nodes, "tree long, node int, parent int, name string, length double")
    keep = spark.createDataFrame([("l10",), ("l150",), ("l299",)], "name string")
    left = H.pruned(df, keep)
    assert rows(left, "name", "parent", "length") == sorted([("o0", None, None), ("o10", 0, 10.0), ("l10", 20, 0.5), ("o150", 20, 140.0), ("l150", 300, 0.5), ("l299", 300, 149.5)], key=str)
    text = H.newick(left).first().newick
    assert text == "((l10:0.5,(l150:0.5,l299:149.5)o150:140.0)o10:10.0)o0;"
    whole = G.newick_nodes(H.newick(df))
    name = {r.node: r.name for r in whole.collect()}
    assert {(r.name, name.get(r.parent), r.length) for r in whole.collect()} == {(x[3], None if x[2] is None else f"o{x[2] // 2}", x[4]) for x in nodes}


def test_newick_errors(spark):
    schema = "tree long, node int, parent int, name string, length double"
    with pytest.raises(ValueError, match="one root"):
        H.newick(spark.createDataFrame([(1, 0, None, "a", None), (1, 1, None, "b", None)], schema))
    with pytest.raises(Exception, match="no newick name"):
        H.newick(spark.createDataFrame([(1, 0, None, "a(b", None)], schema)).collect()
    assert H.newick(spark.createDataFrame([(1, 0, None, None, None), (1, 2, 0, "b", None), (1, 1, 0, "a", 2.0)], schema)).first().newick == "(a:2.0,b);"


def plain_cover(has):
    left, out, total = set().union(*has.values()), [], 0
    while left:
        m = max(has, key=lambda m: (len(has[m] & left), m))
        total += len(has[m] & left)
        out.append((len(out) + 1, m, len(has[m] & left), total))
        left -= has[m]
    return out


def plain_core(has):
    core, out, open_ = set().union(*has.values()), [], set(has)
    while open_:
        m = max(open_, key=lambda m: (len(has[m] & core), m))
        core &= has[m]
        open_.remove(m)
        out.append((len(out) + 1, m, len(core)))
    return out


@pytest.mark.parametrize("few", [0, 60, 10**6])
def test_greedy_orders(spark, few):
    draw = random.Random(2)
    for share in (0.02, 0.6):
        pairs = [(i, m) for i in range(60) for m in range(25) if draw.random() < share] * 2
        has = {m: {i for i, x in pairs if x == m} for m in {m for _, m in pairs}}
        df = spark.createDataFrame(pairs, "item long, member long")
        assert sorted(tuple(r) for r in C.greedy_cover(df, "item", "member", few=few).collect()) == plain_cover(has)
        assert sorted(tuple(r) for r in C.greedy_core(df, "item", "member", few=few).collect()) == plain_core(has)


def test_greedy_orders_of_nothing(spark):
    none = spark.createDataFrame([], "item long, member string")
    assert C.greedy_cover(none, "item", "member").count() == C.greedy_core(none, "item", "member").count() == 0


def test_numbered(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 10)
    got = W.numbered(df, [F.desc("v"), F.col("id")], total="v").orderBy("place").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert [r.id for r in got] == want and [r.place for r in got] == list(range(1, 1001))
    assert [r.total for r in got] == [sum(w % 10 for w in want[: k + 1]) for k in range(1000)]


@pytest.mark.parametrize("few", [0, 20, 10**6])
def test_tiers(spark, few):
    draw = random.Random(4)
    spans = [(i % 2, s, s + draw.choice([1, 5, 30]), i) for i, s in enumerate(draw.randrange(500) for _ in range(160))]
    want = {}
    for key in (0, 1):
        tiers: list = []
        for _, s, e, i in sorted((x for x in spans if x[0] == key), key=lambda x: (x[1] - x[2], x[3])):
            at = next((n for n, t in enumerate(tiers) if all(e <= s2 or e2 <= s for s2, e2 in t)), len(tiers))
            if at == len(tiers):
                tiers.append([])
            tiers[at].append((s, e))
            want[i] = at
    df = spark.createDataFrame(spans, "k int, s int, e int, id int").repartition(5)
    got = I.interval_tiers(df, "k", "s", "e", "id", few=few)
    assert {r.id: r.tier for r in got.collect()} == want and got.columns[-1] == "tier"


def test_short_names_that_contain_each_other(spark):
    a = spark.createDataFrame([("xx_abc_yy",), ("q",), ("contig_0001_sample",), ("zz_0123456789",), ("",)], "name string")
    b = spark.createDataFrame([("abc",), ("ab",), ("query",), ("contig_0001",), ("w0123456789w",), ("",)], "name string")
    assert rows(D.similar_names(a, b)) == [("contig_0001_sample", "contig_0001"), ("q", "query"), ("xx_abc_yy", "abc"), ("zz_0123456789", "w0123456789w")]


def test_repeated_k_means(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 50 + i % 5, 1.0) for i in range(60)] + [(99, None, 1.0)], "k long, x double, y double")
    got = D.repeated_k_means(df, "k", ["x", "y"], runs=5)
    assert {r.k: tuple(r.clusters) for r in got.collect()} == {i: (i % 2,) * 5 for i in range(60)}
    assert {r.k: r["mean"] for r in D.mean_cluster(got, "k").collect()} == {i: i % 2 for i in range(60)}
    pairs = spark.createDataFrame([(0, 2), (0, 1)], "a long, b long")
    assert rows(D.co_assigned(got, pairs, "k", "a", "b")) == [(0, 1, 0.0), (0, 2, 1.0)]
    with pytest.raises(ValueError):
        D.repeated_k_means(df.limit(1), "k", ["x"], k=2)


def test_least_distance_of_every_row(spark):
    draw = random.Random(1)
    seqs = ["".join(draw.choice("ACGT") for _ in range(12)) for _ in range(60)]
    seqs += [seqs[0], seqs[1][:-1] + "N", "N" * 12]
    want = [min(sum(x != y for x, y in zip(s, t)) for j, t in enumerate(seqs) if j != i) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    assert {r.k: r.distance for r in N.least_distances(df, "k", "s", 12).collect()} == dict(enumerate(want))
    assert rows(N.least_distances(df.limit(1), "k", "s", 12)) == [(0, None)]
    groups = {r.k: r.group for r in N.near_groups(df, "k", "s", 12, 1).collect()}
    assert groups[60] == 0 and groups[61] == 1 and groups[62] == 62 and len(groups) == 63


def plain_gapped(a, b, most=3):
    runs, out = [], []
    for x, y in zip(a, b):
        gap = x == "-" or y == "-"
        if gap and runs and runs[-1][0]:
            runs[-1][1].append((x, y))
        else:
            runs.append((gap, [(x, y)]))
    for gap, places in runs:
        if not gap or len(places) <= most:
            out += places
    return sum(x != y for x, y in out) / len(out) if out else None


def test_gaps_of_both_rows_that_adjoin(spark):
    draw = random.Random(3)
    seqs = ["AC--GTAC", "ACGT--AC", "--------", "ACGTACGT"] + ["".join(draw.choice("AC-") for _ in range(8)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    want = {(i, j): plain_gapped(seqs[i], seqs[j]) for i, j in combinations(range(len(seqs)), 2)}
    assert want[0, 1] == 0
    for block in (7, 512):
        assert {(r.a, r.b): r.distance for r in N.pairwise_gapped_distances(df, "k", "s", block=block).collect()} == want
    pairs = spark.createDataFrame([(i, j, seqs[i], seqs[j]) for i, j in want], "i int, j int, a string, b string")
    assert {(r.i, r.j): r.d for r in pairs.select("i", "j", Q.gapped_distance(F.col("a"), F.col("b")).alias("d")).collect()} == want


GENBANK = "".join(
    f"LOCUS       S{i} 12 bp\n  ORGANISM  Some thing\n            Bacteria; Some.\nFEATURES             Location/Qualifiers\n"
    f"     CDS             {i + 1}..{i + 9}\n                     /locus_tag=\"T{i}\"\nORIGIN\n        1 acgtacgtac gt\n//\n"
    for i in range(6)
)


def test_genbank_files_cut_at_every_size(spark, tmp_path):
    (tmp_path / "a.gbk").write_text(GENBANK)
    records.register(spark)
    read = lambda size: rows(R.features_of(spark.read.format("records").option("kind", "genbank").option("split_bytes", size).load(str(tmp_path))))
    whole = read(1 << 20)
    assert len(whole) == 6
    for size in [*range(1, 240, 17), len(GENBANK) - 1]:
        assert read(size) == whole


def test_interpro_files_cut_at_every_size(spark, tmp_path):
    line = lambda *f: "\t".join(map(str, f)) + "\n"
    for name in "ab":
        text = "##gff-version 3\n"
        for i in range(5):
            text += line(f"{name}{i}", ".", "polypeptide", 1, 100, ".", "+", ".", "ID=x") + line(f"{name}{i}", "Pfam", "protein_match", 5, 90, 0.01, "+", ".", f"Name=PF{i}")
        text += "##FASTA\n>a0\nACGT\n" + line("a0", "Pfam", "protein_match", 5, 90, 0.01, "+", ".", "Name=behind")
        (tmp_path / name).write_text(text)
    want = sorted((f"PF{i}", f"{n}{i}") for n in "ab" for i in range(5))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (64, 100, 333, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            assert rows(R.subjects_of(S.interpro(spark, str(tmp_path)))) == want
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_apostrophes_in_values(spark, tmp_path):
    (tmp_path / "c").write_text("g1\t{'a': 'x', 'b': \"it's\", 'n': 3}\n")
    assert Counter(S.checkm(spark, str(tmp_path / "c")).first()["values"]) == {"a": "x", "b": "it's", "n": "3"}


def test_a_cluster_has_to_name_a_shared_folder():
    from types import SimpleNamespace as Made

    from seqloom.storage import checkpoint_dir

    unset = Made(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        session = Made(conf=unset, sparkContext=Made(getConf=lambda: unset, master=master))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session)
