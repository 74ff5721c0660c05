"""What the third round's findings named."""

import re
from collections import Counter
from hashlib import md5
from random import Random

import duckdb
import pytest
import numpy as np
from pyspark.sql import functions as F

from seqloom import storage
from seqloom.llm import host_rules, image_features, ordinal_quality
from seqloom.functions import sequences as Q, text as X
from seqloom.operators import aggregates as A, blocks as B, domain as D, genomes as N, graph as G, hierarchy as H, intervals as I, taxonomy as T, windows as W
from seqloom.plans import catalog
from seqloom.sources import sinks
from seqloom.storage import stored


def test_doubles_are_summed_in_file_order(spark, tmp_path):
    """The larger file is read first, and partial sums would be 0.1 + (0.2 + 0.3) = 0.6."""
    spark.createDataFrame([(1, 0.1)], "k int, x double").coalesce(1).write.parquet(str(tmp_path / "t"))
    more = spark.createDataFrame([(1, 0.2), (1, 0.3), *[(k, 1.0) for k in range(2, 3000)], (1, None)], "k int, x double")
    more.coalesce(1).write.parquet(str(tmp_path / "u"))
    files = sorted((tmp_path / "t").glob("*.parquet")) + sorted((tmp_path / "u").glob("*.parquet"))
    (tmp_path / "both").mkdir()
    for name, file in zip("ab", files):
        file.rename(tmp_path / "both" / f"{name}.parquet")
    rows = A.in_file_order(spark.read.parquet(str(tmp_path / "both")), "at").repartition(3)
    got = {r.k: r.m for r in rows.groupBy("k").agg(A.ordered_mean(F.col("at"), F.col("x")).alias("m")).collect()}
    assert got[1] == (0.1 + 0.2 + 0.3) / 3 != (0.1 + (0.2 + 0.3)) / 3
    assert got[2] == 1.0


def test_amplicons_with_ties_take_the_first_row(spark, tmp_path):
    """Two rows share order and line: the first of the table counts, whichever it is."""
    columns = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    for case, first in enumerate((50.0, 1.0)):
        rows = [(1, 7, 1, first, "A", "F"), (1, 7, 1, 51.0 - first, "A", "F"), (2, 7, 1, 1.0, "R", "F")]
        sf = tmp_path / str(case)
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(sf / "lineitem.parquet"))
        con = duckdb.connect()
        con.sql("SET threads = 1")
        con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
        want = con.sql(catalog.ORACLE_SQL["amplicon_statistics"]).fetchall()
        got = catalog.QUERIES["amplicon_statistics"](spark, str(sf)).select("amp", "n_unique", "n_duplicated", "n_ambiguous").collect()
        assert [tuple(r) for r in got] == want
        assert want[0][3] == int(first > 49)


def test_strings_are_compared_in_blocks(spark, monkeypatch):
    """Letters of any alphabet, lengths over a machine word, more than one block, keys that aren't numbers."""
    draw = Random(3)
    base = ["".join(draw.choice("ACGTN\u00e9") for _ in range(70)) for _ in range(4)]
    texts = ["".join(c if draw.random() > 0.1 else draw.choice("ACGTN\u00e9") for c in draw.choice(base)) for _ in range(60)]
    texts += [base[0], base[0], None]
    rows = [(f"k{i:02d}", s) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "k string, s string")
    apart = lambda x, y: sum(c != d for c, d in zip(x, y))
    least = {}
    for k, s in rows:
        if s is not None:
            least.setdefault(s, k)
    want = {(a, b, apart(s, t)) for s, a in least.items() for t, b in least.items() if a < b and apart(s, t) <= 12}
    monkeypatch.setattr(N, "number_of_blocks", lambda n: 5)
    assert {tuple(r) for r in N.near_pairs(df, "k", "s", 70, 12).collect()} == want
    got = {r.k: r.distance for r in N.least_distances(df, "k", "s", 70).collect()}
    assert got == {k: min(apart(s, t) for j, t in rows if j != k and t is not None) for k, s in rows if s is not None}


def test_near_strings_make_no_rows_of_candidates(spark):
    """Parts of three letters hardly set strings apart: no join may meet them."""
    df = spark.range(40).select("id", F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 32), "0123456789abcdef", "AAAAAAAATTTTTTTT").alias("s"))
    for plan in (N.near_pairs(df, "id", "s", 32, 9), N.least_distances(df, "id", "s", 32).select("distance")):
        assert "posexplode" not in plan._jdf.queryExecution().toString()


def test_sets_are_compared_in_blocks(spark, monkeypatch):
    """Frequent items: joins would meet all pairs once for each item; names, nulls, several blocks and strips."""
    draw = Random(5)
    rows = [(f"m{m:03d}", i) for m in range(300) for i in range(30) if draw.random() < 0.9] + [("m000", None), (None, 1)]
    rows += [("lone", 99), ("few", 98)]
    df = spark.createDataFrame(rows, "m string, i int")
    has = {}
    for m, i in rows:
        if m is not None and i is not None:
            has.setdefault(m, set()).add(i)
    pairs = [(a, b, len(has[a] & has[b]), len(has[a] ^ has[b])) for a in has for b in has if a < b]
    monkeypatch.setattr("seqloom.operators.blocks.number_of_blocks", lambda n, items=0: 3)
    monkeypatch.setattr(A, "MANY", 5)
    monkeypatch.setattr(G, "MANY", 5)
    shared = A.shared_clusters(df, "m", "i")
    assert "Join" not in shared._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in shared.collect()} == {(a, b, k) for a, b, k, _ in pairs if k}
    near = G.near_equal_sets(df, "m", "i", 4)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in near.collect()} == {(a, b, d) for a, b, _, d in pairs if d <= 4}


def test_blocks_grow_with_rows_and_items():
    assert [B.number_of_blocks(*n) for n in ((10,), (2000,), (600_000,), (10, 40_000_000))] == [1, 4, 37, 10]


def test_points_on_a_line_are_ordered_like_their_matrix(spark):
    draw = Random(8)
    points = [(g, k, draw.randrange(1_000_000)) for g in range(4) for k in range(1 if g == 3 else 40)]
    df = spark.createDataFrame(points, "g int, k int, v long")
    a, b = df.alias("a"), df.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")))
    pairs = met.select("a.g", F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.abs(F.col("a.v") - F.col("b.v")).alias("distance"))
    want = {tuple(r) for r in G.leaf_orders(pairs, "g", "single").collect()} | {(3, 0, 0, 1)}
    assert {tuple(r) for r in G.line_leaf_orders(df, "g", "k", "v").collect()} == want


def test_points_on_a_line_may_be_more_than_a_matrix_holds(spark):
    rows = spark.range(G.MOST_NAMES * 3).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") * F.col("id")).alias("v"))
    assert G.line_leaf_orders(rows, "g", "k", "v").agg(F.count_distinct("place")).first()[0] == G.MOST_NAMES * 3


def test_xml_files_have_one_root_and_hold_no_file_in_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_RECORDS", 10)
    path = str(tmp_path / "xml")
    sinks.write_rooted(spark.range(95), F.concat(F.lit("<r>"), F.col("id"), F.lit("</r>")), "all", path)
    texts = [p.read_text().split("\n") for p in (tmp_path / "xml").glob("part-*")]
    assert len(texts) == 10 and all(t[0] == "<all>" and t[-2:] == ["</all>", ""] for t in texts)
    assert sorted(line for t in texts for line in t[1:-2]) == sorted(f"<r>{i}</r>" for i in range(95))


def test_sequences_and_rounds_are_not_broadcast(spark):
    regions = spark.createDataFrame([("a", 0, 2, 1)], "contig string, start int, end int, strand int")
    contigs = spark.createDataFrame([("a", "ACGT")], "id string, seq string")
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "n long, p long")
    for df in (sinks.region_sequences(regions, contigs), *sinks.sequences_and_missing(regions, contigs), H.roots(nodes, "n", "p"), H.closure(nodes, "n", "p")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_hits_that_share_a_key_are_one(spark):
    hits = spark.createDataFrame([("s", 1, 0, 9), ("s", 1, 0, 9), ("s", 2, 3, 12), ("s", 5, 900, 990)], "subject string, id int, s int, e int")
    assert sorted(tuple(r) for r in G.alignment_clusters(hits, "id", "s", "e", 5).collect()) == [(1, 1), (2, 1), (5, 5)]


@pytest.mark.parametrize("piece, length", [(60, 30), (60, 2000), (10**6, 30)])
def test_tiers_of_one_large_island_are_placed_in_slices(spark, monkeypatch, piece, length):
    """Rounds grew with the longest chain of overlaps: hundreds here, each a join of all pairs."""
    monkeypatch.setattr(I, "PIECE", piece)
    written = []
    monkeypatch.setattr(I, "stored", lambda df, name: written.append(name) or stored(df, name))
    draw = Random(6)
    starts = [draw.randrange(3000) for _ in range(600)]
    spans = [(1, s, s + (length if i % 40 == 0 else draw.choice([20, 21, 45])), f"k{i:03d}") for i, s in enumerate(starts)]
    spans += [(2, 10 * s, 10 * s + 25, f"m{s:03d}") for s in range(50)]
    want, tiers = {}, {}
    for k, s, e, i in sorted(spans, key=lambda x: (x[1] - x[2], x[3])):
        of = tiers.setdefault(k, [])
        at = next((n for n, t in enumerate(of) if all(e <= a or b <= s for a, b in t)), len(of))
        of[at:] = of[at:] or [[]]
        of[at].append((s, e))
        want[i] = at
    df = spark.createDataFrame(spans, "k int, s long, e long, id string").repartition(5)
    assert {r.id: r.tier for r in I.interval_tiers(df, "k", "s", "e", "id", few=30).collect()} == want
    assert len(written) < 40


def _trees(draw, n, near):
    """Two trees of n nodes whose parents have near names, or any."""
    return [(t, i, None if i == 0 else draw.randrange(max(0, i - 3) if near else 0, i)) for t in (0, 1) for i in range(n)]


@pytest.mark.parametrize("near", [True, False])
def test_ways_are_followed_in_blocks(spark, monkeypatch, near):
    """Many blocks, names that lie near those of their parents and others; sums of whole numbers stay whole."""
    monkeypatch.setattr(H, "BLOCK", 90)
    parents = {(t, i): None if p is None else (t, p) for t, i, p in _trees(Random(2), 250, near)}
    name = lambda x: None if x is None else x[0] * 1000 + x[1]
    way = lambda x: [x, *(way(parents[x]) if parents[x] else [])]
    ways = {name(x): [name(y) for y in way(x)] for x in parents}
    df = spark.createDataFrame([(name(x), name(p)) for x, p in parents.items()], "n long, p long").repartition(4)
    assert {tuple(r) for r in H.roots(df, "n", "p").collect()} == {(x, w[-1], len(w) - 1) for x, w in ways.items()}
    assert {tuple(r) for r in H.lineage_sums(df, "n", "p").collect()} == {(x, len(w), sum(w), len(w) - 1) for x, w in ways.items()}
    marked = [7, 249, 1100]
    edges = df.filter("p IS NOT NULL").select(F.col("n").alias("node"), F.col("p").alias("to"))
    got = H.at_or_above(edges, spark.createDataFrame([(m,) for m in marked], "node long"))
    assert sorted(r.node for r in got.collect()) == sorted({a for m in marked for a in ways[m]})
    with pytest.raises(ValueError, match="circle"):
        H.at_or_above(edges.union(spark.createDataFrame([(5000, 5001), (5001, 5002), (5002, 5000)], "n long, p long")), edges.select("node"))


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    """Each round wrote all links again: as many times as the depth has binary digits."""
    monkeypatch.setattr(H, "BLOCK", 500)
    written = []
    monkeypatch.setattr(H, "stored", lambda df, name: written.append(stored(df, name)) or written[-1])
    nodes = spark.range(3000).select(F.lit(0).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    nodes = nodes.select("*", F.col("node").cast("string").alias("name"), F.lit(1.0).alias("length"))
    kept = H.pruned(nodes, nodes.filter("node = 2999").select("name"))
    assert sorted(tuple(r) for r in kept.collect()) == [(0, 0, None, "0", None), (0, 2999, 0, "2999", 2999.0)]
    assert sum(df.count() for df in written) < 12 * 3000


def test_tasks_of_intervals_do_not_grow_with_the_table(spark, monkeypatch):
    """The number of partitions was that of the session, whatever the number of rows."""
    monkeypatch.setattr(storage, "ROWS", 10)
    draw = Random(9)
    spans = [(k, s, s + draw.randrange(12), i) for i, (k, s) in enumerate((draw.randrange(20), draw.randrange(60)) for _ in range(300))]
    df = spark.createDataFrame(spans, "k int, s int, e int, i int")
    merged, painted = A.collapsed_intervals(df, ["k"], "s", "e"), N.painted(df, "k", "s", "e", "i", 5)
    assert merged.rdd.getNumPartitions() == 30 and painted.rdd.getNumPartitions() > 4
    places = {(k, p) for k, s, e, _ in spans for p in range(s, e + 1)}
    assert sorted((r.k, p) for r in merged.collect() for p in range(r.s, r.e + 1)) == sorted(places)
    best = {x: min((s - e, i) for k, s, e, i in spans if k == x[0] and s <= x[1] <= e)[1] for x in places}
    assert {(r.k, p): r.i for r in painted.collect() for p in range(r.s, r.e + 1)} == best


def test_no_near_corner_is_left_out(spark):
    """F16: descriptors up to 44 bits apart meet, whether they share a part or not; in any blocks, each pair once."""
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2, (40, 256))
    flipped = np.concatenate([base, *[np.where(draw.random(base.shape) < x, 1 - base, base) for x in (0.05, 0.1, 0.15, 0.17)]])
    longs = lambda bits: np.packbits(bits.astype(np.uint8), axis=1).view(">i8").astype(np.int64).tolist()
    frame = lambda bits: spark.createDataFrame([(n // 10, n % 10, b) for n, b in enumerate(longs(bits))], "class_id long, corner int, bits array<bigint>")
    apart = (base[:, None] != flipped[None]).sum(axis=2)
    want = {(a // 10, b // 10, a % 10, b % 10) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(apart <= 44)))}
    few = [tuple(r) for r in image_features.near_corners(frame(base), frame(flipped)).collect()]
    got = [tuple(r) for r in image_features.all_near_corners(frame(base), frame(flipped), block=30).collect()]
    assert set(few) < want and len(got) == len(set(got)) and set(got) == want
    five = {(q, i) for q, i, *_ in want if len({c for p, j, c, _ in want if (p, j) == (q, i)}) >= 5}
    assert {(r.q, r.i) for r in image_features.all_near_corners(frame(base), frame(flipped), least=5).collect()} == five
    assert image_features.all_near_corners(frame(base).limit(0), frame(flipped)).count() == 0
    assert image_features.all_near_corners(frame(base), frame(flipped).limit(0)).count() == 0


def test_replicates_of_a_curve_are_columns(spark):
    """rows met their members once for each replicate."""
    draw = Random(4)
    rows = [(draw.randrange(30), draw.randrange(12)) for _ in range(90)] + [(None, 3), (5, None)]
    df = spark.createDataFrame(rows, "item int, member int")
    found = W.curve(df, "item", "member", 3, 8)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("replicate" in line and "member" in line for line in joins)
    got = {(r.replicate, r.place): r.total for r in found.collect()}
    for k in range(3):
        members = sorted({m for _, m in rows}, key=lambda m: (md5((f"8:{k}" + ("" if m is None else f":{m}")).encode()).hexdigest(), -1 if m is None else m))
        for n in range(1, len(members) + 1):
            assert got[k, n] == len({i for i, m in rows if m is not None and m in members[:n]})


def test_pieces_are_dealt_by_how_many_there_are(spark, monkeypatch):
    """a task's memory grew with the table; found pieces were joined to all."""
    monkeypatch.setattr(storage, "ROWS", 100)
    found = catalog.QUERIES["pieces_found_and_ordered"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 100)
    assert "Join" not in plan and set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)) == {str(n)}
    rows = [(1, 1, 0, 0, 2, 1.0), (1, 2, None, None, None, 1.0), (1, 3, 0, 1, 2, 0.5), (1, 4, 7, 5, 9, 1.0), (2, 1, None, None, None, 1.0)]
    pieces = spark.createDataFrame(rows, "k int, piece int, contig int, node int, last int, identity double")
    assert {tuple(r) for r in N.found_and_ordered(pieces, "k", 0.95).collect()} == {(1, 0.5, 0.25), (2, 0.0, 0.0)}


def test_lineages_are_parsed_once_for_each_string(spark):
    """the test for a known rank was pushed below the distinct strings, to every row."""
    strings = spark.range(40).select("id", F.concat(F.lit("k__A; p__"), (F.col("id") % 3).cast("string"), F.lit("; c__x")).alias("line"))
    taxa = spark.createDataFrame([("t", "k__A"), ("u", "k__A; p__1")], "taxid string, lineage string")
    found = T.found_lineages(strings, taxa, "line")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    assert {(r.id, r.taxid, r["rank"]) for r in found.collect()} == {(i, "u" if i % 3 == 1 else "t", "p" if i % 3 == 1 else "k") for i in range(40)}


def test_taxonomy_strings_are_split_once(spark):
    """the map was made anew for each rank, and its entries for each of its keys."""
    assert str(X.tax_map(F.col("s"))).count("split(") == 1
    plan = catalog.QUERIES["taxonomy_strings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    rows = [("k__A; p__B; p__C; g__D",), ("A; B;; C",), ("",), (None,)]
    m = X.tax_map(F.col("s"))
    columns = [X.tax_string(m), X.tax_string(m, stop_at_gap=False), X.tax_string(m, trim_to="p", keep_empty=True), X.lowest_rank(m), X.lineage_divides_at(m, X.tax_map(F.lit("k__A; p__E")))]
    got = [tuple(r) for r in spark.createDataFrame(rows, "s string").coalesce(1).select(*columns).collect()]
    assert got[0] == ("k__A; p__B", "k__A; p__B; g__D", "k__A; p__B", "g", "p")
    assert got[1] == ("k__A; p__B; c__C", "k__A; p__B; c__C", "k__A; p__B", "c", "p")
    assert got[2] == ("", "", "k__; p__", None, "k")


def test_cigars_are_read_once(spark):
    """operations were read anew for each count and each use of it."""
    stats, plain = Q.alignment_stats(F.col("c"), F.col("nm")), Q.cigar_x_to_m(F.col("c"))
    assert str(stats).count("regexp_extract_all") == 1
    rows = [("3S10=2X1I5=4D", 0), ("2H5M1I3M", 3), ("5M", 0), ("", 1), ("3=2X2M1D1D", 9), (None, 1)]
    got = [(*r.s, r.p) if r.s else r.p for r in spark.createDataFrame(rows, "c string, nm int").coalesce(1).select(stats.alias("s"), plain.alias("p")).collect()]
    assert got[0] == (21, 15, 2, 3, 15 / 21, 15 / 18, "3S12M1I5M4D")
    assert got[1] == (9, 6, 2, 0, 6 / 9, 6 / 9, "2H5M1I3M")
    assert got[2] == (5, 5, 0, 0, 1.0, 1.0, "5M")
    assert got[3] == (0, -1, 1, 0, None, None, "")
    assert got[4] == (7, 3, 2, 0, 3 / 7, 3 / 7, "7M2D")
    assert got[5][-1] is None


def test_reads_are_taken_through_once(spark):
    """The files were read and shuffled a second time for reads without a hit."""
    hits = F.when(F.col("id") == 3, F.array().cast("array<struct<taxid:string,n:int>>")).otherwise(
        F.array(F.struct(F.lit("A").alias("taxid"), F.lit(7).alias("n")), F.struct(F.when(F.col("id") % 2 == 0, "x").otherwise("A").alias("taxid"), F.lit(2).alias("n")))
    )
    reads = spark.range(4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), F.lit("top").alias("taxid"), hits.alias("hits"))
    lineage = spark.createDataFrame([("x", "x"), ("x", "top"), ("top", "top")], "node string, ancestor string")
    found = D.clade_confidence(reads, lineage)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    assert {tuple(r) for r in found.collect()} == {("r0", 2, 2, 1.0), ("r1", 0, 0, None), ("r2", 2, 2, 1.0), ("r3", 0, 0, None)}


def test_kmers_of_rows_are_numbers(spark):
    """every k-mer was a row of strings, and texts were read once for each use."""
    draw = Random(9)
    texts = ["".join(draw.choice("ACGTNé x") for _ in range(draw.randrange(60))) for _ in range(600)] + [None, "", "ACG", "ACGACGACG"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    for distinct in (True, False):
        got = {r.id: r.kmers for r in N.kmer_codes(df, "seq", 3, distinct).collect()}
        for i, text in enumerate(texts):
            letters = ["ACGT".index(c) for c in text or "" if c in "ACGT"]
            want = [16 * a + 4 * b + c for a, b, c in zip(letters, letters[1:], letters[2:])]
            assert sorted(got[i]) == (sorted(set(want)) if distinct else sorted(want))
    for name in ("fuzzy_kmers_in_every_group", "conserved_kmers_of_groups"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan


def test_sets_of_a_genome_are_one(spark):
    """a genome in several rows counts once."""
    rows = [(1, "x", [1, 2]), (1, "x", [2, 3]), (2, "x", [2]), (3, "x", []), (4, "y", [5])]
    sets = spark.createDataFrame(rows, "genome int, taxon string, kmers array<int>")
    assert [tuple(r) for r in N.conserved_of_sets(sets, 2, 0.6).collect()] == [("x(n=2)", "AG", 2)]


def test_alignment_rows_are_sent_to_few_blocks(spark):
    """of a thousand rows each was sent to sixteen blocks; runs of gaps may cross machine words."""
    draw = Random(2)
    rows = [(k, "".join(draw.choice("AC--" if 55 < i < 75 else "ACG-") for i in range(150))) for k in range(12)] + [(20, "-" * 150), (21, "-" * 150)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = {(r.a, r.b): r.distance for r in N.pairwise_gapped_distances(df, "k", "s", block=5).collect()}
    x, y = df.select(F.col("k").alias("a"), F.col("s").alias("x")), df.select(F.col("k").alias("b"), F.col("s").alias("y"))
    want = {(r.a, r.b): r.d for r in x.crossJoin(y).filter("a < b").select("a", "b", Q.gapped_distance(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got == want and got[20, 21] is None
    plan = catalog.QUERIES["gapped_pair_distances"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "42), 2)" in plan  # two blocks of a thousand rows


def test_bits_that_go_together_are_in_different_parts():
    """op9 at 0.02 GB: parts of neighbouring bits, which go together, held many times the rows of even ones."""
    draw = np.random.default_rng(2)
    bits = np.concatenate([np.repeat(draw.integers(0, 2, (2000, 17)), 15, axis=1), draw.integers(0, 2, (2000, 1))], axis=1)
    bits = np.where(draw.random(bits.shape) < 0.05, 1 - bits, bits)
    words = np.packbits(bits.astype(np.uint8), axis=1).view(">i8").astype(np.int64)
    values = image_features._part_values(words, image_features._dealt_bits(words, 15))
    assert values.shape == (15, 2000) and max(np.bincount(v).max() for v in values) < 20
    apart = (bits[:300, None] != bits[None]).sum(axis=2)
    for room in (7, 16_384):
        got = image_features._near_words(words[:300], words, 44, 15, room)
        assert list(zip(*map(np.ndarray.tolist, got))) == list(zip(*map(np.ndarray.tolist, np.nonzero(apart <= 44))))
    assert (apart <= 44).sum() > 300


def test_first_stages_store_and_join_no_copy_of_rows(spark, monkeypatch):
    """Pipeline's disk: both stages stored all rows under a number, then shuffled them to take the rejected ones out."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(20)).union(docs.limit(5).withColumn("text", F.lit(None).cast("string")))

    def refused(*_):
        raise AssertionError("rows are stored")

    monkeypatch.setattr(pipeline, "stored", refused)
    model = ordinal_quality.Model(np.sin(np.arange(ordinal_quality.DIM)).astype(np.float32), np.array([-1.0, 1.0]))
    monkeypatch.setattr(ordinal_quality, "train", lambda *_: model)
    count = lambda df: Counter(map(tuple, df.collect()))
    rows = Counter(map(tuple, docs.collect()))
    kept = pipeline.quality_classifier(spark, docs, sf)
    assert "Join" not in kept._jdf.queryExecution().toString()
    good = Counter({r: n for r, n in rows.items() if model.tails(ordinal_quality.features(r[1]))[-1] >= 0.5})
    assert count(kept) == good and 0 < len(good) < len(rows)
    judged = docs.withColumn("row", F.struct("*")).select("row", "text", "source")
    verdicts = {tuple(r.row): r.kept for r in host_rules.host_rules(judged, id_col="row").collect()}
    by_id = Counter((r.doc_id, r.n_words > 0, r.kept) for r in host_rules.host_rules(docs).collect())
    assert Counter({(i, n > 0) for i, n, _ in by_id}) == Counter({(r[0], bool(r[1] and r[1].split())) for r in rows})
    assert Counter(i for i, _, k in by_id.elements() if k) == Counter(r[0] for r in rows.elements() if verdicts[r])
    assert count(pipeline.quality_rules(spark, docs, sf)) == Counter({r: n for r, n in rows.items() if verdicts[r]})


def test_pairs_of_near_pictures_are_a_row_each(spark, monkeypatch):
    """op9 on a large group of near copies: a pair was a row for each of its corners."""
    draw, made = np.random.default_rng(5), []
    base = draw.integers(-(2**63), 2**63, (30, 4)).tolist()
    spots = [(float(8 * k), 4.0) for k in range(30)]
    rows = [(p, c, *spots[c], 0.0, 1.0, [w ^ (1 << p) for w in base[c]]) for p in range(6) for c in range(30 if p < 5 else 9)]
    found = spark.createDataFrame(rows, "class_id long, corner int, x float, y float, angle float, scale float, bits array<bigint>")
    whole = image_features.components
    monkeypatch.setattr(image_features, "components", lambda links: made.append(links) or whole(links))
    near = {(r.class_id, r.near_id) for r in image_features.near_classes(found).collect()}
    assert near == {(p, 0) for p in range(5)}  # nine corners are too few
    assert "of_a" in (plan := made[0]._jdf.queryExecution().toString()) and "corner_b" not in plan
