"""Queries of the sequence operators; documents stand in for sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.functions import sequences as S, text as X
from seqloom.operators import aggregates as A, domain as D, graph as G, hierarchy as H, windows as W

from .registry import Tables, query

K = 5


def _dna(t: Tables) -> DataFrame:
    """(doc_id, lang, seq): the letters A, C, G and T of each text."""
    return t.documents.select("doc_id", "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


_DNA = "dna AS (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
_KMERS = _DNA + """,
km AS (SELECT doc_id, lang, seq[i:i + 4] AS kmer FROM (
  SELECT doc_id, lang, seq, unnest(range(1, greatest(length(seq) - 3, 1))) AS i FROM dna)),
ck AS (SELECT doc_id, lang, kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canon FROM km)"""


def _kmers(t: Tables) -> DataFrame:
    pieces = _dna(t).select("doc_id", "lang", F.explode(S.pieces_for_kmers(F.col("seq"), K)).alias("piece"))
    return pieces.select("doc_id", "lang", F.explode(S.kmers_of_piece(F.col("piece"), K)).alias("kmer"))


@query(f"WITH {_KMERS} SELECT canon AS kmer, count(*) AS n FROM ck GROUP BY 1")
def canonical_kmer_count(t: Tables) -> DataFrame:
    # counted by plain k-mer first: a thousand rows are left to turn around
    plain = _kmers(t).groupBy("kmer").agg(F.count("*").alias("n"))
    return plain.groupBy(S.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))


@query(f"""WITH {_KMERS} SELECT canon AS kmer, count(DISTINCT lang) AS n_groups, count(*) AS n
FROM ck GROUP BY 1 HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM dna)""")
def conserved_canonical_kmers(t: Tables) -> DataFrame:
    counts = _kmers(t).groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    groups = t.documents.agg(F.count_distinct("lang").alias("n")).scalar()
    return (
        counts.groupBy(S.canonical(F.col("kmer")).alias("kmer"))
        .agg(F.count_distinct("lang").alias("n_groups"), F.sum("n").alias("n"))
        .filter(F.col("n_groups") == groups)
    )


@query(f"""WITH {_KMERS}, n AS (SELECT lang, count(*) AS total FROM ck GROUP BY 1)
SELECT lang, canon AS kmer, count(*) / any_value(total) AS frequency FROM ck JOIN n USING (lang) GROUP BY 1, 2""")
def kmer_profile(t: Tables) -> DataFrame:
    counts = _kmers(t).groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    canon = counts.groupBy("lang", S.canonical(F.col("kmer")).alias("kmer")).agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return canon.join(totals, "lang").select("lang", "kmer", (F.col("n") / F.col("total")).alias("frequency"))


@query(f"""WITH {_KMERS} SELECT kmer, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(kmer, ''),
  lambda x: (CASE x WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END)::BIGINT)), lambda a, b: a * 4 + b) AS id,
  CASE WHEN kmer <= reverse(translate(kmer, 'ACGT', 'TGCA')) THEN 1 ELSE -1 END AS strand, kmer AS back
FROM (SELECT DISTINCT kmer FROM ck)""")
def kmer_base4_id(t: Tables) -> DataFrame:
    distinct = _kmers(t).select("kmer").distinct()
    made = distinct.withColumn("id", S.kmer_id(F.col("kmer")))
    return made.select("kmer", "id", S.strand(F.col("kmer")).alias("strand"), S.kmer_of(F.col("id"), K).alias("back"))


@query(f"""WITH {_KMERS}, u AS (SELECT DISTINCT kmer FROM ck),
f AS (SELECT kmer, unnest([kmer[1:1] || 'N' || kmer[3:5], kmer[1:2] || 'N' || kmer[4:5], kmer[1:3] || 'N' || kmer[5:5]]) AS fuzzy FROM u)
SELECT fuzzy, count(*) AS n_kmers FROM f GROUP BY 1""")
def fuzzy_kmer_links(t: Tables) -> DataFrame:
    distinct = _kmers(t).select("kmer").distinct()
    return distinct.select(F.explode(S.fuzzy_kmers(F.col("kmer"), K, 1)).alias("fuzzy")).groupBy("fuzzy").agg(
        F.count("*").alias("n_kmers")
    )


@query(f"""WITH {_DNA} SELECT doc_id, length(seq) AS length,
  CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END AS gc,
  md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_digest FROM dna""")
def gc_content_and_reverse(t: Tables) -> DataFrame:
    seq = F.col("seq")
    return _dna(t).select(
        "doc_id",
        F.char_length(seq).cast("long").alias("length"),
        S.gc_content(seq).alias("gc"),
        F.md5(F.encode(S.reverse_complement(seq), "UTF-8")).alias("rc_digest"),
    )


@query(f"""WITH {_KMERS}, c AS (SELECT lang, kmer, count(*) AS n FROM ck GROUP BY 1, 2),
b AS (SELECT lang, base, count(*) AS n FROM (SELECT lang, unnest(string_split(seq, '')) AS base FROM dna WHERE seq <> '') GROUP BY 1, 2),
p AS (SELECT lang, base, n / sum(n) OVER (PARTITION BY lang) AS p FROM b),
o AS (SELECT lang, kmer, n / sum(n) OVER (PARTITION BY lang) AS obs FROM c),
e AS (SELECT o.lang, o.kmer, any_value(obs) AS obs, exp(sum(ln(p))) AS expected
      FROM (SELECT lang, kmer, obs, unnest(string_split(kmer, '')) AS base FROM o) o JOIN p ON p.lang = o.lang AND p.base = o.base
      GROUP BY 1, 2)
SELECT lang, sum(obs * ln(obs / expected)) AS relative_entropy FROM e GROUP BY 1""")
def kmer_relative_entropy(t: Tables) -> DataFrame:
    counts = _kmers(t).groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    bases = _dna(t).groupBy("lang").agg(
        *[F.sum(F.char_length(F.regexp_replace("seq", f"[^{b}]", ""))).alias(b) for b in "ACGT"]
    )
    freq = F.create_map(*[x for b in "ACGT" for x in (F.lit(b), F.ln(F.col(b) / (F.col("A") + F.col("C") + F.col("G") + F.col("T"))))])
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = counts.join(totals, "lang").join(bases.select("lang", freq.alias("freq")), "lang")
    expected = F.exp(F.aggregate(F.split("kmer", ""), F.lit(0.0), lambda s, b: s + F.element_at("freq", b)))
    rows = rows.select("lang", (F.col("n") / F.col("total")).alias("obs"), expected.alias("expected"))
    return A.relative_entropy(rows, ["lang"], "obs", "expected")


_CELLS = "c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS nt FROM documents)"


@query(f"""WITH {_CELLS}, n AS (SELECT pos, nt, count(*) AS n FROM c GROUP BY 1, 2)
SELECT pos, -sum(n / total * log2(n / total)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY pos) AS total FROM n) GROUP BY 1""")
def alignment_column_entropy(t: Tables) -> DataFrame:
    """Whole texts as rows of an alignment; a column holds the rows that reach it."""
    cells = t.documents.select(F.posexplode(F.split("text", "")).alias("pos", "nt"))
    return A.entropy(cells.withColumn("pos", F.col("pos") + 1), ["pos"], "nt")


@query(f"""WITH {_CELLS}, k AS (SELECT pos FROM c GROUP BY pos HAVING avg(CASE WHEN nt = ' ' THEN 1.0 ELSE 0.0 END) < 0.15)
SELECT doc_id, md5(string_agg(nt, '' ORDER BY pos)) AS kept FROM c JOIN k USING (pos) GROUP BY 1""")
def masked_gap_filter(t: Tables) -> DataFrame:
    kept = D.aligned_columns(t.documents, "doc_id", "text", 0.15, (" ",)).filter("text <> ''")
    return kept.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("kept"))


def _taxonomy(t: Tables) -> DataFrame:
    region, nation = t.region, t.nation
    joined = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        "c_custkey", "r_name", "n_name", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).cast("decimal(18,2)").alias("weight")
    )


_TAX = """tax AS (SELECT c_custkey, r_name, n_name, c_mktsegment, greatest(c_acctbal, 0.0)::DECIMAL(18,2) AS weight
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_TAX}, p AS (
  SELECT c_mktsegment, r_name, n_name, sum(weight) AS w FROM tax GROUP BY 1, 2, 3),
total AS (SELECT c_mktsegment, sum(w) AS t FROM p GROUP BY 1),
r1 AS (SELECT c_mktsegment, r_name, sum(w) AS w FROM p GROUP BY 1, 2),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY w DESC, r_name) AS k FROM r1) JOIN total USING (c_mktsegment)
       WHERE k = 1 AND w >= 0.15 * t),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, r_name ORDER BY w DESC, n_name) AS k FROM p) JOIN total USING (c_mktsegment)
       WHERE k = 1 AND w >= 0.15 * t)
SELECT b1.c_mktsegment, CASE WHEN n_name IS NULL THEN 1 ELSE 2 END AS depth,
       b1.r_name || coalesce('; ' || n_name, '') AS path
FROM b1 LEFT JOIN b2 ON b1.c_mktsegment = b2.c_mktsegment AND b1.r_name = b2.r_name""")
def majority_drilldown(t: Tables) -> DataFrame:
    return A.drilldown(_taxonomy(t), ["r_name", "n_name"], ["c_mktsegment"], "weight", 0.15)


@query(f"""WITH {_TAX} SELECT r_name, n_name, sum(weight)::DOUBLE AS weight, count(*) AS n FROM tax GROUP BY ROLLUP (r_name, n_name)""")
def rank_rollup(t: Tables) -> DataFrame:
    return _taxonomy(t).rollup("r_name", "n_name").agg(F.sum("weight").cast("double").alias("weight"), F.count("*").alias("n"))


@query("""WITH RECURSIVE n(node, parent) AS (
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'world', NULL),
c AS (SELECT node, node AS ancestor, 0 AS depth FROM n UNION ALL
      SELECT c.node, n.parent, c.depth + 1 FROM c JOIN n ON c.ancestor = n.node WHERE n.parent IS NOT NULL)
SELECT node, ancestor, depth FROM c""")
def recursive_lineage(t: Tables) -> DataFrame:
    return H.closure(_tree(t), "node", "parent")


def _tree(t: Tables) -> DataFrame:
    nation = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    region = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"))
    root = t.region.limit(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("parent"))
    return nation.unionByName(region).unionByName(root)


@query("""SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b,
  CASE WHEN a.n_regionkey = b.n_regionkey THEN 'r' || a.n_regionkey ELSE 'world' END AS lca
FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1""")
def lowest_common_ancestor(t: Tables) -> DataFrame:
    nation = t.nation
    pairs = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("n"), F.col("n_nationkey") + 1).alias("b"))
    known = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return G.common_ancestors(pairs.join(known, "b", "left_semi"), H.closure(_tree(t), "node", "parent"))


@query(f"""WITH {_TAX} SELECT c_custkey, 'k__' || r_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '; p__' || n_name END
  || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '; c__' || c_mktsegment END AS stopping,
  'k__' || r_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '; p__' || n_name END || '; c__' || c_mktsegment AS skipping FROM tax""")
def taxonomy_strings(t: Tables) -> DataFrame:
    gap = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("p__"), "n_name"))
    text = F.concat(F.lit("k__"), "r_name", F.lit("; "), gap, F.lit("; c__"), "c_mktsegment")
    ranks = F.col("ranks")
    return _taxonomy(t).withColumn("ranks", X.tax_map(text)).select(
        "c_custkey", X.tax_string(ranks).alias("stopping"), X.tax_string(ranks, stop_at_gap=False).alias("skipping")
    )


@query("""WITH h AS (SELECT l_suppkey AS query, l_orderkey % 50 AS split, l_partkey % 7 AS reference,
  1 - l_discount AS identity, l_quantity AS length FROM lineitem),
s AS (SELECT query, split, 45.0::DOUBLE AS length FROM (SELECT DISTINCT query, split FROM h)),
b AS (SELECT query, split, reference, max_by({'i': identity, 'l': length}, {'p': identity * length, 'l': length}) AS h FROM h GROUP BY 1, 2, 3),
g AS (SELECT b.query, b.reference, b.h.i * b.h.l AS weighted, s.length FROM b JOIN s USING (query, split) WHERE b.h.i >= 0.98 AND b.h.l >= 0.9 * s.length),
k AS (SELECT query, reference, sum(weighted) AS w, sum(length) AS m FROM g GROUP BY 1, 2),
t AS (SELECT query, sum(length) AS total FROM s GROUP BY 1), r AS (SELECT DISTINCT reference FROM h)
SELECT t.query, r.reference, coalesce(w / m, 0) AS ani, coalesce(m / total, 0) AS af FROM t CROSS JOIN r LEFT JOIN k ON k.query = t.query AND k.reference = r.reference""")
def similarity_of_genomes(t: Tables) -> DataFrame:
    hits = t.lineitem.select(
        F.col("l_suppkey").alias("query"),
        (F.col("l_orderkey") % 50).alias("split"),
        (F.col("l_partkey") % 7).alias("reference"),
        (1 - F.col("l_discount")).alias("identity"),
        F.col("l_quantity").alias("length"),
    )
    splits = hits.select("query", "split").distinct().withColumn("length", F.lit(45.0))
    return A.similarity_of_splits(splits, hits, 0.98, 0.9)


@query("""SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS root FROM customer
QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1""")
def connected_groups(t: Tables) -> DataFrame:
    """Components of customers chained to the next one of their nation."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    edges = t.customer.select(F.col("c_custkey").alias("a"), F.lead("c_custkey").over(w).alias("b")).filter("b IS NOT NULL")
    return G.components(edges)


_ORDERS = """o AS (SELECT x.r::INT AS replicate, m, row_number() OVER (PARTITION BY x.r ORDER BY md5('3:' || x.r || ':' || m), m) AS place FROM range(10) x(r), (SELECT DISTINCT l_suppkey AS m FROM lineitem))"""


@query(f"""WITH {_ORDERS}, f AS (SELECT replicate, i, min(place) AS place FROM o JOIN (SELECT DISTINCT l_suppkey, l_partkey AS i FROM lineitem) ON l_suppkey = m GROUP BY 1, 2),
n AS (SELECT replicate, place, count(*) AS new FROM f GROUP BY 1, 2)
SELECT o.replicate, o.place, (sum(coalesce(new, 0)) OVER (PARTITION BY o.replicate ORDER BY o.place))::BIGINT AS total FROM o LEFT JOIN n USING (replicate, place)""")
def pangenome_curve(t: Tables) -> DataFrame:
    """Distinct parts seen after each supplier, in ten random orders."""
    return W.curve(t.lineitem, "l_partkey", "l_suppkey", 10, 3)


@query(f"""WITH {_ORDERS}, h AS (SELECT DISTINCT replicate, i, place FROM o JOIN (SELECT l_suppkey, l_partkey % 40 AS i FROM lineitem) ON l_suppkey = m),
p AS (SELECT *, row_number() OVER (PARTITION BY replicate, i ORDER BY place) AS n FROM h), c AS (SELECT replicate, place, count(*) AS total FROM p WHERE n = place GROUP BY 1, 2)
SELECT o.replicate, o.place, coalesce(total, 0) AS total FROM o LEFT JOIN c USING (replicate, place)""")
def core_genome_curve(t: Tables) -> DataFrame:
    parts = t.lineitem.select((F.col("l_partkey") % 40).alias("cluster"), "l_suppkey")
    return W.core_curve(parts, "cluster", "l_suppkey", 10, 3)


@query("""SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('5:' || event_id), event_id) <= 100""")
def rarefied_events(t: Tables) -> DataFrame:
    return W.rarefied(t.events, ["event_type"], "event_id", 100, 5)


def _prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^([A-Z][a-z]+)", 1)


@query("""SELECT doc_id, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS barcode,
  CASE WHEN regexp_extract(text, '^([A-Z][a-z]+)', 1) = '' THEN 'undetermined'
       WHEN length(regexp_extract(text, '^([A-Z][a-z]+)', 1)) <= 4 THEN 'partial' ELSE 'determined' END AS route
FROM documents""")
def demultiplex_route(t: Tables) -> DataFrame:
    code = _prefix(F.col("text"))
    route = F.when(code == "", "undetermined").when(F.char_length(code) <= 4, "partial").otherwise("determined")
    return t.documents.select("doc_id", code.alias("barcode"), route.alias("route"))
