"""Queries of the genome operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions import sequences as Q
from seqloom.operators import genomes as N
from seqloom.storage import cut, dealt

from .registry import Tables, query

key = F.col


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Suppliers as contigs of their nation, lines as depth and, of every other order, as genes.
_GENOMES = """contigs AS (SELECT s_nationkey AS genome, s_suppkey AS contig, repeat('ACGGT', 20 + s_suppkey::INT % 30) AS seq FROM supplier),
depth AS (SELECT s_nationkey AS genome, l_suppkey AS contig, l_partkey AS pos, l_quantity AS cov FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
genes AS (SELECT s_nationkey AS genome, l_suppkey AS contig, l_orderkey * 10 + l_linenumber AS gene, l_partkey AS start, l_partkey + l_linenumber AS "end" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R')"""


def _genomes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    contigs = t.supplier.select(
        key("s_nationkey").alias("genome"), key("s_suppkey").alias("contig"), F.repeat(F.lit("ACGGT"), (20 + key("s_suppkey") % 30).cast("int")).alias("seq")
    )
    rows = t.lineitem.join(t.supplier, key("l_suppkey") == key("s_suppkey"))
    place = [key("s_nationkey").alias("genome"), key("l_suppkey").alias("contig")]
    depth = rows.select(*place, key("l_partkey").alias("pos"), key("l_quantity").alias("cov"))
    genes = rows.filter("l_returnflag = 'R'").select(
        *place, (key("l_orderkey") * 10 + key("l_linenumber")).alias("gene"), key("l_partkey").alias("start"), (key("l_partkey") + key("l_linenumber")).alias("end")
    )
    return contigs, depth, genes


@query(f"""WITH {_GENOMES}, g AS (SELECT genome, contig, sum("end" - start) AS coding FROM genes GROUP BY 1, 2), d AS (SELECT genome, contig, avg(cov) AS avg_cov, median(cov) AS med_cov FROM depth GROUP BY 1, 2)
SELECT genome, contig, length(seq) AS size, 0.6::DOUBLE AS gc, avg_cov, med_cov, coalesce(coding, 0) / length(seq) AS density FROM contigs LEFT JOIN g USING (genome, contig) LEFT JOIN d USING (genome, contig)""")
def contig_statistics(t: Tables) -> DataFrame:
    return N.contig_table(*_genomes(t))


@query(f"""WITH {_GENOMES}, g AS (SELECT genome, sum("end" - start) AS coding FROM genes GROUP BY 1), d AS (SELECT genome, avg(cov) AS avg_cov, median(cov) AS med_cov FROM depth GROUP BY 1),
c AS (SELECT genome, sum(length(seq)) AS size, count(*) AS n_contigs FROM contigs GROUP BY 1)
SELECT genome, size::BIGINT AS size, n_contigs, avg_cov, med_cov, coalesce(coding, 0) / size AS density FROM c LEFT JOIN g USING (genome) LEFT JOIN d USING (genome)""")
def genome_statistics(t: Tables) -> DataFrame:
    return N.genome_table(*_genomes(t))


@query(f"""WITH {_GENOMES}, m AS (SELECT genome, median(cov) AS med FROM depth GROUP BY 1),
h AS (SELECT g.genome, g.contig, gene, any_value("end" - start) AS size, avg(cov) AS avg_cov, median(cov) AS med_cov FROM genes g JOIN depth d ON g.genome = d.genome AND g.contig = d.contig AND pos BETWEEN start AND "end" GROUP BY 1, 2, 3)
SELECT genome, contig, gene, size, avg_cov, med_cov, avg_cov / med AS copies FROM h JOIN m USING (genome)""")
def gene_statistics(t: Tables) -> DataFrame:
    _, depth, genes = _genomes(t)
    return N.gene_table(depth, genes, 10)


@query(f"""WITH {_GENOMES}, c AS (SELECT genome, contig, length(seq) AS size, avg(cov) AS cov FROM contigs JOIN depth USING (genome, contig) GROUP BY 1, 2, 3)
SELECT genome, sum(cov * size) / sum(size) AS weighted, avg(cov) AS mean, stddev_pop(cov) AS sd FROM c GROUP BY 1""")
def genome_coverage(t: Tables) -> DataFrame:
    return N.coverage_summary(N.contig_table(*_genomes(t)).filter("avg_cov IS NOT NULL"), "genome")


_LETTERS = """c AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
  CASE WHEN l_quantity > 47 THEN '-' WHEN l_quantity > 40 THEN 'N' WHEN l_quantity > 38 THEN 'R' ELSE 'A' END AS nt FROM lineitem)"""


def _letters(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = key("l_quantity")
    letter = F.when(n > 47, "-").when(n > 40, "N").when(n > 38, "R").otherwise("A")
    return t.lineitem.select(key("l_suppkey").alias("k"), (F.row_number().over(w) - 1).alias("pos"), letter.alias("nt"))


@query(f"""WITH {_LETTERS}, b AS (SELECT *, sum((nt = '-')::INT) OVER (PARTITION BY k ORDER BY pos) AS run, lag(nt) OVER (PARTITION BY k ORDER BY pos) AS before FROM c),
s AS (SELECT * FROM b WHERE nt = 'A' AND coalesce(before <> 'A', TRUE)), e AS (SELECT k, run, max(pos) AS last FROM b WHERE nt <> '-' GROUP BY 1, 2),
x AS (SELECT s.k, s.pos AS first, e.last AS run_end, (SELECT a.pos FROM b a WHERE a.k = s.k AND a.run = s.run AND a.pos > s.pos AND a.nt IN ('N', 'R') ORDER BY a.pos LIMIT 1 OFFSET 2) AS stop FROM s JOIN e USING (k, run))
SELECT k, first, coalesce(stop - 1, run_end) AS last FROM x WHERE coalesce(stop - 1, run_end) - first + 1 >= 12""")
def ambiguous_runs(t: Tables) -> DataFrame:
    return N.ambiguous_runs(_letters(t), "k", "pos", "nt", 12, 2)


@query("""WITH c AS (SELECT p_brand AS k, unnest(range(1, length(p_name) + 1)) AS pos, unnest(string_split(upper(p_name), '')) AS nt FROM part),
n AS (SELECT k, pos, CASE WHEN nt IN ('A', 'C', 'G', 'T') THEN nt WHEN nt < 'K' THEN 'A' WHEN nt < 'Q' THEN 'C' ELSE 'G' END AS nt FROM c), m AS (SELECT k, pos, nt, count(*) AS n FROM n GROUP BY 1, 2, 3),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY k, pos) AS p FROM m)
SELECT k, pos, -sum(p * log2(p)) AS entropy, CASE string_agg(nt, '' ORDER BY nt) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'CG' THEN 'S' WHEN 'ACG' THEN 'V' WHEN 'AT' THEN 'W' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K'
  WHEN 'ACT' THEN 'H' WHEN 'AGT' THEN 'D' WHEN 'CGT' THEN 'B' WHEN 'ACGT' THEN 'N' ELSE min(nt) END AS code FROM p GROUP BY 1, 2""")
def consensus_codes(t: Tables) -> DataFrame:
    cells = t.part.select(key("p_brand").alias("k"), F.posexplode(F.split(F.upper("p_name"), "")).alias("at", "nt"))
    nt = F.when(key("nt").isin("A", "C", "G", "T"), key("nt")).when(key("nt") < "K", "A").when(key("nt") < "Q", "C").otherwise("G")
    return N.consensus(cells.select("k", (key("at") + 1).alias("pos"), nt.alias("nt")), "k", "pos", "nt")


_FAILED = "f AS (SELECT DISTINCT l_partkey AS a, l_suppkey % 40 AS g FROM lineitem WHERE l_discount > 0.09)"


@query(f"""WITH {_FAILED}, p AS (SELECT a, count(*) AS n, min(g) AS g FROM f GROUP BY 1)
SELECT 'number' AS kind, n AS k, count(*) AS n FROM p GROUP BY n UNION ALL SELECT 'genome', g, count(*) FROM f GROUP BY g UNION ALL SELECT 'alone', g, count(*) FROM p WHERE n = 1 GROUP BY g""")
def failing_amplicons(t: Tables) -> DataFrame:
    failed = t.lineitem.filter("l_discount > 0.09").select(key("l_partkey").alias("amplicon"), (key("l_suppkey") % 40).alias("genome"))
    kinds = zip(("number", "genome", "alone"), ("failing", "genome", "genome"), N.failing_histograms(failed))
    one, two, three = [df.select(F.lit(kind).alias("kind"), key(c).alias("k"), "n") for kind, c, df in kinds]
    return one.union(two).union(three)


@query("""WITH h AS (SELECT l_returnflag AS g, l_suppkey AS c, l_partkey % 60 AS p, l_orderkey AS s FROM lineitem),
n AS (SELECT DISTINCT a.g, a.p AS a, b.p AS b FROM h a JOIN h b ON a.g = b.g AND a.c = b.c AND b.s - a.s BETWEEN 1 AND 40 AND a.p <> b.p)
SELECT a, b FROM n GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT g) FROM h)""")
def pairs_in_every_genome(t: Tables) -> DataFrame:
    hits = t.lineitem.select(
        key("l_returnflag").alias("genome"), key("l_suppkey").alias("contig"), (key("l_partkey") % 60).alias("piece"), key("l_orderkey").alias("start")
    )
    return N.shared_pairs(hits, hits.select("genome"), 1, 40)


_KM = """dna AS (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
km AS (SELECT DISTINCT doc_id, lang, seq[i:i + 6] AS kmer FROM (SELECT doc_id, lang, seq, unnest(range(1, greatest(length(seq) - 5, 1))) AS i FROM dna) WHERE length(seq[i:i + 6]) = 7)"""


def _kmers(t: Tables, k: int = 7, distinct: bool = True) -> DataFrame:
    """(genome, taxon, kmers): k-mers of documents by their numbers."""
    dna = t.documents.select(key("doc_id").alias("genome"), key("lang").alias("taxon"), F.upper("text").alias("seq"))
    return N.kmer_codes(dna, "seq", k, distinct)


def _kmer_counts(t: Tables, by: list[str], k: int) -> DataFrame:
    """(by, kmer, n): how often k-mers occur."""
    counts = _kmers(t, k, distinct=False).select(*by, F.explode("kmers").alias("code")).groupBy(*by, "code").agg(F.count("*").alias("n"))
    return counts.select(*by, Q.kmer_of(key("code"), k).alias("kmer"), "n")


@query(f"""WITH {_KM}, u AS (SELECT DISTINCT kmer, lang FROM km), p AS (SELECT i, j FROM range(2, 7) a(i), range(2, 7) b(j) WHERE i < j),
l AS (SELECT kmer, lang, kmer[1:i - 1] || 'N' || kmer[i + 1:j - 1] || 'N' || kmer[j + 1:7] AS fuzzy FROM u, p),
d AS (SELECT fuzzy FROM l GROUP BY 1 HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM u))
SELECT DISTINCT fuzzy, kmer FROM l WHERE fuzzy IN (SELECT fuzzy FROM d)""")
def fuzzy_kmers_in_every_group(t: Tables) -> DataFrame:
    """Seven-letter k-mers with two Ns off the ends that every language has in some spelling."""
    codes = _kmers(t).select(key("taxon").alias("genome"), F.explode("kmers").alias("code")).distinct()
    held = cut(codes.select(Q.kmer_of(key("code"), 7).alias("kmer"), "genome"))  # read several times
    links = held.select("kmer").distinct().select("kmer", F.explode(Q.fuzzy_kmers(key("kmer"), 7, 1, 2)).alias("fuzzy"))
    return N.fuzzy_division(held, links, held.select("genome"))


@query("""WITH dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents), k AS (SELECT seq[i:i + 3] AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, greatest(length(seq) - 2, 1))) AS i FROM dna) WHERE length(seq[i:i + 3]) = 4 GROUP BY 1),
m AS (SELECT DISTINCT kmer, n, kmer[1:i - 1] || x || kmer[i + 1:4] AS near FROM k, range(1, 5) a(i), (VALUES ('A'), ('C'), ('G'), ('T')) v(x))
SELECT near AS kmer, sum(n)::BIGINT AS n FROM m GROUP BY 1""")
def mismatch_kmer_counts(t: Tables) -> DataFrame:
    counts = _kmer_counts(t, [], 4)
    near = counts.select(F.explode(Q.mismatch_kmers(key("kmer"), 4)).alias("kmer"), "n").groupBy("kmer").agg(F.sum("n").alias("n"))
    return Q.all_kmers(t.spark, 4).join(near, "kmer")


@query(f"""WITH {_KM}, g AS (SELECT lang, count(DISTINCT doc_id) AS size FROM km GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT lang || '(n=' || size || ')' AS label, kmer, count(*) AS n_genomes FROM km JOIN g USING (lang) GROUP BY lang, size, kmer HAVING count(*) >= ceil(0.6 * size)""")
def conserved_kmers_of_groups(t: Tables) -> DataFrame:
    return N.conserved_of_sets(_kmers(t), 7, 0.6)


@query(f"""WITH {_KM.replace('SELECT DISTINCT doc_id, lang, seq', 'SELECT doc_id, lang, seq')}, c AS (SELECT lang, kmer, count(*) AS n FROM km GROUP BY 1, 2), p AS (SELECT lang, kmer, n / sum(n) OVER (PARTITION BY lang) AS v FROM c)
SELECT a.l AS a, b.l AS b, (SELECT sum(abs(coalesce(x.v, 0) - coalesce(y.v, 0))) FROM (SELECT * FROM p WHERE lang = a.l) x FULL JOIN (SELECT * FROM p WHERE lang = b.l) y ON x.kmer = y.kmer) / 16384 AS difference
FROM (SELECT DISTINCT lang AS l FROM p) a JOIN (SELECT DISTINCT lang AS l FROM p) b ON a.l < b.l""")
def signature_differences(t: Tables) -> DataFrame:
    counts = cut(_kmer_counts(t, ["taxon"], 7))
    totals = counts.groupBy("taxon").agg(F.sum("n").alias("total"))
    profile = counts.join(totals, "taxon").select(key("taxon").alias("name"), "kmer", (key("n") / key("total")).alias("value"))
    return N.signature_differences(profile, 7)


@query("""WITH a AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem),
p AS (SELECT DISTINCT k, unnest(range(s, e + 1)) AS place FROM a), b AS (SELECT p.k, place, arg_min(id, {'n': s - e, 'id': id}) AS id FROM p JOIN a ON a.k = p.k AND place BETWEEN s AND e GROUP BY 1, 2)
SELECT k, id, count(*) AS n FROM b GROUP BY 1, 2""")
def painted_subjects(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        key("l_suppkey").alias("k"), (key("l_orderkey") * 10 + key("l_linenumber")).alias("id"), key("l_partkey").alias("s"), (key("l_partkey") + key("l_quantity").cast("long")).alias("e")
    )
    return N.painted(rows, "k", "s", "e", "id", 50).groupBy("k", "id").agg(F.sum(key("e") - key("s") + 1).alias("n"))


#: Lines of a supplier as pieces, most of them found on a contig at their rank by part.
_PIECES = """x AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS piece, CASE WHEN l_tax > 0.01 THEN l_partkey % 4 END AS contig, l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem),
y AS (SELECT *, row_number() OVER (PARTITION BY k, contig ORDER BY l_orderkey // 40, l_partkey, l_orderkey, l_linenumber, l_extendedprice) - 1 AS node, count(*) OVER (PARTITION BY k, contig) - 1 AS last FROM x)"""


def _pieces(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"]
    rows = dealt(t.lineitem.select(key("l_suppkey").alias("k"), *columns), ["k"], t.lineitem.count())
    x = rows.withColumn("piece", F.row_number().over(w)).withColumn("contig", F.when(key("l_tax") > 0.01, key("l_partkey") % 4))
    own = Window.partitionBy("k", "contig")
    order = own.orderBy(F.floor(key("l_orderkey") / 40), "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return x.select("k", "piece", "contig", (F.row_number().over(order) - 1).alias("node"), (F.count("*").over(own) - 1).alias("last"), (1 - key("l_discount")).alias("identity"))


@query(f"""WITH {_PIECES}, f AS (SELECT *, lag(contig) OVER w AS pc, lag(node) OVER w AS pn, lag(node IN (0, last)) OVER w AS pe, lead(contig) OVER w AS nc, lead(node) OVER w AS nn, lead(node IN (0, last)) OVER w AS ne
  FROM y WHERE contig IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY piece)),
o AS (SELECT k, piece, (pc IS NULL OR (pc = contig AND abs(pn - node) = 1) OR (pe AND node IN (0, last))) AND (nc IS NULL OR (nc = contig AND abs(nn - node) = 1) OR (ne AND node IN (0, last))) AS ordered FROM f)
SELECT k, avg((contig IS NOT NULL AND 1 - l_discount >= 0.95)::INT) AS found, avg(coalesce(ordered, FALSE)::INT) AS ordered FROM y LEFT JOIN o USING (k, piece) GROUP BY 1""")
def pieces_found_and_ordered(t: Tables) -> DataFrame:
    return N.found_and_ordered(_pieces(t), "k", 0.95)


@query(f"""WITH {_PIECES}, f AS (SELECT k, piece, contig, node, last FROM y WHERE contig IS NOT NULL),
c AS (SELECT * FROM f UNION SELECT k, piece, contig, last - node, last FROM f WHERE contig = 0 AND last > 0 AND piece % 3 = 0
  AND NOT EXISTS (SELECT 1 FROM f x WHERE x.k = f.k AND x.piece = f.piece AND x.contig = f.contig AND x.node = f.last - f.node)),
n AS (SELECT *, count(*) OVER (PARTITION BY k, piece) AS n FROM c),
s AS (SELECT n.k, n.piece, n.contig, n.node, coalesce(sum(CASE WHEN o.contig = n.contig AND abs(o.node - n.node) = 1 THEN 3 WHEN o.node IN (0, o.last) AND n.node IN (0, n.last) THEN 1 ELSE 0 END), 0) AS score
  FROM n LEFT JOIN n o ON o.k = n.k AND o.n = 1 AND abs(o.piece - n.piece) = 1 GROUP BY ALL)
SELECT k, piece, contig, node FROM s QUALIFY row_number() OVER (PARTITION BY k, piece ORDER BY score DESC, contig, node) = 1""")
def chosen_placements(t: Tables) -> DataFrame:
    """Pieces with a placement, every third of those on contig 0 with another at the contig's other end: one is chosen."""
    found = _pieces(t).filter("contig IS NOT NULL").select("k", "piece", "contig", "node", "last")
    more = found.filter("contig = 0 AND last > 0 AND piece % 3 = 0").withColumn("node", key("last") - key("node")).join(
        found.select("k", "piece", "contig", "node"), ["k", "piece", "contig", "node"], "left_anti"
    )
    return N.chosen_placements(found.unionByName(more.select(*found.columns)), "k")


@query("""WITH s AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 'A' ELSE 'T' END), '') AS s FROM embeddings),
u AS (SELECT s, min(vec_id) AS k FROM s GROUP BY 1),
d AS (SELECT a.k AS a, b.k AS b, hamming(a.s, b.s)::INT AS distance FROM u a JOIN u b ON a.k < b.k) SELECT a, b, distance FROM d WHERE distance <= 18""")
def hamming_pairs(t: Tables) -> DataFrame:
    """Pairs of different sign patterns that differ in at most 18 of all dimensions, by their least rows."""
    return N.near_pairs(_signs(t), "vec_id", "s", 64, 18)


def _signs(t: Tables) -> DataFrame:
    letters = F.transform("embedding", lambda x: F.when(x >= 0, "A").otherwise("T"))
    return t.embeddings.select("vec_id", F.array_join(letters, "").alias("s"))


@query("""WITH s AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 'A' ELSE 'T' END), '') AS s FROM embeddings)
SELECT vec_id, min(vec_id) OVER (PARTITION BY s) AS "group", count(*) OVER (PARTITION BY s) AS n FROM s""")
def indistinguishable_groups(t: Tables) -> DataFrame:
    return N.same_strings(_signs(t), "vec_id", "s")


@query("""SELECT c_custkey, 'x [n' || c_nationkey || '] y' AS name, substr(c_name, 3, 6) AS seq FROM customer WHERE c_nationkey % 2 = 0""")
def alignment_rows_by_name(t: Tables) -> DataFrame:
    msa = t.customer.select("c_custkey", _say("x [n", key("c_nationkey"), "] y").alias("name"), key("c_name").alias("seq"))
    names = t.nation.filter("n_nationkey % 2 = 0").select(_say("n", key("n_nationkey")).alias("genome"))
    return N.columns_between(N.rows_named(msa, "name", names), "seq", 2, 8).drop("genome")


@query("""SELECT o_orderkey, repeat('A', o_orderkey::INT % 9) || repeat('N', o_custkey::INT % 30) || repeat('C', 4) AS mask, CASE WHEN o_custkey % 30 > 0 THEN o_orderkey::INT % 9 END AS start,
CASE WHEN o_custkey % 30 > 0 THEN o_orderkey::INT % 9 + o_custkey::INT % 30 END AS stop FROM orders""")
def primer_spans(t: Tables) -> DataFrame:
    mask = Q.primer_mask(F.repeat(F.lit("A"), (key("o_orderkey") % 9).cast("int")), (key("o_custkey") % 30).cast("int"), F.lit("CCCC"))
    span = Q.primer_span(mask)
    return t.orders.select("o_orderkey", mask.alias("mask"), span["start"].alias("start"), span["end"].alias("stop"))
