"""More queries that write a format's files from the driver's tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.functions import sequences as Q, text as X
from seqloom.operators import reads as R
from seqloom.sources import records, sinks, tables as S

from .formats import _path, _say, _tabbed, _written
from .registry import Tables, query

key = F.col


@query("""SELECT s_name AS name, (s_suppkey % 40)::INT AS markers, (s_suppkey % 3)::INT AS duplicated, 'k__R' || n_regionkey || ';p__' || n_name AS taxonomy FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 40 >= 10
UNION ALL SELECT c_name, NULL, NULL, 'k__' || c_mktsegment FROM customer""")
def tree_genomes(t: Tables) -> DataFrame:
    """Genomes placed in a tree with enough markers, and its references."""
    placed = t.supplier.join(t.nation, key("s_nationkey") == key("n_nationkey"))
    lines = placed.select(_tabbed("s_name", key("s_suppkey") % 40, key("s_suppkey") % 3, _say("k__R", key("n_regionkey"), ";p__", key("n_name"))))
    path = _path(t, "tree_qa")
    header = "Bin Id\t# unique markers\t# multi-copy\tTaxonomy"
    lines.select(F.split("value", "\t").alias("f")).select(*[F.get("f", i).alias(h) for i, h in enumerate(header.split("\t"))]).write.csv(path, sep="\t", header=True, quote="")
    references = t.customer.select(_tabbed("c_name", _say("k__", key("c_mktsegment"))))
    asked = S.tree_places(t.spark, path).filter("markers >= 10")
    return asked.unionByName(S.reference_places(t.spark, _written(t, references, "checkm_ref")), allowMissingColumns=True)


@query("SELECT p_brand AS cluster, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) GROUP BY 1")
def listed_clusters(t: Tables) -> DataFrame:
    listed = t.part.filter("p_size > 48").select("p_brand").distinct().union(t.region.limit(1).select(F.lit("")))
    clusters = S.cluster_list(t.spark, _written(t, listed, "clusters"))
    return t.part.select(key("p_brand").alias("cluster")).join(clusters, "cluster", "left_semi").groupBy("cluster").agg(F.count("*").alias("n"))


@query("""SELECT s_name AS entry, 'size' AS column, s_suppkey::DOUBLE AS value, s_suppkey::VARCHAR AS text FROM supplier UNION ALL
SELECT s_name, 'place', NULL, 'n' || s_nationkey FROM supplier""")
def trait_tables(t: Tables) -> DataFrame:
    path = _path(t, "traits")
    rows = t.supplier.select(key("s_name").alias("entry"), key("s_suppkey").alias("size"), _say("n", key("s_nationkey")).alias("place"))
    rows.coalesce(1).write.csv(path, sep="\t", header=True, quote="")
    return S.trait_matrix(t.spark, path)


@query("""SELECT n_name AS lineage, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey % 4 END::INT AS n, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'K' || n_nationkey END AS first FROM nation""")
def kos_of_lineages(t: Tables) -> DataFrame:
    n = key("n_nationkey")
    kos = F.array_join(F.transform(F.sequence(F.lit(1), n % 4), lambda i: _say("K", n + i - 1)), ";")
    path = _path(t, "lineage-kos")
    t.nation.select(key("n_name").alias("lineage"), F.when(n % 4 > 0, kos).alias("kos")).coalesce(1).write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return S.lineage_kos(t.spark, path).select("lineage", F.size("kos").alias("n"), F.get("kos", 0).alias("first"))


@query("""SELECT 'c' || c_custkey AS id, (c_custkey % 50 + 1)::INT AS n FROM customer""")
def records_by_extension(t: Tables) -> DataFrame:
    """FASTA files of a folder that also holds others, which the extension leaves out."""
    path = _path(t, "folder")
    rows = t.customer.select(_say(">c", key("c_custkey"), "\n", F.repeat(F.lit("A"), (key("c_custkey") % 50 + 1).cast("int"))).alias("value"))
    rows.write.text(path)
    rows.write.mode("append").option("compression", "gzip").text(path)  # the same records as .gz: left out
    records.register(t.spark)
    found = t.spark.read.format("records").option("kind", "fasta").option("extensions", "txt").load(path)
    return found.select("id", F.char_length("seq").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DOUBLE END AS number FROM orders""")
def guessed_numbers(t: Tables) -> DataFrame:
    text = F.when(key("o_orderkey") % 3 > 0, key("o_totalprice").cast("string")).otherwise(_say("n", key("o_totalprice")))
    return t.orders.select("o_orderkey", X.guessed_number(text).alias("number"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey % 900 AS s, l_partkey % 900 + l_quantity::INT AS e FROM lineitem),
l AS (SELECT *, greatest(0, least(floor((s + e - 50) / 2)::INT, 950)) AS low FROM w) SELECT l_orderkey, l_linenumber, low AS start, least(low + 50, 1000)::INT AS "end" FROM l""")
def centred_windows(t: Tables) -> DataFrame:
    start = (key("l_partkey") % 900).cast("int")
    window = Q.centred_window(start, start + key("l_quantity").cast("int"), F.lit(1000))
    return t.lineitem.select("l_orderkey", "l_linenumber", window["start"].alias("start"), window["end"].alias("end"))


@query("""SELECT c_custkey, c_custkey % 3 < 2 AS same FROM customer""")
def names_spelt_alike(t: Tables) -> DataFrame:
    """Customers' names against themselves, with a letter more, or turned round."""
    name = key("c_name")
    kind = key("c_custkey") % 3
    other = F.when(kind == 0, name).when(kind == 1, F.concat(name, F.lit("x"))).otherwise(F.reverse(name))
    return t.customer.select("c_custkey", X.same_tax(name, other).alias("same"))


@query("""SELECT DISTINCT 'PF' || c_nationkey AS subject, 'q' || c_custkey % 300 AS query FROM customer WHERE c_custkey % 2 = 0""")
def pfams_of_queries(t: Tables) -> DataFrame:
    """Each query's Pfam entries once, of hits of several sources in a file with sequences behind the table."""
    n, q = key("c_nationkey"), _say("q", key("c_custkey") % 300)
    source = F.when(key("c_custkey") % 2 == 0, "Pfam").otherwise("PANTHER")
    row = lambda kind, start, end, score, attributes: _tabbed(q, source, F.lit(kind), start, end, score, F.lit("+"), F.lit("."), attributes)
    query_row = row("polypeptide", F.lit(1), F.lit(200), F.lit("."), F.lit("ID=x"))
    hit = row("protein_match", n + 10, n + 150, F.lit("0.01"), _say("Name=PF", n))
    lines = t.customer.select(F.explode(F.array(query_row, hit)).alias("value"))
    return R.subjects_of(S.good_interpro_hits(S.interpro(t.spark, _written(t, lines, "pfam"))))


@query("""SELECT l_orderkey AS gene, 's' || l_suppkey AS contig, l_suppkey % 4 = 0 AS missing, CASE WHEN l_suppkey % 4 > 0 THEN substr(repeat('ACCGT', 5 + l_suppkey::INT), l_partkey % 5 + 1, 15) END AS seq FROM lineitem WHERE l_quantity > 45""")
def genes_without_contig(t: Tables) -> DataFrame:
    """Genes with their sequences, and those whose contig isn't there."""
    contigs = t.supplier.filter("s_suppkey % 4 > 0").select(_say("s", key("s_suppkey")).alias("id"), F.repeat(F.lit("ACCGT"), (5 + key("s_suppkey")).cast("int")).alias("seq"))
    start = (key("l_partkey") % 5).cast("int")
    genes = t.lineitem.filter("l_quantity > 45").select(key("l_orderkey").alias("gene"), _say("s", key("l_suppkey")).alias("contig"), start.alias("start"), (start + 15).alias("end"), F.lit(1).alias("strand"))
    found, missing = sinks.sequences_and_missing(genes, contigs)
    side = lambda df, gone, seq: df.select("gene", "contig", F.lit(gone).alias("missing"), seq.alias("seq"))
    return side(found, False, key("seq")).union(side(missing, True, F.lit(None).cast("string")))
