"""Queries that write a format's files from the driver's tables and read them back.

Files go to the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions import text as X
from seqloom.operators import domain as D, genomes as N, graph as G, hierarchy as H, reads as R, reports as P, taxonomy as T
from seqloom.sources import records, sinks, tables as S
from seqloom.storage import checkpoint_dir

from .registry import Tables, query


def _path(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(t: Tables, lines: DataFrame, name: str) -> str:
    """The lines (one string column) as text files; their path."""
    path = _path(t, name)
    lines.write.text(path)
    return path


def _tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value")


def _say(*parts) -> Column:
    """Strings and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


key = F.col

_SAM = """s AS (SELECT 'r' || l_orderkey AS qname, CASE WHEN l_suppkey % 10 = 0 THEN 77 WHEN l_linenumber % 4 = 0 THEN 83 WHEN l_linenumber % 4 = 1 THEN 99
  WHEN l_linenumber % 4 = 2 THEN 147 ELSE 163 END AS flag, CASE WHEN l_suppkey % 10 <> 0 THEN 'c' || l_suppkey END AS rname,
  l_partkey * 10 + l_linenumber AS pos, l_quantity::INT AS mapq, 100 + l_linenumber * 12 AS n, CASE WHEN l_tax > 0 THEN (l_orderkey + l_linenumber) % 3 END AS nm FROM lineitem)"""


def _sam(t: Tables) -> DataFrame:
    """Lines of lineitem as alignments, by way of SAM files with a header."""
    line = key("l_linenumber")
    flag = (
        F.when(key("l_suppkey") % 10 == 0, 77).when(line % 4 == 0, 83).when(line % 4 == 1, 99).when(line % 4 == 2, 147).otherwise(163)
    )
    seq = F.repeat(F.lit("A"), 100 + line * 12)
    rname = F.when(key("l_suppkey") % 10 == 0, "*").otherwise(_say("c", key("l_suppkey")))
    lines = t.lineitem.select(
        _tabbed(
            _say("r", key("l_orderkey")), flag, rname, key("l_partkey") * 10 + line, key("l_quantity").cast("int"), F.lit("100M"),
            F.lit("*"), F.lit(0), F.lit(0), seq, F.lit("*"), F.when(key("l_tax") > 0, _say("NM:i:", (key("l_orderkey") + line) % 3)),
        )
    )
    header = t.supplier.select(_say("@SQ\tSN:c", key("s_suppkey"), "\tLN:", key("s_suppkey") * 100).alias("value"))
    return S.sam(t.spark, _written(t, header.union(lines), "sam"))


@query(f"WITH {_SAM} SELECT qname, flag, rname, pos, mapq FROM s WHERE flag IN (83, 99) AND n >= 145 AND nm <= 0 AND mapq >= 30")
def sam_passing_reads(t: Tables) -> DataFrame:
    return R.passing_reads(_sam(t)).select("qname", "flag", "rname", "pos", "mapq")


@query(f"WITH {_SAM} SELECT flag, count(*) AS n, flag = 77 AS unmapped FROM s GROUP BY 1")
def sam_flag_counts(t: Tables) -> DataFrame:
    return R.flag_counts(_sam(t))


@query("SELECT 'c' || s_suppkey AS name, s_suppkey * 100 AS length FROM supplier")
def sam_header_lengths(t: Tables) -> DataFrame:
    lines = t.supplier.select(_say("@SQ\tSN:c", key("s_suppkey"), "\tLN:", key("s_suppkey") * 100).alias("value"))
    return S.sam_headers(t.spark, _written(t, lines, "sam-header"))


@query(f"""WITH {_SAM}, b AS (SELECT 'c' || s_suppkey AS contig, 'bin' || s_suppkey % 3 AS bin FROM supplier
  UNION ALL SELECT 'c' || s_suppkey, 'other' FROM supplier WHERE s_suppkey % 5 = 1),
h AS (SELECT DISTINCT bin, qname FROM s JOIN b ON rname = contig),
p AS (SELECT qname, arg_min(n, pos) FILTER (flag & 64 > 0) AS n_first, arg_min(n, pos) FILTER (flag & 128 > 0) AS n_second FROM s GROUP BY 1)
SELECT bin, qname, n_first::INT AS n_first, n_second::INT AS n_second FROM h JOIN p USING (qname)""")
def sam_pairs_by_bin(t: Tables) -> DataFrame:
    contig = _say("c", key("s_suppkey")).alias("contig")
    bins = t.supplier.select(contig, _say("bin", key("s_suppkey") % 3).alias("bin")).union(
        t.supplier.filter("s_suppkey % 5 = 1").select(contig, F.lit("other"))
    )
    n = lambda m: F.char_length(f"{m}.seq").alias(f"n_{m}")
    return R.pairs_by_bin(_sam(t), bins, "pos").select("bin", "qname", n("first"), n("second"))


_BLAST = """b AS (SELECT 'q' || l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place, 's' || l_partkey AS subject, 88 + l_linenumber * 2 AS perc_id,
  l_quantity::INT * 40 AS length, l_partkey % 11 AS taxid, l_suppkey AS bitscore FROM lineitem)"""


def _blast(t: Tables) -> str:
    lines = t.lineitem.repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").select(
        _tabbed(
            _say("q", key("l_orderkey")), _say("s", key("l_partkey")), 88 + key("l_linenumber") * 2, key("l_quantity").cast("int") * 40,
            F.lit(1), F.lit(0), F.lit(1), F.lit(100), F.lit(5), F.lit(104), F.lit("1e-20"), key("l_suppkey"),
            _say(key("l_suppkey"), ";", key("l_partkey") % 11),
        )
    )
    return _written(t, lines, "blast6")


@query(f"""WITH {_BLAST} SELECT query, subject, taxid::VARCHAR AS taxid FROM b WHERE length >= 800 AND perc_id >= 90
QUALIFY row_number() OVER (PARTITION BY query ORDER BY place) = 1""")
def blast_first_assignments(t: Tables) -> DataFrame:
    hits = S.first_assignments(t.spark, _blast(t), 800, 90)
    return hits.select("query", "subject", R.last_listed(key("staxids")).alias("taxid"))


@query(f"WITH {_BLAST} SELECT taxid::VARCHAR AS taxid, count(*) AS n, sum(length)::BIGINT AS total FROM b GROUP BY 1")
def blast_taxid_totals(t: Tables) -> DataFrame:
    return R.taxid_totals(S.blast6(t.spark, _blast(t), staxids=True), "staxids", "length")


@query(f"""WITH {_BLAST}, a AS (SELECT subject, sum(length) AS every FROM b GROUP BY 1)
SELECT subject, query AS isolate, count(*) AS n, sum(length)::BIGINT AS total, sum(length) > any_value(every) / 2 AS major
FROM b JOIN a USING (subject) WHERE perc_id >= 95 AND length >= 1000 GROUP BY 1, 2""")
def blast_isolate_totals(t: Tables) -> DataFrame:
    hits = S.blast6(t.spark, _blast(t), staxids=True).withColumnRenamed("query", "isolate")
    return R.isolate_totals(hits, "subject", "isolate", "length", (key("perc_id") >= 95) & (key("length") >= 1000))


@query("""SELECT 'q' || l_orderkey AS query, 's' || l_partkey AS subject, l_suppkey::DOUBLE AS bitscore, least(l_linenumber, 9) - 1 AS start,
greatest(l_linenumber, 9) AS end, CASE WHEN l_linenumber <= 9 THEN 1 ELSE -1 END AS strand, l_linenumber / (l_linenumber + 2) AS identity
FROM lineitem WHERE l_suppkey >= 3 AND l_linenumber / (l_linenumber + 2) >= 0.5 AND greatest(l_linenumber, 9) - (least(l_linenumber, 9) - 1) >= 0.05 * 100""")
def blast_xml_hits(t: Tables) -> DataFrame:
    line = key("l_linenumber")
    tag = lambda name, value: _say(f"<{name}>", value, f"</{name}>")
    pair = _say(
        "<Hsp>", tag("Hsp_bit-score", key("l_suppkey")), tag("Hsp_evalue", F.lit("1e-9")), tag("Hsp_hit-from", line), tag("Hsp_hit-to", F.lit(9)),
        tag("Hsp_midline", _say(F.repeat(F.lit("|"), line), "..")), "</Hsp>",
    )
    hit = _say("<Hit>", tag("Hit_def", _say("s", key("l_partkey"))), tag("Hit_len", F.lit(100)), "<Hit_hsps>", pair, "</Hit_hsps></Hit>")
    iteration = _say("<Iteration>", tag("Iteration_query-def", _say("q", key("l_orderkey"))), tag("Iteration_query-len", F.lit(50)), "<Iteration_hits>", hit, "</Iteration_hits></Iteration>")
    path = _path(t, "blast-xml")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    sinks.write_rooted(rows, iteration, "BlastOutput", path, "gzip")
    hits = S.blast_xml(t.spark, path)
    kept = D.filtered_hits(hits, 0.05, 3, 1e-3, 0.5)
    return kept.select("query", "subject", "bitscore", "start", "end", "strand", "identity")


_KRAKEN = """k AS (SELECT 'k' || l_orderkey || '_' || (l_linenumber * 10 + l_partkey % 5) AS name, l_suppkey % 25 AS n, l_partkey % 5 AS r, l_quantity::INT AS a, l_linenumber AS b,
  l_tax > 0.01 AS classified, l_partkey % 90 AS length FROM lineitem)"""


def _kraken(t: Tables) -> DataFrame:
    hits = _say("n", key("l_suppkey") % 25, ":", key("l_quantity").cast("int"), " r", key("l_partkey") % 5, ":", key("l_linenumber"), " A:7 world:1")
    name = _say("k", key("l_orderkey"), "_", key("l_linenumber") * 10 + key("l_partkey") % 5)
    head = [F.when(key("l_tax") > 0.01, "C").otherwise("U"), name, _say("r", key("l_partkey") % 5), key("l_partkey") % 90]
    five, six = _tabbed(*head, hits), _tabbed(*head, F.lit("P=0.5"), hits)
    lines = t.lineitem.select(F.when(key("l_orderkey") % 2 == 0, six).otherwise(five).alias("value"))
    return S.kraken(t.spark, _written(t, lines, "kraken"))


def _places(t: Tables) -> DataFrame:
    """(node, parent): nations below regions below the world."""
    nation = t.nation.select(_say("n", key("n_nationkey")).alias("node"), _say("r", key("n_regionkey")).alias("parent"))
    region = t.region.select(_say("r", key("r_regionkey")).alias("node"), F.lit("world").alias("parent"))
    root = t.spark.createDataFrame([("world", None)], "node string, parent string")
    return nation.union(region).union(root)


_CLADES = _KRAKEN + """, s AS (SELECT name, sum(b + CASE WHEN n_regionkey = r THEN a ELSE 0 END)::BIGINT AS in_clade, sum(a + b + 1)::BIGINT AS total FROM k JOIN nation ON n_nationkey = n GROUP BY 1)"""


@query(f"WITH {_CLADES} SELECT name, in_clade, total, in_clade / total AS confidence FROM s")
def kraken_confidence(t: Tables) -> DataFrame:
    return D.clade_confidence(_kraken(t), H.closure(_places(t), "node", "parent"))


@query(f"""WITH {_CLADES} SELECT name, CASE WHEN r < 4 THEN 'k__' || r ELSE 'unclassified' END AS lineage,
  CASE WHEN r < 4 THEN in_clade || '/' || total ELSE '0/0' END AS confidence FROM k JOIN s USING (name)""")
def kraken_confidence_table(t: Tables) -> DataFrame:
    reads = _kraken(t)
    lineage = t.region.filter("r_regionkey < 4").select(_say("r", key("r_regionkey")).alias("taxid"), _say("k__", key("r_regionkey")).alias("lineage"))
    return T.confidence_table(reads.select("name", "taxid"), D.clade_confidence(reads, H.closure(_places(t), "node", "parent")), lineage)


@query(f"""WITH {_KRAKEN} SELECT CASE WHEN classified THEN 'r' || r ELSE 'unclassified' END AS taxid, count(*) AS n, avg(length) AS mean_length FROM k GROUP BY 1""")
def kraken_class_lengths(t: Tables) -> DataFrame:
    return R.class_lengths(_kraken(t), "taxid", "classified", "length")


@query(f"""WITH {_KRAKEN} SELECT split_part(name, '_', 1) AS read, arg_min('r' || r, {{'c': NOT classified, 'b': b * 10 + r}}) AS taxid FROM k GROUP BY 1""")
def kraken_first_class(t: Tables) -> DataFrame:
    rows = _kraken(t).withColumn("read", F.split("name", "_")[0]).withColumn("b", F.split("name", "_")[1].cast("int"))
    return R.first_class(rows, "read", "taxid", "classified", "b")


@query("""SELECT 's' || l_suppkey AS seqid, l_partkey - 1 AS start, l_partkey + l_quantity::INT AS end, 'g' || l_orderkey AS id FROM lineitem WHERE l_linenumber % 2 = 0""")
def gff_named_features(t: Tables) -> DataFrame:
    name = F.when(key("l_linenumber") % 2 == 0, "16S_rRNA").otherwise("23S_rRNA")
    lines = t.lineitem.select(
        _tabbed(
            _say("s", key("l_suppkey")), F.lit("x"), F.lit("rRNA"), key("l_partkey"), key("l_partkey") + key("l_quantity").cast("int"), F.lit("0.1"), F.lit("+"), F.lit("."),
            _say("ID=g", key("l_orderkey"), ";Name=", name, ";Name=again"),
        )
    )
    comment = t.region.limit(1).select(F.lit("##gff-version 3").alias("value"))
    found = S.gff(t.spark, _written(t, comment.union(lines), "gff")).filter("attributes['Name'] = '16S_rRNA'")
    return found.select("seqid", "start", "end", key("attributes")["ID"].alias("id"))


@query("""WITH d AS (SELECT 'c' || l_suppkey AS contig, l_quantity::INT AS cov FROM lineitem)
SELECT contig, avg(cov) AS mean, median(cov) AS median, count(*) AS n FROM d GROUP BY 1""")
def depth_statistics(t: Tables) -> DataFrame:
    lines = t.lineitem.select(_tabbed(_say("c", key("l_suppkey")), "l_partkey", key("l_quantity").cast("int")))
    rows = S.depth(t.spark, _written(t, lines, "depth"))
    return rows.groupBy("contig").agg(F.avg("cov").alias("mean"), F.median("cov").alias("median"), F.count("*").alias("n"))


@query("""SELECT 'bin' || s_suppkey AS name, (s_suppkey % 7)::INT AS missing, (s_suppkey % 50)::INT AS once, 's' || s_nationkey AS lineage FROM supplier""")
def checkm_marker_counts(t: Tables) -> DataFrame:
    lines = t.supplier.select(
        _tabbed(
            _say("bin", key("s_suppkey")),
            _say("{'0': ", key("s_suppkey") % 7, ", '1': ", key("s_suppkey") % 50, ", 'marker lineage': 's", key("s_nationkey"), "'}"),
        )
    )
    value = lambda k: F.col("values")[k]
    return S.checkm(t.spark, _written(t, lines, "checkm")).select(
        "name", value("0").cast("int").alias("missing"), value("1").cast("int").alias("once"), value("marker lineage").alias("lineage")
    )


def _matrix(t: Tables, cell: Column, name: str) -> str:
    """A square table of regions, a tab-separated file with a header."""
    names = t.region.select(_say("g", key("r_regionkey")).alias("reference"), key("r_regionkey").alias("b"))
    pairs = t.nation.select(_say("g", key("n_regionkey")).alias("query"), key("n_regionkey").alias("a")).distinct()
    labels = [f"g{i}" for i in range(5)]
    long = pairs.withColumn("b", F.explode(F.array(*map(F.lit, range(5))))).join(names, "b").select("query", "reference", cell.alias("cell"))
    path = _path(t, name)
    sinks.write_tsv(sinks.wide(long, "query", "reference", "cell", labels).coalesce(1), path)
    return path


@query("""SELECT 'g' || a AS query, 'g' || b AS reference, (a * 10 + b) / 100 AS ani, (a + b * 10) / 100 AS af
FROM range(5) x(a), range(5) y(b) WHERE a <> b""")
def tuple_matrix_pairs(t: Tables) -> DataFrame:
    cell = _say("(", (key("a") * 10 + key("b")) / 100, ", ", (key("a") + key("b") * 10) / 100, ")")
    return S.tuple_matrix(t.spark, _matrix(t, cell, "tuples"))


@query("""SELECT 'g' || a AS row, 'g' || b AS "column", CASE WHEN a <> b THEN (a * 10 + b)::DOUBLE END AS value FROM range(5) x(a), range(5) y(b)""")
def wide_matrix_cells(t: Tables) -> DataFrame:
    cell = F.when(key("a") != key("b"), (key("a") * 10 + key("b")).cast("string"))
    return S.wide_matrix(t.spark, _matrix(t, cell, "matrix")).select("row", "column", "value")


@query("""WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)
SELECT 'd' || doc_id AS id, length(seq) AS length, md5(seq) AS digest FROM d""")
def fasta_records(t: Tables) -> DataFrame:
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    wrapped = F.regexp_replace(seq, "(.{60})", "$1\n")
    path = _path(t, "fasta")
    sinks.write_records(t.documents, sinks.fasta_record(_say("d", key("doc_id"), " a document"), wrapped), path)
    records.register(t.spark)
    found = t.spark.read.format("records").option("kind", "fasta").option("split_bytes", 1 << 20).load(path)
    return found.select("id", F.char_length("seq").cast("long").alias("length"), F.md5(F.encode("seq", "UTF-8")).alias("digest"))


@query("""SELECT 'l' || l_orderkey || '_' || l_linenumber AS id, l_returnflag || l_linestatus AS seq, '@+' AS qual FROM lineitem""")
def fastq_records(t: Tables) -> DataFrame:
    path = _path(t, "fastq")
    record = sinks.fastq_record(_say("l", key("l_orderkey"), "_", key("l_linenumber")), F.concat("l_returnflag", "l_linestatus"), F.lit("@+"))
    sinks.write_records(t.lineitem, record, path)
    records.register(t.spark)
    return t.spark.read.format("records").option("kind", "fastq").option("split_bytes", 1 << 18).load(path).select("id", "seq", "qual")


@query("SELECT count(*) AS n FROM lineitem")
def fastq_record_count(t: Tables) -> DataFrame:
    """Sequences of compressed FASTA files, counted file by file."""
    path = _path(t, "fasta-count")
    record = sinks.fasta_record(_say("l", key("l_orderkey")), key("l_returnflag"))
    t.lineitem.select(record.alias("value")).write.option("compression", "gzip").text(path)
    return S.record_counts(t.spark, path).agg(F.sum("n").alias("n"))


@query("""SELECT 'n' || n_nationkey AS taxid, 'r' || n_regionkey AS parent, 'nation' AS rank, n_name AS name FROM nation UNION ALL
SELECT 'r' || r_regionkey, NULL, 'region', r_name FROM region""")
def ncbi_nodes(t: Tables) -> DataFrame:
    bar = "\t|\t"
    named = t.nation.select(_say("n", key("n_nationkey")).alias("id"), key("n_name").alias("name")).union(t.region.select(_say("r", key("r_regionkey")), "r_name"))
    names = named.select(_say(key("id"), bar, key("name"), bar, bar, "scientific name\t|").alias("value")).union(
        named.select(_say(key("id"), bar, "other ", key("name"), bar, bar, "synonym\t|"))
    )
    nodes = t.nation.select(_say("n", key("n_nationkey"), bar, "r", key("n_regionkey"), bar, "nation\t|").alias("value")).union(
        t.region.select(_say("r", key("r_regionkey"), bar, "r", key("r_regionkey"), bar, "region\t|"))
    )
    return S.ncbi_taxonomy(t.spark, _written(t, names, "names"), _written(t, nodes, "nodes"))


@query("""SELECT 'K' || n_nationkey AS id, n_name AS description, CASE WHEN n_nationkey % 2 = 0 THEN r_name || ';sub ' || n_regionkey || ';leaf|zz;yy;xx' ELSE r_name || ';sub ' || n_regionkey || ';leaf' END AS pathways
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def kegg_pathway_chains(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, key("n_regionkey") == key("r_regionkey"))
    heads = F.array(
        F.struct(F.lit(1).alias("n"), _say("A<b>", key("r_name"), "</b>").alias("line")),
        F.struct(F.lit(2).alias("n"), _say("B  sub ", key("r_regionkey")).alias("line")),
        F.struct(F.lit(3).alias("n"), F.lit("C    leaf [PATH:ko00010]").alias("line")),
    )
    regions = t.region.select(key("r_regionkey").alias("g"), F.lit(-1).alias("m"), F.explode(heads).alias("h")).select("g", "m", "h.n", "h.line")
    entry = _say("D      K", key("n_nationkey"), "  ", key("n_name"))
    entries = places.select(key("n_regionkey").alias("g"), key("n_nationkey").alias("m"), F.lit(4).alias("n"), entry.alias("line"))
    tail = t.region.limit(1).select(F.lit(9).alias("g"), F.lit(-1).alias("m"), F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("line")) for n, x in ((1, "A<b>zz</b>"), (2, "B  yy"), (3, "C    xx"))])).alias("h")).select("g", "m", "h.n", "h.line")
    again = places.filter("n_nationkey % 2 = 0").select(F.lit(9).alias("g"), key("n_nationkey").alias("m"), F.lit(4).alias("n"), entry.alias("line"))
    ordered = regions.union(entries).union(tail).union(again).repartition(1).sortWithinPartitions("g", "m", "n")
    return S.ko_pathways(S.kegg_htext(t.spark, _written(t, ordered.select("line"), "htext")))


@query("""SELECT r_name || ';' || n_name AS function, 'K' || c_custkey AS ko FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'x;y', 'K' || c_custkey FROM customer WHERE c_custkey % 2 = 0""")
def ko_functions_by_level(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, key("c_nationkey") == key("n_nationkey")).join(t.region, key("n_regionkey") == key("r_regionkey"))
    chain = _say(key("r_name"), ";", key("n_name"), ";", key("c_mktsegment"))
    chains = F.when(key("c_custkey") % 2 == 0, _say(chain, "|x;y;z")).otherwise(chain)
    path = _path(t, "ko-metadata")
    sinks.write_tsv(joined.select(_say("K", key("c_custkey")).alias("KO"), key("c_name").alias("Description"), chains.alias("Pathways")), path)
    return S.ko_functions(t.spark, path, 2)


@query("""WITH c AS (SELECT r.r_name, s_nationkey AS k, count(*)::DOUBLE AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT 'K1' AS ko, coalesce(sum(n) FILTER (k = 1), 0) AS n FROM c UNION ALL SELECT 'K2', coalesce(sum(n) FILTER (k = 2), 0) FROM c
UNION ALL SELECT 'K99', 0 UNION ALL SELECT 'misses', coalesce(sum(n) FILTER (k NOT IN (1, 2)), 0) FROM c""")
def ko_trait_table(t: Tables) -> DataFrame:
    counts = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    path = _written(t, counts.select(_tabbed(_say("KO:K", key("s_nationkey")), F.lit("a function"), "n")), "ko-counts")
    kos = ["K1", "K2", "K99"]
    rows = S.ko_counts(t.spark, path).withColumn("genome", F.lit("g"))
    listed, _ = P.trait_table(rows, "genome", "ko", kos)
    total = lambda df, c, name: df.agg(F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias("n")).select(F.lit(name).alias("ko"), "n")
    outside = rows.filter(~key("ko").isin(kos))
    out = total(outside, "n", "misses")
    for ko in kos:
        out = out.union(total(listed, ko, ko))
    return out


@query("""SELECT 'H' || n_nationkey AS name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def hmm_hit_counts(t: Tables) -> DataFrame:
    models = t.nation.select(F.explode(F.array(F.lit("HMMER3/f"), _say("NAME  H", key("n_nationkey")))).alias("value"))
    hits = t.supplier.select(_say("H", key("s_nationkey"), "   -   q", key("s_suppkey"), "  1e-5").alias("value"))
    comment = t.region.select(_say("# ", key("r_name")).alias("value"))
    names = S.hmm_names(t.spark, _written(t, models, "hmm"))
    return R.hit_counts(names, S.hmm_hits(t.spark, _written(t, comment.union(hits), "tblout")), "name")


@query("""SELECT coalesce('b' || s_nationkey, 'unbinned') AS bin, sum(c.n)::BIGINT AS length FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) c
LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = k GROUP BY 1""")
def contig_bin_lengths(t: Tables) -> DataFrame:
    bins = t.supplier.filter("s_suppkey % 4 <> 0").select(_say("c", key("s_suppkey"), ",b", key("s_nationkey")).alias("value"))
    table = S.contig_bins(t.spark, _written(t, bins, "bins"))
    lengths = t.lineitem.groupBy(_say("c", key("l_suppkey")).alias("contig")).agg(F.count("*").alias("n"))
    return lengths.join(table, "contig", "left").groupBy(F.coalesce("bin", F.lit("unbinned")).alias("bin")).agg(F.sum("n").alias("length"))


@query("""SELECT 'a' || p_size AS annotation, floor(sum(p_retailprice::DECIMAL(18,2)))::BIGINT AS total FROM part GROUP BY 1""")
def coverage_by_annotation(t: Tables) -> DataFrame:
    lines = t.part.select(_tabbed(_say("p", key("p_partkey"), " more"), key("p_retailprice").cast("decimal(18,2)")))
    head = t.region.limit(1).select(F.lit("#ID\tAvg_fold").alias("value"))
    stats = S.coverage_stats(t.spark, _written(t, head.union(lines), "covstats")).withColumn("avg_fold", key("avg_fold").cast("decimal(18,2)"))
    names = t.part.select(_say("p", key("p_partkey")).alias("contig"), _say("a", key("p_size")).alias("annotation"))
    return R.annotation_coverage(stats, "contig", "avg_fold", names)


@query("""SELECT 'c' || c_custkey AS contig, c_nationkey AS length, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 0 END AS score FROM customer""")
def plasmid_predictions(t: Tables) -> DataFrame:
    said = F.when(key("c_custkey") % 3 == 0, "Plasmid").when(key("c_custkey") % 3 == 1, "Chromosome").otherwise("None")
    head = t.region.limit(1).select(F.lit("#SeqID\tLength\tPrediction").alias("value"))
    lines = t.customer.select(_tabbed(_say("c", key("c_custkey")), "c_nationkey", said))
    return S.predictions(t.spark, _written(t, head.union(lines), "predictions")).select("contig", "length", "score")


@query("""SELECT c_custkey::INT AS instance, CASE WHEN c_acctbal > 0 THEN 'Positive' ELSE 'Negative' END AS actual, 'Negative' AS predicted, 0.75::DOUBLE AS confidence FROM customer""")
def classifier_output(t: Tables) -> DataFrame:
    tag = F.when(key("c_acctbal") > 0, "1:Positive").otherwise("2:Negative")
    lines = t.customer.select(_say("  ", key("c_custkey"), "  ", tag, "  2:Negative  +  0.75").alias("value"))
    return S.classifier_results(t.spark, _written(t, lines, "weka"))


@query("""SELECT 'q' || c_custkey AS query, 'PF' || c_nationkey AS subject, (c_nationkey + 10)::INT AS start FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey >= 5 AND 90 >= 0.5 * (99 + c_nationkey)""")
def interpro_hits(t: Tables) -> DataFrame:
    row = lambda kind, start, end, score, attributes: _tabbed(_say("q", key("c_custkey")), F.lit("Pfam"), F.lit(kind), start, end, score, F.lit("+"), F.lit("."), attributes)
    n = key("c_nationkey")
    query_row = row("polypeptide", F.lit(1), 100 + n, F.lit("."), F.lit("ID=x"))
    hit = row("protein_match", n + 10, n + 100, F.when(n >= 5, "0.01").otherwise("0.5"), _say('Name=PF', n, ';Ontology_term="GO:1","GO:', n, '"'))
    stray = t.customer.filter("c_custkey % 10 = 0").select(hit)
    lines = t.customer.filter("c_custkey % 10 <> 0").select(F.explode(F.array(query_row, hit)).alias("value"))
    return S.good_interpro_hits(S.interpro(t.spark, _written(t, lines.union(stray), "interpro"))).select("query", "subject", "start")


@query("""SELECT 'GO:' || c_nationkey AS term, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'GO:x', count(*) FROM customer""")
def term_hit_counts(t: Tables) -> DataFrame:
    rows = t.customer.select(_say("GO:x|GO:", key("c_nationkey"), "|GO:x").alias("terms"))
    return R.term_counts(rows, "terms")


@query("""SELECT 'f' || r_regionkey || '/s/' || n_name AS path, n_nationkey::VARCHAR AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name >= 'NATION_1'
AND regexp_matches('f' || r_regionkey, '^f[0-3]')""")
def folder_tree_files(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, key("n_regionkey") == key("r_regionkey"))
    file = _say('<file filename="', key("n_name"), '" id="', key("n_nationkey"), '"/>')
    folders = places.groupBy("r_regionkey").agg(F.array_join(F.sort_array(F.collect_list(file)), "").alias("files"))
    text = folders.select(_say('<organismDownloads><folder name="f', key("r_regionkey"), '"><folder name="s">', key("files"), "</folder></folder></organismDownloads>").alias("value"))
    path = _path(t, "folders")
    text.repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    found = S.folder_tree(t.spark, path).filter(X.path_matches(key("path"), "f[0-3]/s/.*")).filter(F.element_at(F.split("path", "/"), -1) >= "NATION_1")
    return found.select("path", key("attributes")["id"].alias("id"))


@query("""SELECT c_custkey, 'n' || c_custkey AS name, c_mktsegment AS segment FROM customer""")
def html_key_values(t: Tables) -> DataFrame:
    page = _say("<table><tr><th>Name</th><td><b>n", key("c_custkey"), "</b></td></tr><tr><th>Segment </th>\n<td> ", key("c_mktsegment"), "</td></tr><tr><th>Name</th><td>other</td></tr></table>")
    found = t.customer.select("c_custkey", S.html_table(page).alias("m"))
    return found.select("c_custkey", key("m")["Name"].alias("name"), key("m")["Segment"].alias("segment"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def last_statement(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("seqloom_nation")
    t.customer.createOrReplaceTempView("seqloom_customer")
    text = """CREATE OR REPLACE TEMPORARY VIEW seqloom_both AS
SELECT n_name FROM seqloom_nation JOIN seqloom_customer ON c_nationkey = n_nationkey;
SELECT n_name, count(*) AS n FROM seqloom_both GROUP BY 1;
"""
    return S.statements(t.spark, text)


def _newick(t: Tables) -> DataFrame:
    """One tree a row: regions as inner nodes, nations as leaves."""
    leaf = _say(key("n_name"), ":", key("n_nationkey") + 1)
    groups = t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(leaf)), ",").alias("leaves"))
    whole = groups.agg(F.array_join(F.sort_array(F.collect_list(_say("(", key("leaves"), ")R", key("n_regionkey"), ":", key("n_regionkey") + 100))), ",").alias("w"))
    return whole.select(F.lit(1).cast("long").alias("tree"), _say("(", key("w"), ");").alias("newick"))


@query("""WITH k AS (SELECT * FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey > 4), c AS (SELECT n_regionkey, count(*) AS c FROM k GROUP BY 1)
SELECT CASE WHEN n_nationkey = 7 THEN 'seven' ELSE n_name END AS name, CASE WHEN c = 1 THEN n_nationkey + 1 + n_regionkey + 100 ELSE n_nationkey + 1 END::DOUBLE AS length,
  CASE WHEN c = 1 THEN '' ELSE 'R' || n_regionkey END AS parent FROM k JOIN c USING (n_regionkey)
UNION ALL SELECT 'R' || n_regionkey, n_regionkey + 100, '' FROM c WHERE c > 1 UNION ALL SELECT '', NULL, NULL""")
def pruned_tree(t: Tables) -> DataFrame:
    names = t.nation.filter("n_nationkey % 6 <> 0 AND n_nationkey > 4").select(
        key("n_name").alias("name"), F.when(key("n_nationkey") == 7, "seven").alias("new_name")
    )
    left = H.pruned(G.newick_nodes(_newick(t)), names)
    parents = left.select(key("node").alias("parent"), key("name").alias("parent_name"))
    return left.join(parents, "parent", "left").select("name", "length", key("parent_name").alias("parent"))


@query("""SELECT n_name AS name, (n_nationkey + 1)::DOUBLE AS length FROM nation""")
def nexus_leaves(t: Tables) -> DataFrame:
    table = t.nation.agg(F.array_join(F.sort_array(F.collect_list(_say(key("n_nationkey") + 500, " ", key("n_name")))), ",\n").alias("table"))
    leaf = _say(key("n_nationkey") + 500, ":", key("n_nationkey") + 1)
    tree = t.nation.agg(F.array_join(F.sort_array(F.collect_list(leaf)), ",").alias("leaves"))
    text = table.join(F.broadcast(tree), F.lit(True)).select(_say("#NEXUS\nbegin trees;\ntranslate\n", key("table"), ";\ntree one = [&R] (", key("leaves"), ");\nend;").alias("value"))
    trees = S.nexus_trees(t.spark, _written(t, text, "nexus"))
    nodes = G.newick_nodes(trees.select(F.lit(1).cast("long").alias("tree"), "newick"))
    return nodes.filter("parent IS NOT NULL").select("name", "length")


@query("""SELECT n_name AS name, (n_nationkey + 1)::DOUBLE AS length, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL, '' FROM region""")
def phyloxml_clades(t: Tables) -> DataFrame:
    leaf = _say("<clade><name>", key("n_name"), "</name><branch_length>", key("n_nationkey") + 1, "</branch_length></clade>")
    groups = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(leaf), "").alias("leaves"))
    whole = groups.agg(F.array_join(F.collect_list(_say("<clade><name>R", key("n_regionkey"), "</name>", key("leaves"), "</clade>")), "").alias("w"))
    text = whole.select(_say('<phyloxml xmlns="http://www.phyloxml.org"><phylogeny><clade>', key("w"), "</clade></phylogeny></phyloxml>").alias("value"))
    nodes = S.phyloxml_nodes(t.spark, _written(t, text, "phyloxml"))
    parents = nodes.select(key("node").alias("parent"), key("name").alias("parent_name"))
    return nodes.join(parents, "parent").select("name", "length", key("parent_name").alias("parent"))


@query("""SELECT 's' || l_suppkey AS contig, l_orderkey AS gene, l_partkey % 5 * 10 AS start, md5(CASE WHEN l_linenumber % 2 = 0 THEN reverse(translate(substr(seq, l_partkey % 5 * 10 + 1, 15), 'ACGT', 'TGCA'))
  ELSE substr(seq, l_partkey % 5 * 10 + 1, 15) END) AS digest FROM lineitem JOIN (SELECT s_suppkey, repeat('ACCGT', 5 + s_suppkey::INT) AS seq FROM supplier) ON s_suppkey = l_suppkey""")
def region_slices(t: Tables) -> DataFrame:
    contigs = t.supplier.select(_say("s", key("s_suppkey")).alias("id"), F.repeat(F.lit("ACCGT"), (5 + key("s_suppkey")).cast("int")).alias("seq"))
    start = (key("l_partkey") % 5 * 10).cast("int")
    regions = t.lineitem.select(
        _say("s", key("l_suppkey")).alias("contig"), key("l_orderkey").alias("gene"), start.alias("start"), (start + 15).alias("end"),
        F.when(key("l_linenumber") % 2 == 0, -1).otherwise(1).alias("strand"),
    )
    found = sinks.region_sequences(regions, contigs)
    return found.select("contig", "gene", key("start").cast("long").alias("start"), F.md5(F.encode("seq", "UTF-8")).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, 'genome=g_' || l_suppkey || '|slice=[' || l_linenumber || ':' || l_partkey || ']' AS header, 'g_' || l_suppkey AS genome, l_linenumber AS start, l_partkey::INT AS stop FROM lineitem""")
def header_regions(t: Tables) -> DataFrame:
    slice_ = _say("[", key("l_linenumber"), ":", key("l_partkey"), "]")
    made = t.lineitem.withColumn("header", X.key_value_header(genome=_say("g_", key("l_suppkey")), slice=slice_))
    return made.withColumn("r", X.region_of_header(key("header"))).select("l_orderkey", "l_linenumber", "header", "r.genome", "r.start", "r.stop")


@query("""SELECT o_orderkey, 'NODE_' || o_custkey || '_len_' || o_orderkey || '_cov_' || o_custkey || '.5' AS name, 'NODE' AS prefix, o_orderkey::INT AS length, (o_custkey + 0.5)::DOUBLE AS coverage, 'f' || o_orderkey AS base FROM orders""")
def contig_names(t: Tables) -> DataFrame:
    name = _say("NODE_", key("o_custkey"), "_len_", key("o_orderkey"), "_cov_", key("o_custkey"), ".5")
    fields = X.contig_fields(key("name"))
    base = X.base_name(_say("/a.b/f", key("o_orderkey"), ".fasta"))
    return t.orders.withColumn("name", name).withColumn("f", fields).select("o_orderkey", "name", "f.prefix", "f.length", "f.coverage", base.alias("base"))


_CIGAR = "(l_linenumber + 1) || 'S' || l_quantity::INT || '=' || l_linenumber || 'X' || (l_linenumber % 3 + 1) || 'I' || l_quantity::INT || '=5D'"


@query(f"""SELECT l_orderkey, l_linenumber, (l_linenumber + 1 + l_linenumber + l_linenumber % 3 + 1 + 2 * l_quantity::INT) AS length, (2 * l_quantity::INT) AS matches, l_linenumber AS mismatches,
l_linenumber + 1 AS soft, 2 * l_quantity::INT / (l_linenumber + 1 + l_linenumber + l_linenumber % 3 + 1 + 2 * l_quantity::INT) AS identity,
2 * l_quantity::INT / (l_linenumber + l_linenumber % 3 + 1 + 2 * l_quantity::INT) AS local_identity,
(l_linenumber + 1) || 'S' || (l_quantity::INT + l_linenumber) || 'M' || (l_linenumber % 3 + 1) || 'I' || l_quantity::INT || 'M5D' AS plain, {_CIGAR} AS cigar FROM lineitem""")
def cigar_statistics(t: Tables) -> DataFrame:
    from seqloom.functions import sequences as Q

    n, line = key("l_quantity").cast("int"), key("l_linenumber")
    made = t.lineitem.withColumn("cigar", _say(line + 1, "S", n, "=", line, "X", line % 3 + 1, "I", n, "=5D"))
    return made.withColumn("s", Q.alignment_stats(key("cigar"), F.lit(0))).select(
        "l_orderkey", "l_linenumber", "s.*", Q.cigar_x_to_m(key("cigar")).alias("plain"), "cigar"
    )


@query("""SELECT c_custkey, 'gi|' || c_custkey || '|ref' AS text, c_custkey::VARCHAR AS gi, c_name || ' | len_' || length(c_mktsegment) AS header, strftime(TIMESTAMP '2014-02-18 13:05:00' + to_days(c_custkey::INT % 300), '%Y%b%d') AS day FROM customer""")
def header_functions(t: Tables) -> DataFrame:
    text = _say("gi|", key("c_custkey"), "|ref")
    listed = X.listing_time(F.lit("Tue Feb 18 13:05:00 PST 2014"))
    day = X.listing_date(F.date_add(listed, (key("c_custkey") % 300).cast("int")))
    return t.customer.select(
        "c_custkey", text.alias("text"), X.gi_number(text).alias("gi"), X.with_length(key("c_name"), key("c_mktsegment")).alias("header"), day.alias("day")
    )


@query("""SELECT c_custkey, c_name, lower(c_mktsegment) AS alias FROM customer WHERE c_custkey % 3 = 0""")
def records_by_list(t: Tables) -> DataFrame:
    lines = t.customer.filter("c_custkey % 3 = 0").select(_tabbed("c_name", F.lower("c_mktsegment")))
    strays = t.region.select(_say("nobody ", key("r_name")).alias("value"))
    names = S.names_list(t.spark, _written(t, lines.union(strays), "names")).withColumnRenamed("name", "id")
    found, missing = sinks.selected_records(t.customer.select(key("c_name").alias("id"), "c_custkey", key("c_name")), names)
    checked = missing.agg(F.count("*").alias("n")).filter("n = 5")  # the regions are nobody's name
    return found.join(checked, F.lit(True)).select("c_custkey", "c_name", key("id").alias("alias"))


@query("""SELECT 'b' || l_suppkey % 5 AS bin, '>x' || l_orderkey AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'b' || l_suppkey % 5, 'ACGT', count(*) FROM lineitem GROUP BY ALL""")
def records_by_group(t: Tables) -> DataFrame:
    path = _path(t, "groups")
    rows = t.lineitem.withColumn("bin", _say("b", key("l_suppkey") % 5))
    sinks.write_records(rows, sinks.fasta_record(_say("x", key("l_orderkey")), F.lit("ACGT")), path, by="bin")
    return t.spark.read.text(path).groupBy("bin", "value").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, n_nationkey AS nation, 'new' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0
UNION ALL SELECT -1 - c_custkey, NULL, 'unknown' FROM customer""")
def inserted_with_parents(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation, key("c_nationkey") == key("n_nationkey")).select(key("c_custkey").alias("id"), "n_name")
    strays = t.customer.select((-1 - key("c_custkey")).alias("id"), F.lit("nowhere").alias("n_name"))
    twice = named.union(named).union(strays)
    present = t.customer.filter("c_custkey % 4 = 0").select(key("c_custkey").alias("id"))
    new, unknown = sinks.inserted_rows(twice, present, ["id"], t.nation, "n_name", "n_nationkey")
    return new.select("id", key("n_nationkey").alias("nation"), F.lit("new").alias("kind")).union(
        unknown.select("id", F.lit(None).cast("int"), F.lit("unknown"))
    )


@query("""SELECT 'customer' AS name, c_custkey AS id, c_nationkey < 3 AS taken FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey < 3 FROM supplier""")
def deleted_with_dependants(t: Tables) -> DataFrame:
    gone = t.nation.filter("n_nationkey < 3")
    parts = sinks.deleted_with_dependants({"customer": (t.customer, "c_nationkey"), "supplier": (t.supplier, "s_nationkey")}, gone, "n_nationkey")
    rows = lambda df, name, id_, taken: df.select(F.lit(name).alias("name"), key(id_).alias("id"), F.lit(taken).alias("taken"))
    ids = {"customer": "c_custkey", "supplier": "s_suppkey"}
    sides = [rows(df, name, ids[name], taken) for name, (left, gone_) in parts.items() for df, taken in ((left, False), (gone_, True))]
    return sides[0].union(sides[1]).union(sides[2]).union(sides[3])


@query("""SELECT c_custkey, 'c_acctbal' AS field FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_name' FROM customer WHERE c_custkey % 7 = 0""")
def undefined_fields(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey", F.when(key("c_acctbal") >= 0, key("c_acctbal")).alias("c_acctbal"), F.when(key("c_custkey") % 7 != 0, key("c_name")).alias("c_name")
    )
    return sinks.undefined_fields(rows, "c_custkey")


@query("""SELECT p_partkey || ',' || p_size || ',' || CASE WHEN p_size > 25 THEN 'Positive' ELSE 'Negative' END AS value FROM part UNION ALL
SELECT unnest(['@RELATION kmers', '@ATTRIBUTE KMP_0 real', '@ATTRIBUTE KMP_1 real', '@ATTRIBUTE VALUE { Positive, Negative }', '@DATA'])""")
def arff_file(t: Tables) -> DataFrame:
    path = _path(t, "arff")
    rows = t.part.select("p_partkey", "p_size", (key("p_size") > 25).alias("good"))
    sinks.write_arff(rows, ["p_partkey", "p_size"], "good", "kmers", path)
    return t.spark.read.text(path)


@query("SELECT s_suppkey || '-' || s_nationkey AS id, left(s_name, length(s_name) - 1) AS sample FROM supplier")
def sample_sheet(t: Tables) -> DataFrame:
    return sinks.sample_sheet(t.supplier, ["s_suppkey", "s_nationkey"], "s_name")


@query("""WITH g AS (SELECT l_suppkey AS genome, l_partkey % 7 AS contig, l_orderkey * 10 + l_linenumber AS gene, l_partkey AS s FROM lineitem)
SELECT genome, contig, max(len) AS longest, arg_max(gene, {'n': len, 'g': -gene}) AS gene FROM (SELECT genome, contig, gene, 800 + s % 100 AS len FROM g) GROUP BY 1, 2""")
def longest_feature(t: Tables) -> DataFrame:
    from seqloom.operators import domain as D

    rows = t.lineitem.select(
        key("l_suppkey").alias("genome"), (key("l_partkey") % 7).alias("contig"), (key("l_orderkey") * 10 + key("l_linenumber")).alias("gene"), (800 + key("l_partkey") % 100).alias("longest")
    )
    both = rows.withColumn("k", F.struct("genome", "contig"))
    return D.best_hits(both, "k", [F.desc("longest"), key("gene")]).select("genome", "contig", "longest", "gene")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey || '/' || l_partkey AS s FROM lineitem)
SELECT k, min(k) OVER (PARTITION BY s) AS "group", count(*) OVER (PARTITION BY s) AS n FROM r""")
def genome_gene_pairs(t: Tables) -> DataFrame:
    """Lines with the first one of the same genome and gene, and how many there are."""
    rows = t.lineitem.select((key("l_orderkey") * 10 + key("l_linenumber")).alias("k"), _say(key("l_suppkey"), "/", key("l_partkey")).alias("s"))
    return N.same_strings(rows, "k", "s")


@query("""SELECT 'S' || s_suppkey AS locus, n_name AS organism, (s_suppkey % 7)::INT AS start, (s_suppkey % 7 + 10)::INT AS stop, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END AS strand, 'T' || s_suppkey AS tag, 12 AS n
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0""")
def genbank_features(t: Tables) -> DataFrame:
    """Hypothetical proteins among the features of GenBank records, one for each supplier."""
    place = _say(key("s_suppkey") % 7 + 1, "..", key("s_suppkey") % 7 + 10)
    where = F.when(key("s_suppkey") % 2 == 0, _say("complement(", place, ")")).otherwise(place)
    product = F.when(key("s_suppkey") % 3 == 0, "kinase").otherwise("hypothetical\n                     protein")
    entry = _say(
        "LOCUS       S", key("s_suppkey"), " 12 bp\n  ORGANISM  ", key("n_name"), "\n            Bacteria; Some.\nFEATURES             Location/Qualifiers\n",
        "     source          1..12\n     CDS             ", where, '\n                     /locus_tag="T', key("s_suppkey"), '"\n                     /product="', product,
        '"\nORIGIN\n        1 acgtacgtac gt\n//',
    )
    path = _written(t, t.supplier.join(t.nation, key("s_nationkey") == key("n_nationkey")).select(entry.alias("value")), "genbank")
    records.register(t.spark)
    found = t.spark.read.format("records").option("kind", "genbank").load(path)
    lengths = found.select("locus", F.char_length("seq").alias("n"))
    kept = R.chosen_features(R.features_of(found), ["CDS"], product="hypothetical protein")
    return kept.join(lengths, "locus").select("locus", "organism", "start", key("end").alias("stop"), "strand", key("locus_tag").alias("tag"), "n")


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'g_' || s_nationkey WHEN s_suppkey % 3 = 1 THEN 'plant' ELSE 'unmapped' END AS genome, count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 1 OR s_suppkey % 2 = 0 GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 2 = 1""")
def genomes_of_references(t: Tables) -> DataFrame:
    kind = key("s_suppkey") % 3
    plant = F.when(key("s_suppkey") % 2 == 0, "Pt").otherwise("45x")
    name = F.when(kind == 0, _say("g_", key("s_nationkey"), "_scaffold_", key("s_suppkey"))).when(kind == 1, plant).otherwise("unmapped reads")
    return t.supplier.groupBy(X.genome_of_reference(name).alias("genome")).agg(F.count("*").alias("n"))
