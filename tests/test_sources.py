"""Readers and writers on files made by the tests."""

import pytest
from pyspark.sql import functions as F

from seqloom.sources import records, sinks, tables


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def test_records(spark, put):
    records.register(spark)
    read = lambda kind, path: spark.read.format("records").option("kind", kind).load(path)
    got = read("fasta", put("x.fa", ">a one\nACG\nT\n>b\n\n>c\nGG")).orderBy("id").collect()
    assert [(r.id, r.description, r.seq) for r in got] == [("a", "a one", "ACGT"), ("b", "b", ""), ("c", "c", "GG")]
    got = read("fastq", put("x.fq", "@r1 x\nAC\n+\n@I\n@r2\nG\n+\nI\n")).orderBy("id").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == [("r1", "AC", "@I"), ("r2", "G", "I")]
    text = (
        "LOCUS       X1 12 bp\n  ORGANISM  Some bug\n            Bacteria; Firmi;\n            Bacilli.\nFEATURES             Location/Qualifiers\n"
        '     CDS             complement(2..7)\n                     /locus_tag="L1"\n                     /product="some\n                     thing"\n'
        "ORIGIN\n        1 acgtac gtacgt\n//\n"
    )
    (row,) = read("genbank", put("x.gb", text)).collect()
    assert (row.locus, row.organism, row.taxonomy, row.seq) == ("X1", "Some bug", "Bacteria; Firmi; Bacilli", "ACGTACGTACGT")
    (feature,) = row.features
    assert (feature.type, feature.start, feature.end, feature.strand) == ("CDS", 1, 7, -1)
    assert feature.qualifiers == {"locus_tag": ["L1"], "product": ["some thing"]}


def test_alignment_tables(spark, put):
    hits = tables.blast6(spark, put("b.txt", "q\ts\t99.5\t100\t1\t0\t1\t100\t5\t104\t1e-20\t180\n"))
    assert hits.first().bitscore == 180.0
    text = "@SQ\tSN:c1\tLN:500\nr1\t0\tc1\t5\t30\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"
    path = put("x.sam", text)
    assert tables.sam_headers(spark, path).first().asDict() == {"name": "c1", "length": 500}
    all_rows = tables.sam(spark, path).select("qname", "rname", tables.tag("NM", "int").alias("nm")).orderBy("qname").collect()
    assert [tuple(r) for r in all_rows] == [("r1", "c1", 1), ("r2", None, None)]
    assert tables.sam(spark, path, aligned_only=True, min_mapq=1).count() == 1
    k = tables.kraken(spark, put("k.txt", "C\tr1\t562\t100\t562:13 A:31\nU\tr2\t0\t50\tP=0.5\t0:1\n")).orderBy("name").collect()
    assert k[0].classified and [tuple(h) for h in k[0].hits] == [("562", 13), ("A", 31)] and k[0].p_val is None
    assert not k[1].classified and k[1].p_val == 0.5


def test_other_tables(spark, put):
    g = tables.gff(spark, put("x.gff", "##gff-version 3\nc\tb\tgene\t3\t9\t.\t+\t.\tID=g1;Name=16S_rRNA\n")).first()
    assert (g.start, g.end, g.attributes) == (2, 9, {"ID": "g1", "Name": "16S_rRNA"})
    c = tables.checkm(spark, put("c.tsv", "bin1\t{'Completeness': 95.0, 'marker lineage': 'x'}\n")).first()
    assert c["values"] == {"Completeness": "95.0", "marker lineage": "x"}
    m = tables.wide_matrix(spark, put("m.tsv", "id\ta\tb\nx\t1\tNA\n")).orderBy("column").collect()
    assert [(r.row, r.column, r.value) for r in m] == [("x", "a", 1.0), ("x", "b", None)]
    names = put("names.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\tbugs\t|\t\t|\tcommon name\t|\n")
    nodes = put("nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n")
    t = tables.ncbi_taxonomy(spark, names, nodes).orderBy("taxid").collect()
    assert [tuple(r) for r in t] == [("1", None, "no rank", "root"), ("2", "1", "superkingdom", "Bacteria")]
    k = tables.kegg_htext(spark, put("k.htext", "+D\tKO\nA<b>Met</b>\nB\nB  Carb\nC    00010 Gly [PATH:ko00010]\nD      K00844  HK; hexokinase\nAOther\nD      K1  x y\n"))
    assert [tuple(r) for r in k.orderBy("id").collect()] == [("K00844", "HK; hexokinase", "Met;Carb;00010 Gly"), ("K1", "x y", "Other")]
    html = spark.createDataFrame([("<table><tr><th>A</th><td> <b>1</b></td></tr><tr><th>B</th><td>2</td></tr></table>",)], "h string")
    assert html.select(tables.html_table(F.col("h"))).first()[0] == {"A": "1", "B": "2"}


def test_sinks(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGTAC"), ("b", "GG")], "id string, seq string")
    found, missing = sinks.selected_records(seqs, spark.createDataFrame([("a", "n1"), ("z", None)], "id string, new_name string"))
    assert [tuple(r) for r in found.select("id", "seq").collect()] == [("n1", "ACGTAC")]
    assert [r.id for r in missing.collect()] == ["z"]
    sinks.write_records(seqs.withColumn("bin", F.col("id")), sinks.fasta_record(F.col("id"), F.col("seq")), str(tmp_path / "out"), "bin")
    assert "".join(p.read_text() for p in (tmp_path / "out" / "bin=a").glob("part*")) == ">a\nACGTAC\n"
    regions = spark.createDataFrame([("a", 1, 4, -1), ("a", 0, 2, 1)], "contig string, start int, end int, strand int")
    assert sorted(r.seq for r in sinks.region_sequences(regions, seqs).collect()) == ["AC", "ACG"]
    assert sinks.inserted(seqs, seqs.filter("id = 'a'"), ["id"]).count() == 1
    assert sinks.deleted(seqs, seqs.filter("id = 'a'"), "id").count() == 1
    nulls = spark.createDataFrame([("a", None, 1)], "id string, x string, y int")
    assert [tuple(r) for r in sinks.undefined_fields(nulls, "id").collect()] == [("a", "x")]
    sinks.write_tsv(nulls, str(tmp_path / "t"))
    assert "a\tNA\t1" in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
