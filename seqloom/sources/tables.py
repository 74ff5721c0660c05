"""Readers of line formats, as expressions over Spark's text and CSV readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seqloom.functions.text import first_entries

_BLAST6 = (
    "query string, subject string, perc_id double, length int, mismatch int, gapopen int, "
    "qstart int, qend int, sstart int, send int, evalue double, bitscore double"
)
_GFF = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
_DEPTH = "contig string, pos int, cov int"


def _tsv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="", **options)


def blast6(spark: SparkSession, path: str, staxids: bool = False) -> DataFrame:
    """Tabular hits; a row of another number of columns is an error."""
    return _tsv(spark, path, _BLAST6 + (", staxids string" if staxids else ""), mode="FAILFAST", comment="#")


def blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each high-scoring pair of an XML report."""
    pair = "struct<`Hsp_bit-score`:double,Hsp_evalue:double,`Hsp_query-from`:int,`Hsp_query-to`:int,`Hsp_hit-from`:int,`Hsp_hit-to`:int,Hsp_identity:int,`Hsp_align-len`:int,Hsp_midline:string>"
    hit = f"struct<Hit_id:string,Hit_def:string,Hit_len:int,Hit_hsps:struct<Hsp:array<{pair}>>>"
    schema = f"`Iteration_query-def` string, `Iteration_query-len` int, Iteration_hits struct<Hit:array<{hit}>>"
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(schema).load(path)
    hits = rows.select(
        F.col("`Iteration_query-def`").alias("query"),
        F.col("`Iteration_query-len`").alias("query_length"),
        F.explode("Iteration_hits.Hit").alias("h"),
    )
    pairs = hits.select("query", "query_length", "h.Hit_def", "h.Hit_len", F.explode("h.Hit_hsps.Hsp").alias("p"))
    start, end = F.col("p.`Hsp_hit-from`"), F.col("p.`Hsp_hit-to`")
    return pairs.select(
        "query",
        "query_length",
        F.col("Hit_def").alias("subject"),
        F.col("Hit_len").alias("subject_length"),
        F.col("p.`Hsp_bit-score`").alias("bitscore"),
        F.col("p.Hsp_evalue").alias("evalue"),
        (F.least(start, end) - 1).alias("start"),
        F.greatest(start, end).alias("end"),
        F.when(start <= end, 1).otherwise(-1).alias("strand"),
        F.try_divide(
            F.char_length(F.regexp_replace("p.Hsp_midline", r"[^|]", "")).cast("double"),
            F.char_length("p.Hsp_midline").cast("double"),
        ).alias("identity"),
    )


def sam(spark: SparkSession, path: str, aligned_only: bool = False, min_mapq: int = 0) -> DataFrame:
    """Alignments with tags as map<string,string>; header lines are left out."""
    f = F.split(F.col("value"), "\t")
    at = lambda i, kind="string": F.get(f, i).cast(kind)
    tags = first_entries(
        F.transform(
            F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: t.rlike("^[A-Za-z0-9]{2}:.:")),
            lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substr(t, F.lit(6)).alias("value")),
        )
    )
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        at(0).alias("qname"), at(1, "int").alias("flag"), F.nullif(at(2), F.lit("*")).alias("rname"),
        at(3, "int").alias("pos"), at(4, "int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"),
        at(7, "int").alias("pnext"), at(8, "int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"),
        tags.alias("attributes"),
    )
    if aligned_only:
        rows = rows.filter(~F.col("flag").isin(4, 516))
    return rows.filter(F.col("mapq") >= min_mapq) if min_mapq else rows


def tag(name: str, kind: str = "string") -> Column:
    """A typed tag of sam() rows; null where it is missing."""
    return F.try_element_at("attributes", F.lit(name)).try_cast(kind)


def sam_headers(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the reference sequences."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return lines.select(
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"),
        F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("long").alias("length"),
    )


def kraken(spark: SparkSession, path: str) -> DataFrame:
    """Classifications of five or six columns; hits as array<struct<taxid, n>>."""
    f = F.split(F.col("value"), "\t")
    six = F.size(f) >= 6
    hits = F.transform(
        F.filter(F.split(F.get(f, F.when(six, 5).otherwise(4)), " "), lambda h: h.contains(":")),
        lambda h: F.struct(
            F.substring_index(h, ":", 1).alias("taxid"), F.substring_index(F.substring_index(h, ":", 2), ":", -1).cast("int").alias("n")
        ),
    )
    return spark.read.text(path).filter(F.size(f) >= 5).select(
        (F.get(f, 0) == "C").alias("classified"),
        F.get(f, 1).alias("name"),
        F.get(f, 2).alias("taxid"),
        F.get(f, 3).cast("int").alias("length"),
        F.when(six, F.regexp_replace(F.get(f, 4), "^P=", "").try_cast("double")).alias("p_val"),
        hits.alias("hits"),
    )


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features with 0-based half-open places and attributes as a map; comments are left out."""
    rows = _tsv(spark, path, _GFF, comment="#").filter("start IS NOT NULL")
    pairs = F.filter(F.split("attributes", ";"), lambda p: p.contains("="))
    attributes = first_entries(
        F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.call_function("substr", p, F.instr(p, "=") + 1).alias("value")))
    )
    return rows.withColumn("start", F.col("start") - 1).withColumn("attributes", attributes)


def depth(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, _DEPTH)


#: Dictionaries in either quotes, with an apostrophe in double quotes or behind a backslash.
_LITERAL = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def checkm(spark: SparkSession, path: str) -> DataFrame:
    """(name, values map<string,string>) of lines ``name<TAB>{'k': v}``."""
    f = F.split(F.col("value"), "\t", 2)
    return spark.read.text(path).filter(F.size(f) == 2).select(
        F.get(f, 0).alias("name"), F.from_json(F.get(f, 1), "map<string,string>", _LITERAL).alias("values")
    )


def wide_matrix(spark: SparkSession, path: str, key: str = "row") -> DataFrame:
    """(key, column, value double) of a table with a header; cells that aren't numbers are null."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *others = wide.columns
    long = wide.unpivot([first], others, "column", "text")
    return long.select(F.col(first).alias(key), "column", F.col("text").try_cast("double").alias("value"), "text")


def ncbi_taxonomy(spark: SparkSession, names: str, nodes: str) -> DataFrame:
    """(taxid, parent, rank, name) with scientific names; the root has no parent."""
    cells = lambda path: spark.read.text(path).select(F.split("value", r"\t\|\t?").alias("f"))
    named = cells(names).filter(F.get("f", 3) == "scientific name").select(F.get("f", 0).alias("taxid"), F.get("f", 1).alias("name"))
    placed = cells(nodes).select(F.get("f", 0).alias("taxid"), F.get("f", 1).alias("parent"), F.get("f", 2).alias("rank"))
    return placed.join(named, "taxid", "left").withColumn("parent", F.when(F.col("parent") != F.col("taxid"), F.col("parent")))


def kegg_htext(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, pathway ``A;B;C``) of each D line, levels carried down.

    The lines above a D line decide its levels, so that a file is handled by one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.col("_metadata.file_path").alias("file"))
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = whole.filter(F.col("line").rlike("^[ABCD] *[^ ]")).withColumn("level", F.substring("line", 1, 1))
    text = F.trim(F.regexp_replace(F.substr(F.col("line"), F.lit(2)), r"<[^>]*>|\s*\[(?:PATH|BR):[^\]]*\]", ""))
    lines = lines.withColumn("text", text)
    for level in "ABC":
        mark = F.when(F.col("level") == level, F.struct("at", "text"))
        lines = lines.withColumn(level, F.last(mark, ignorenulls=True).over(w))
    # a level counts only if it was met after the level above it
    b = F.when(F.col("B.at") > F.col("A.at"), F.col("B.text"))
    c = F.when(F.col("C.at") > F.greatest("A.at", "B.at"), F.col("C.text"))
    return lines.filter("level = 'D'").select(
        F.regexp_extract("text", r"^(\S+)", 1).alias("id"),
        F.regexp_extract("text", r"^\S+\s+(.*)$", 1).alias("description"),
        F.concat_ws(";", "A.text", b, c).alias("pathway"),
    )


def html_table(html: Column) -> Column:
    """map<string,string> of the table heads and cells that follow each other."""
    clean = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    keys = F.regexp_extract_all(html, F.lit(r"(?is)<th[^>]*>(.*?)</th>\s*<td[^>]*>.*?</td>"), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(r"(?is)<th[^>]*>.*?</th>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    entries = F.zip_with(keys, values, lambda k, v: F.struct(clean(k).alias("key"), clean(v).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    first = lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), 0)
    return F.map_from_entries(F.transform(names, first))


def first_assignments(spark: SparkSession, path: str, min_length: int = 0, min_identity: float = 0) -> DataFrame:
    """Each query's first hit (file order) of tabular hits with taxids that is long and alike enough."""
    rows = blast6(spark, path, staxids=True).withColumn("__at", F.monotonically_increasing_id())
    kept = rows.filter((F.col("length") >= min_length) & (F.col("perc_id") >= min_identity))
    w = Window.partitionBy("query").orderBy("__at")
    return kept.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__at")


def interpro(spark: SparkSession, path: str) -> DataFrame:
    """(query, length, source, subject, start, end, score, terms) of each scored hit before a ``##FASTA`` line.

    A polypeptide row gives its query's length; a hit of a query without such a row is left out.
    Files are read in ranges of bytes: a line's place is its range and its number therein.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.col("value").alias("line"))
    ends = text.filter(F.col("line").startswith("##FASTA")).groupBy(F.col("file").alias("in")).agg(F.min("at").alias("end"))
    lines = text.filter(~F.col("line").startswith("#") & (F.col("line") != "")).join(ends, F.col("file") == F.col("in"), "left")
    lines = lines.filter(F.col("end").isNull() | (F.col("at") < F.col("end")))
    f = F.split("line", "\t")
    at = lambda i, kind="string": F.get(f, i).try_cast(kind)
    rows = lines.select(
        at(0).alias("query"), at(1).alias("source"), at(2).alias("type"), at(3, "int").alias("start"), at(4, "int").alias("end"),
        at(5, "double").alias("score"), at(8).alias("attributes"),
    )
    queries = rows.filter("type = 'polypeptide'").groupBy("query").agg(F.max(F.col("end") - F.col("start")).alias("length"))
    tag = lambda name: F.regexp_extract("attributes", rf"(?:^|;){name}=([^;]*)", 1)
    terms = F.filter(F.split(F.replace(tag("Ontology_term"), F.lit('"')), ","), lambda t: t != "")
    return rows.filter("score IS NOT NULL").join(queries, "query").select(
        "query", "length", "source", F.nullif(tag("Name"), F.lit("")).alias("subject"), "start", "end", "score", terms.alias("terms")
    )


def good_interpro_hits(hits: DataFrame, max_score: float = 0.05, min_cover: float = 0.5) -> DataFrame:
    """Hits of a low score that span enough of their query."""
    return hits.filter((F.col("score") <= max_score) & (F.col("end") - F.col("start") >= min_cover * F.col("length")))


def tuple_matrix(spark: SparkSession, path: str, skip_self: bool = True) -> DataFrame:
    """(query, reference, ani, af) of a table whose cells read ``(ani, af)``."""
    wide = spark.read.csv(path, sep="\t", header=True, quote="")
    first, *others = wide.columns
    long = wide.unpivot([first], others, "reference", "cell")
    both = F.split(F.regexp_replace("cell", "[()]", ""), ", *")
    rows = long.select(
        F.col(first).alias("query"), "reference", F.get(both, 0).try_cast("double").alias("ani"), F.get(both, 1).try_cast("double").alias("af")
    )
    return rows.filter("query <> reference") if skip_self else rows


def trait_matrix(spark: SparkSession, path: str, key: str = "entry") -> DataFrame:
    """(entry, column, value, text) of a trait table; a trait that comes twice is an error."""
    header = spark.read.text(path).first()
    names = (header[0] if header else "").split("\t")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"traits come twice: {twice}")
    return wide_matrix(spark, path, key)


def ko_functions(spark: SparkSession, path: str, level: int) -> DataFrame:
    """(function, ko) at a level (1 to 3) of a KO table whose last column lists pathways ``A;B;C|A;D;E``."""
    if level not in (1, 2, 3):
        raise ValueError("level must be 1, 2 or 3")
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    each = rows.select(F.col(f"`{rows.columns[0]}`").alias("ko"), F.explode(F.split(F.col(f"`{rows.columns[-1]}`"), r"\|")).alias("p"))
    return each.select(F.array_join(F.slice(F.split("p", ";"), 1, level), ";").alias("function"), "ko")


def lineage_kos(spark: SparkSession, path: str) -> DataFrame:
    """(lineage, kos array<string>), an empty array where none is listed."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", schema="lineage string, kos string")
    return rows.select("lineage", F.filter(F.split(F.coalesce("kos", F.lit("")), ";"), lambda k: k != "").alias("kos"))


def ko_counts(spark: SparkSession, path: str) -> DataFrame:
    """(genome, ko, n) of KO tables, the genome being the file's name; ``KO:`` is cut off."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t").alias("f"))
    return lines.filter(F.get("f", 0).startswith("KO:")).select(
        F.regexp_extract("file", r"^(.*?)(?:\.[^.]*)?$", 1).alias("genome"),
        F.substring(F.get("f", 0), 4, 1 << 20).alias("ko"),
        F.element_at("f", -1).try_cast("double").alias("n"),
    )


def hmm_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the models of an HMM file."""
    return spark.read.text(path).filter(F.col("value").rlike("^NAME ")).select(F.trim(F.substring("value", 5, 1 << 20)).alias("name"))


def hmm_hits(spark: SparkSession, path: str) -> DataFrame:
    """(name, query) of a table of hits; lines that start with # are left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.get(f, 0).alias("name"), F.get(f, 2).alias("query"))


def tree_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, markers, duplicated, taxonomy) of a table of a tree's genomes with a header."""
    return _tsv(spark, path, "name string, markers int, duplicated int, taxonomy string", header=True)


def reference_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, taxonomy) of a tree's reference genomes."""
    return _tsv(spark, path, "name string, taxonomy string")


def cluster_list(spark: SparkSession, path: str) -> DataFrame:
    """(cluster) of a list of clusters, a line each; empty lines are left out."""
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("cluster"))


def contig_bins(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bin) of a comma-separated clustering."""
    return spark.read.csv(path, schema="contig string, bin string")


def coverage_stats(spark: SparkSession, path: str) -> DataFrame:
    """(contig, avg_fold) of a coverage report with a header that starts with #."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(
        F.element_at(F.split(F.get(f, 0), " "), 1).alias("contig"), F.get(f, 1).try_cast("double").alias("avg_fold")
    )


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, prediction, score): 1 for a plasmid, 0 for a chromosome, else null."""
    rows = _tsv(spark, path, "contig string, length int, prediction string", comment="#")
    score = F.when(F.col("prediction") == "Plasmid", 1).when(F.col("prediction") == "Chromosome", 0)
    return rows.withColumn("score", score)


def classifier_results(spark: SparkSession, path: str) -> DataFrame:
    """(instance, actual, predicted, confidence) of lines ``1 1:Positive 2:Negative + 0.9``."""
    f = F.split(F.trim("value"), r"\s+")
    label = lambda i: F.regexp_extract(F.get(f, i), r"^\d+:(.*)$", 1)
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d+\s+\d+:"))
    return rows.select(
        F.get(f, 0).cast("int").alias("instance"), label(1).alias("actual"), label(2).alias("predicted"),
        F.element_at(f, -1).try_cast("double").alias("confidence"),
    )


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): sequences of FASTA (lines that start with >) and FASTQ files (lines over 4); gz files too."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    quality = F.col("file").rlike(r"\.(?:fq|fastq)(?:\.gz)?$")
    heads = F.count_if(F.col("value").startswith(">"))
    return lines.groupBy("file").agg(F.when(F.any_value(quality), F.floor(F.count("*") / 4)).otherwise(heads).cast("long").alias("n"))


def names_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, new_name) of a list of names, or of names and what to call them; new_name may be null."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        F.trim(F.get(f, 0)).alias("name"), F.nullif(F.trim(F.get(f, 1)), F.lit("")).alias("new_name")
    )


def statements(spark: SparkSession, text: str) -> DataFrame:
    """Rows of the last of several SQL statements, which end with ``;`` at a line's end."""
    parts = [p.strip().rstrip(";") for p in text.split(";\n")]
    *before, last = [p for p in parts if p]
    for part in before:
        spark.sql(part)
    return spark.sql(last)


def folder_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, attributes map<string,string>) of the files named in XML folder trees; folders give the path."""

    def run(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for batch in batches:
            rows = []
            for text in batch["value"]:
                stack = [(ET.fromstring(text), "")]
                while stack:
                    node, above = stack.pop()
                    for child in node:
                        if child.tag == "folder":
                            stack.append((child, f"{above}/{child.get('name', '')}"))
                        elif child.tag == "file":
                            rows.append((f"{above}/{child.get('filename', '')}".lstrip("/"), dict(child.attrib)))
            yield pd.DataFrame(rows, columns=["path", "attributes"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "path string, attributes map<string,string>")


def nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """(name, newick) of the trees of nexus files, with the names of their translate block put in."""
    text = spark.read.text(path, wholetext=True).select("value")
    tree = r"(?is)\btree\s+(\S+)\s*=\s*(?:\[[^\]]*\]\s*)?(\([^;]*;)"
    block = F.regexp_extract("value", r"(?is)\btranslate\b\s*(.*?);", 1)
    pairs = F.filter(F.split(F.trim(block), r"\s*,\s*"), lambda p: p.rlike(r"^\S+\s+\S+"))
    table = first_entries(F.transform(pairs, lambda p: F.named_struct(F.lit("key"), F.split(p, r"\s+")[0], F.lit("value"), F.split(p, r"\s+")[1])))
    found = text.select(
        F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(tree), F.lit(1)).alias("name"), F.regexp_extract_all("value", F.lit(tree), F.lit(2)).alias("newick"))).alias("t"),
        table.alias("table"),
    )
    words = F.regexp_extract_all("t.newick", F.lit(r"[(),;]|[^(),;]+"), F.lit(0))
    label = lambda w: F.split(w, ":")
    named = F.transform(
        words,
        lambda w: F.when(
            F.try_element_at("table", F.get(label(w), 0)).isNotNull(),
            F.concat_ws(":", F.try_element_at("table", F.get(label(w), 0)), F.get(label(w), 1)),
        ).otherwise(w),
    )
    return found.select("t.name", F.array_join(named, "").alias("newick"))


def phyloxml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, parent, name, length) of the clades of phyloxml files; trees are numbered within their file."""

    def run(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for batch in batches:
            rows = []
            for text in batch["value"]:
                for tree, top in enumerate(e for e in ET.fromstring(text).iter() if local(e) == "phylogeny"):
                    n, stack = 0, [(c, None) for c in top if local(c) == "clade"]
                    while stack:
                        clade, parent = stack.pop()
                        own = {local(c): (c.text or "").strip() for c in clade}
                        length = own.get("branch_length") or clade.get("branch_length")
                        rows.append((tree, n, parent, own.get("name", ""), float(length) if length else None))
                        stack += [(c, n) for c in reversed(clade) if local(c) == "clade"]
                        n += 1
            yield pd.DataFrame(rows, columns=["tree", "node", "parent", "name", "length"]).astype({"parent": "Int32", "length": "Float64"})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "tree long, node int, parent int, name string, length double")


def ko_pathways(lines: DataFrame) -> DataFrame:
    """(id, description, pathways) of kegg_htext() rows: every chain of levels of an id, joined by a bar in order."""
    return lines.groupBy("id").agg(
        F.min("description").alias("description"), F.array_join(F.sort_array(F.collect_set("pathway")), "|").alias("pathways")
    )
