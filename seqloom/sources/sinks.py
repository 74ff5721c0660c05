"""Writers of record and table files, by Spark's own text and CSV writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.sequences import reverse_complement


def write_tsv(df: DataFrame, path: str) -> None:
    """One header line per file; nulls are written as NA."""
    df.write.csv(path, sep="\t", header=True, nullValue="NA", quote="")


def fasta_record(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def fastq_record(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_records(df: DataFrame, record: Column, path: str, by: str | None = None) -> None:
    """Records as text; with ``by`` into a folder for each of its values."""
    rows = df.select(record.alias("value"), *([by] if by else []))
    writer = rows.write.partitionBy(by) if by else rows.write
    writer.text(path)


#: Records of an XML file, which is read by one task.
MOST_RECORDS = 200_000


def write_rooted(rows: DataFrame, record: Column, root: str, path: str, compression: str = "none") -> None:
    """XML files of records, each with one root element; no more than a line is held.

    Rows are dealt out to as many files as keep each small. Tags repeat, so that files packed by
    ``compression`` (gzip, say) take a small part of the disk; Spark's reader unpacks them.
    """

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.record_batch([pa.array([text], pa.string())], ["value"])
        yield line(f"<{root}>")
        for batch in batches:
            yield pa.record_batch([batch.column(0)], ["value"])
        yield line(f"</{root}>")

    dealt = rows.repartition(max(8, -(-rows.count() // MOST_RECORDS)))
    dealt.select(record.alias("value")).mapInArrow(rooted, "value string").write.text(path, compression=compression)


def selected_records(sequences: DataFrame, names: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(records named in ``names``, renamed by its column new_name if it has one; names not found)."""
    wanted = names.dropDuplicates([key])
    found = sequences.join(wanted, key)
    if "new_name" in names.columns:
        found = found.withColumn(key, F.coalesce("new_name", key)).drop("new_name")
    return found, wanted.join(sequences, key, "left_anti")


def region_sequences(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions (contig, start, end: 0-based half-open, strand) with their sequences.

    Sorted and merged: a table of few rows may hold long sequences, which a broadcast would bring to the driver.
    """
    joined = regions.join(contigs.select(F.col("id").alias("contig"), "seq").hint("merge"), "contig")
    part = F.substr(F.col("seq"), F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.withColumn("seq", F.when(F.col("strand") < 0, reverse_complement(part)).otherwise(part))


def sequences_and_missing(regions: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions with their sequences; regions whose contig isn't there)."""
    missing = regions.join(contigs.select(F.col("id").alias("contig")).hint("merge"), "contig", "left_anti")
    return region_sequences(regions, contigs), missing


def inserted(new: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: one of each key that isn't present yet."""
    return new.dropDuplicates(keys).join(present.select(*keys), keys, "left_anti")


def deleted(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """What is left after deleting the named rows."""
    return rows.join(names.select(key), key, "left_anti")


def wide(long: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A row x column table with its columns in the given order; missing cells are null."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value)).select(row, *[F.col(f"`{c}`") for c in columns])


def undefined_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, field) of every null cell."""
    others = [c for c in df.columns if c != key]
    texts = df.select(key, *[F.col(c).cast("string").alias(c) for c in others])
    return texts.unpivot([key], others, "field", "value").filter("value IS NULL").select(key, "field")


def write_arff(rows: DataFrame, columns: list[str], positive: str, relation: str, path: str) -> None:
    """An ARFF file: numbers and a Positive or Negative tag, under a header that names them."""
    head = [f"@RELATION {relation}", *[f"@ATTRIBUTE KMP_{i} real" for i in range(len(columns))], "@ATTRIBUTE VALUE { Positive, Negative }", "@DATA"]
    spark = rows.sparkSession
    header = spark.createDataFrame([(-1, "\n".join(head))], "at long, value string")
    tag = F.when(F.col(positive), "Positive").otherwise("Negative")
    data = F.concat_ws(",", *[F.col(c).cast("string") for c in columns], tag)
    lines = header.union(rows.select(F.monotonically_increasing_id(), data))
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)


def sample_sheet(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """(id, sample): the barcode fields joined by a dash, and the name without its last letter."""
    return rows.select(F.concat_ws("-", *[F.col(c).cast("string") for c in fields]).alias("id"), F.expr(f"left({name}, length({name}) - 1)").alias("sample"))


def inserted_rows(new: DataFrame, present: DataFrame, keys: list[str], parents: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append with their parent's key, rows whose parent is unknown).

    ``parents``: (name, key); rows already present by ``keys`` are ignored. A parent's name with
    two keys is an error.
    """
    from seqloom.operators.reports import resolved

    found, unknown = resolved(new, parents, name, key)
    return inserted(found, present, keys), unknown


def deleted_with_dependants(tables: dict[str, tuple[DataFrame, str]], names: DataFrame, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each table (frame, column that holds the key): what is left, and the rows taken out, to be exported first."""
    gone = names.select(F.col(key).alias("__gone"))
    return {
        label: (df.join(gone, F.col(column) == F.col("__gone"), "left_anti"), df.join(gone, F.col(column) == F.col("__gone"), "left_semi"))
        for label, (df, column) in tables.items()
    }
