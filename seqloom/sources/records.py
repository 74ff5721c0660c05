"""Readers of record files (FASTA, FASTQ, GenBank) as a Python data source.

``register(spark)`` makes the format ``records`` known:
``spark.read.format("records").option("kind", "fasta").load(path)``. Files
are cut into ranges of ``split_bytes`` (128 MB), each a partition that reads the
records that start in it; compressed files are a partition each. Files are
read line by line, so that their size doesn't matter. The option ``extensions`` (``fa,fasta``)
leaves other files out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "fasta": "id string, description string, seq string, file string",
    "fastq": "id string, description string, seq string, qual string, file string",
    "genbank": "locus string, organism string, taxonomy string, seq string, "
    "features array<struct<type:string,start:int,end:int,strand:int,qualifiers:map<string,array<string>>>>, file string",
}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "fasta")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(
            self.options.get("kind", "fasta"),
            self.options["path"],
            tuple(x.strip().lstrip(".") for x in self.options.get("extensions", "").split(",") if x.strip()),
            int(self.options.get("split_bytes", 128 << 20)),
        )


class Range(InputPartition):
    """Bytes of a file: the records that start from ``start`` up to ``stop`` (None: to its end)."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, extensions: tuple[str, ...], split_bytes: int):
        self._kind, self._path, self._extensions, self._split = kind, path, extensions, split_bytes

    def partitions(self) -> list[InputPartition]:
        fs, at = _place(self._path)
        info = fs.get_file_info(at)
        files = [info]
        if info.type == pyarrow.fs.FileType.Directory:
            found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
            files = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        if self._extensions:
            files = [f for f in files if f.base_name.endswith(tuple(f".{x}" for x in self._extensions))]
        return [part for f in files for part in self._ranges(f)]

    def _ranges(self, file) -> list[Range]:
        whole = self._kind not in STARTS or file.extension in ("gz", "bz2", "zst", "lz4")
        if whole or file.size <= self._split:
            return [Range(file.path)]
        return [Range(file.path, at, min(at + self._split, file.size)) for at in range(0, file.size, self._split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, _ = _place(self._path)
        if partition.stop is None:
            with fs.open_input_stream(partition.path) as stream:
                for row in PARSERS[self._kind](line for _, line in _lines(stream, 0)):
                    yield (*row, partition.path)
            return
        with fs.open_input_file(partition.path) as file:
            at = max(0, partition.start - 1)
            file.seek(at)
            lines = _lines(file, at)
            if partition.start:
                next(lines, None)  # the line that started before
            for row in PARSERS[self._kind](STARTS[self._kind](lines, partition.stop)):
                yield (*row, partition.path)


def _place(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def _lines(stream, at: int, size: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """(offset, line) from a stream that stands at offset ``at``."""
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield at, line.decode("utf-8", "replace").rstrip("\r")
            at += len(line) + 1
    if rest:
        yield at, rest.decode("utf-8", "replace")


def _headed_range(head: str):
    """Ranges of records that each begin with a line that starts with ``head``."""

    def lines_of(lines: Iterator[tuple[int, str]], stop: int) -> Iterator[str]:
        inside = False
        for at, line in lines:
            if line.startswith(head):
                if at >= stop:
                    return
                inside = True
            if inside:
                yield line

    return lines_of


def _fastq_range(lines: Iterator[tuple[int, str]], stop: int) -> Iterator[str]:
    """Whole records: the first line that starts with @ and has a line with + two lines on is a header
    (a quality line may start with @ too, but then a sequence is two lines on)."""
    held: list[tuple[int, str]] = []
    for pair in lines:
        held.append(pair)
        if len(held) < 4:
            continue
        if held[0][1].startswith("@") and held[2][1].startswith("+"):
            if held[0][0] >= stop:
                return
            yield from (line for _, line in held)
            held = []
        else:
            held.pop(0)


def fasta(lines: Iterable[str]) -> Iterator[tuple]:
    """(id, description, sequence); sequences may span lines, the last record counts."""
    header, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if header is not None:
                yield (header.split(None, 1)[0] if header else "", header, "".join(parts))
            header, parts = line[1:].strip(), []
        elif header is not None:
            parts.append(line.strip())
    if header is not None:
        yield (header.split(None, 1)[0] if header else "", header, "".join(parts))


def fastq(lines: Iterable[str]) -> Iterator[tuple]:
    """(id, description, sequence, quality) of records of four lines; a partial last one is left out."""
    found = iter(lines)
    for header, seq, _, qual in zip(found, found, found, found):
        text = header[1:].strip()
        yield (text.split(None, 1)[0] if text else "", text, seq.strip(), qual.strip())


_PLACE = re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")


def genbank(lines: Iterable[str]) -> Iterator[tuple]:
    """(locus, organism, taxonomy, sequence, features) of each entry; places are 0-based half-open."""
    locus, organism, taxonomy, seq, features, part = None, "", [], [], [], ""
    key = None
    for line in lines:
        if line.startswith("LOCUS"):
            locus, organism, taxonomy, seq, features, part = (line.split() + [""])[1], "", [], [], [], "head"
        elif line.startswith("  ORGANISM"):
            organism, part = line[12:].strip(), "taxonomy"
        elif line.startswith("FEATURES"):
            part = "features"
        elif line.startswith("ORIGIN"):
            part = "origin"
        elif line.startswith("//"):
            yield (locus, organism, " ".join(taxonomy).rstrip("."), "".join(seq).upper(), [_closed(f) for f in features])
            locus, part = None, ""
        elif part == "taxonomy":
            if line.startswith(" " * 12):
                taxonomy.append(line.strip())
            else:
                part = "head"
        elif part == "origin":
            seq.append(re.sub(r"[^A-Za-z]", "", line))
        elif part == "features" and line.strip():
            if line[5:6].strip():
                kind, _, where = line.strip().partition(" ")
                features.append([kind, where.strip(), {}])
                key = None
            elif features:
                text = line.strip()
                if text.startswith("/"):
                    key, _, value = text[1:].partition("=")
                    features[-1][2].setdefault(key, []).append(value)
                elif key is None:
                    features[-1][1] += text
                else:
                    joint = "" if key == "translation" else " "
                    features[-1][2][key][-1] += joint + text


def _closed(feature: list) -> tuple:
    kind, where, qualifiers = feature
    ends = [int(x) for pair in _PLACE.findall(where) for x in pair if x]
    clean = {k: [v.strip('"') for v in values] for k, values in qualifiers.items()}
    strand = -1 if where.startswith("complement") else 1
    return (kind, min(ends) - 1 if ends else None, max(ends) if ends else None, strand, clean)


PARSERS = {"fasta": fasta, "fastq": fastq, "genbank": genbank}
STARTS = {"fasta": _headed_range(">"), "fastq": _fastq_range, "genbank": _headed_range("LOCUS")}
