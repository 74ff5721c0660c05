"""Token ids in files of independent zstandard frames (operator 8).

File format (zstandard's seekable format): one frame for each document, in
ascending order of ids, holding its token ids as little-endian unsigned 32-bit
integers; one more frame with the number of null ids (which come first), the
documents' ids and their token counts (all int64); then the seek table in a skippable frame, with every frame's compressed and
decompressed size and the low 32 bits of the XXH64 of its content. A reader takes
the table from the file's end and decompresses only the frames it wants.

Documents are dealt out by ranges of ids and sorted within them; each task writes
one file under a name of its own attempt, so that a task that runs again never
touches another's file. The manifest (a row per file) is a table in the shared
folder; where a document's ids start follows from the counts of the files before.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .common import blocks, checkpoint_dir, stored

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part long, path string, n_docs long, n_ids long"


class TextIds:
    """Ids of texts, with a bounded cache of the chunks between white space.

    A space or line end with no white space next to it always starts a split word
    of the tokenizer, and merges stay within split words, so that the ids of a text
    are those of its chunks. Chunks are kept without their leading space. Those that
    the cache lacks are encoded joined up: only their first tokens begin with a
    space or line end. Texts with other white space in a row, or with the string of
    an added token, are encoded whole.
    Chunks go from a young to an old generation and stay for as long as they are met.
    """

    def __init__(self, path: str, bound: int = 600_000):
        self._tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._odd = re.compile("|".join([r"\s\s", *added])).search
        vocabulary = self._tokenizer.get_vocab()
        self._starts = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space or line end
        self._starts[[i for piece, i in vocabulary.items() if piece[0] in "\u0120\u010a"]] = True
        self._bound, self._young, self._old = bound, {}, {}

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 1000):
            some = chunks[i : i + 1000]
            joined = (" " + " ".join(some)).replace(" \n", "\n")
            (made,) = self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            at = [*(4 * np.flatnonzero(self._starts[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self._young.update(zip(some, [data[p:q] for p, q in zip(at, at[1:])], strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        if len(self._young) > self._bound:
            self._old, self._young = self._young, {}
        look, new, out, open_places = self._young.get, {}, [], []
        for text in texts:
            if not text or self._odd(text):
                out.append([self._whole(text) if text else b""])
                continue
            chunks = text.replace("\n", " \n").split(" ")
            first, chunks[0] = chunks[0], None
            ids = list(map(look, chunks))
            ids[0] = self._whole(first) if first else b""
            at = 0
            try:
                while True:  # the places that the cache leaves open
                    at = ids.index(None, at + 1)
                    new[chunks[at]] = None
                    open_places.append((ids, at, chunks[at]))
            except ValueError:
                out.append(ids)
        again = {c: self._old[c] for c in new if c in self._old}
        self._young.update(again)
        self._learn([c for c in new if c not in again])
        for ids, at, chunk in open_places:
            ids[at] = look(chunk)
        return [b"".join(ids) for ids in out]


@lru_cache(maxsize=1)
def _text_ids(path: str) -> TextIds:
    """One for all tasks of a Python worker."""
    return TextIds(path)


class FrameWriter:
    """Writes frames and, on close, the seek table."""

    def __init__(self, sink, level: int):
        self._sink, self._compress, self._table = sink, zstandard.ZstdCompressor(level=level).compress, []

    def write(self, content: bytes) -> None:
        frame = self._compress(content)
        self._sink.write(frame)
        self._table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        entries = b"".join(self._table)
        self._sink.write(struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries)
        self._sink.write(struct.pack("<IBI", len(self._table), 0x80, _SEEKABLE))
        self._sink.close()


def seek_table(file) -> np.ndarray:
    """Rows (offset, compressed size, size, checksum) of an open file's frames."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE or flags != 0x80:
        raise ValueError("not a file of frames with checksums")
    file.seek(end - 9 - 12 * n)
    entries = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(entries[:, 0])[:-1]]) if n else np.empty(0, np.int64)
    return np.column_stack([starts, entries])


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def read_frame(file, table: np.ndarray, i: int) -> bytes:
    """The content of frame ``i``, held against its checksum."""
    start, packed, size, check = map(int, table[i])
    file.seek(start)
    content = _decompressor().decompress(file.read(packed), max_output_size=max(size, 1))
    if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
        raise ValueError(f"frame {i} is damaged")
    return content


def read_index(file, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the id is null, ids and token counts of a file's documents."""
    content = np.frombuffer(read_frame(file, table, len(table) - 1), "<i8")
    ids, counts = content[1:].reshape(2, -1)
    return np.arange(len(ids)) < content[0], ids, counts


def read_documents(path: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """Token ids of the wanted documents; only their frames are read."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as file:
        table = seek_table(file)
        null, ids, _ = read_index(file, table)
        at = np.flatnonzero(np.isin(ids, list(wanted)) & ~null)
        return {int(ids[i]): np.frombuffer(read_frame(file, table, i), "<u4") for i in at}


def _write(folder: str, tokenizer_path: str, end_id: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids, counts, nulls = None, array("q"), array("q"), 0
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.ids.zst"
        end = struct.pack("<I", end_id)
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for keys, texts in blocks(batches, "id", "text", rows=64):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = FrameWriter(fs.open_output_stream(f"{root}/.{name}", compression=None), level)
            for key, content in zip(keys, _text_ids(tokenizer_path).encode(texts)):
                out.write(content + end)
                nulls += key is None
                ids.append(0 if key is None else key)
                counts.append(len(content) // 4 + 1)
        if out is not None:
            out.write(np.concatenate([[nulls], ids, counts]).astype("<i8").tobytes())
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            row = {"part": context.partitionId(), "path": f"{folder}/{name}", "n_docs": len(ids), "n_ids": sum(counts)}
            yield pa.RecordBatch.from_pylist([row])

    return run


def write(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    level: int = 3,
) -> DataFrame:
    """Encode and write all documents; returns the manifest (part, path, n_docs, n_ids).

    Files follow each other in ascending order of ids, nulls first. A null text has
    no ids but ``end_id``, which is appended to every document. The string of an added
    token becomes that token's id, as the library has it. Rows that repeat an
    id are documents of their own, in order of a hash of their texts. Other columns are ignored, so their names can't
    clash. An empty table writes no file and gives an empty manifest.
    """
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-frames-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the hash splits rows of one id (or of none) over several ranges
    order = [F.col("id"), F.xxhash64("text")]
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _write(folder, tokenizer_path, end_id, level), MANIFEST
    )
    return stored(made, "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for paths, bases in blocks(batches, "path", "base"):
        for path, base in zip(paths, bases):
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as file:
                table = seek_table(file)
                null, ids, counts = read_index(file, table)
                checks = np.fromiter((zlib.crc32(read_frame(file, table, i)) for i in range(len(ids))), np.int64, len(ids))
            columns = [pa.array(ids, mask=null), int(base) + np.cumsum(counts) - counts, counts, checks]
            yield pa.record_batch([pa.array(c) for c in columns], ["id", "start", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files.

    start counts the ids of all documents before; every frame is held against its
    checksum. A file is read frame by frame, never as a whole.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    found = files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)
