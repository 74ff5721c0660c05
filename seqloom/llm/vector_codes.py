"""Product codes of vectors by Lloyd's algorithm with Hamerly's bounds (operator 12).

Vectors become integers, are cut into equal parts, and every part position has a
codebook. Of each part of each vector a round keeps its entry, an upper bound of the distance
to it and one lower bound of the distance to every other entry. A round lifts and lowers the bounds by
how far entries moved; only where the upper bound isn't strictly below the lower one
(nor, once it is made exact, then) all entries are compared, in integers, the lower
index winning ties. The bounds live in a table that each round reads and writes, so a lost
executor repeats its partitions alone; only codebooks and sums over entries pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Largest integer component: squared distances of parts of 64 stay below 2^53.
LARGEST = 1 << 21
#: Labels that are sent to all tasks; beyond them they are joined, salted.
MOST_LABELS = 1_000_000
SALTS = 32

_ROW = "vec_id long, label string, vector binary"
_STATE = _ROW + ", entry binary, upper binary, lower binary"


@dataclass(frozen=True)
class Codebooks:
    """entries[PARTS, n, width], integers; n is ENTRIES or the number of vectors if that is less."""

    entries: np.ndarray

    def digest(self) -> str:
        """sha256 of all components, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def kept(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vectors are whole and finite, as doubles."""
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    return rows.filter(F.col("vector").isNotNull() & F.forall("vector", _finite))


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * SCALE)
        size = len(flat) // max(1, batch.num_rows)
        rows = flat.astype("<i4").reshape(batch.num_rows, size) if batch.num_rows else flat.reshape(0, 0)
        yield pa.record_batch(
            [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())],
            ["vec_id", "label", "vector"],
        )


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    size = len(column[0].as_py()) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size)


def _binary(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows.astype(kind))], pa.binary())


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries; exact, since all terms are whole and below 2^53."""
    x, c = x.astype(np.float64), entries.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


#: Bounds are 32-bit floats, widened by so much that rounding can't make them too tight.
_WIDER, _NARROWER = 1 + 1e-6, 1 - 1e-6


def assign(x: np.ndarray, entries: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Nearest entries of the rows of ``x`` (lowest index of equals), in place; the number of full scans.

    An entry below 0 is none yet. Where the upper bound is strictly below the lower one the entry
    stays; else the upper bound is made exact, and only if that doesn't help all
    entries are compared.
    """
    unsure = np.flatnonzero((entry < 0) | ~(upper < lower))
    known = unsure[entry[unsure] >= 0]
    exact = ((x[known].astype(np.int64) - entries[entry[known]]) ** 2).sum(axis=1)
    upper[known] = np.sqrt(exact) * _WIDER
    unsure = unsure[(entry[unsure] < 0) | ~(upper[unsure] < lower[unsure])]
    for some in np.array_split(unsure, len(unsure) // 4096 + 1):
        if len(some):
            d = _distances(x[some], entries)
            best = d.argmin(axis=1)
            at = np.arange(len(some))
            entry[some], upper[some] = best, np.sqrt(d[at, best]) * _WIDER
            d[at, best] = np.inf
            lower[some] = np.sqrt(d.min(axis=1)) * _NARROWER
    return len(unsure)


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, moved = shared.value  # moved: how far each entry went since the bounds were written
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), "<i4").reshape(batch.num_rows, PARTS, -1)
            if moved is None:
                entry = np.full((len(x), PARTS), -1, np.int16)
                upper, lower = np.zeros((len(x), PARTS), np.float32), np.zeros((len(x), PARTS), np.float32)
            else:
                entry, upper, lower = (_matrix(batch.column(c), k).copy() for c, k in (("entry", "<i2"), ("upper", "<f4"), ("lower", "<f4")))
                for p in range(PARTS):
                    far = np.sort(moved[p])[::-1]
                    # the others' largest move, for the entry that moved most itself the second largest
                    other = np.where(moved[p][entry[:, p]] == far[0], far[1] if len(far) > 1 else 0.0, far[0])
                    upper[:, p] = (upper[:, p] + moved[p][entry[:, p]]) * _WIDER
                    lower[:, p] = (lower[:, p] - other) * _NARROWER
                lower[lower < 0] = 0
            for p in range(PARTS):
                e, u, b = entry[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                assign(x[:, p], entries[p], e, u, b)
                entry[:, p], upper[:, p], lower[:, p] = e, u, b
            yield pa.record_batch(
                [
                    batch.column("vec_id"), batch.column("label"), batch.column("vector"),
                    _binary(entry, "<i2"), _binary(upper, "<f4"), _binary(lower, "<f4"),
                ],
                ["vec_id", "label", "vector", "entry", "upper", "lower"],
            )

    return run


def _sums(n: int):
    """Of each part position and entry: how many parts it has and their sums, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, n), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), "<i4").astype(np.int64).reshape(batch.num_rows, PARTS, -1)
            entry = _matrix(batch.column("entry"), "<i2")
            sums = np.zeros((PARTS, n, x.shape[2]), np.int64) if sums is None else sums
            for p in range(PARTS):
                order = np.argsort(entry[:, p], kind="stable")
                some, first = np.unique(entry[order, p], return_index=True)
                sums[p, some] += np.add.reduceat(x[order, p], first, axis=0)
                counts[p] += np.bincount(entry[:, p], minlength=n)
        if sums is not None:
            part, at = np.nonzero(counts)
            yield pa.record_batch(
                [pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[part, at]), pa.array(sums[part, at].tolist(), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"],
            )

    return run


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry at the floor of its parts' mean; unused ones stay."""
    width = books.shape[2]
    each = state.select("vector", "entry").mapInArrow(_sums(books.shape[1]), "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    new = books.copy()
    for row in total.collect():  # PARTS * ENTRIES rows at most
        new[row.part, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return new


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), "<i4").astype(np.int64).reshape(batch.num_rows, PARTS, -1)
            entry = _matrix(batch.column("entry"), "<i2")
            error = sum(((x[:, p] - entries[p][entry[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
            codes = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return run


def encode(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks) of the rows of ``df`` with whole, finite vectors.

    Rows whose vector is null or holds null, NaN or infinite components are left out, and so
    are vectors of another length than that of the least vec_id's: no codebook
    fits them. A length that PARTS doesn't divide, and components of LARGEST or more
    (after scaling), are errors. Codebooks start as the parts of the ENTRIES least vec_ids
    (ties: the lesser vector; null ids last), of all vectors if there are fewer. Repeated rows are
    coded each; an empty table gives an empty result and empty codebooks; other columns are ignored.
    """
    session = df.sparkSession
    rows = kept(df, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    if not first:
        none = session.createDataFrame([], "vec_id long, label string, code string, error long")
        return none, Codebooks(np.zeros((PARTS, 0, 0), np.int64))
    size = len(first[0].vector)
    if size == 0 or size % PARTS:
        raise ValueError(f"vectors of {size} components")
    fitting = rows.filter(F.size("vector") == size)
    if len({len(r.vector) for r in first}) > 1:  # others take the place of those that don't fit
        first = fitting.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    bound = F.max(F.array_max(F.transform("vector", F.abs)))
    if fitting.agg(bound).first()[0] * SCALE >= LARGEST - 1:
        raise ValueError("components too large for exact distances")
    books = np.floor(np.array([r.vector for r in first]) * SCALE).astype(np.int64)
    books = books.reshape(len(books), PARTS, size // PARTS).transpose(1, 0, 2)
    state, moved = fitting.mapInArrow(_integers, _ROW), None
    for number in range(rounds + 1):
        shared = session.sparkContext.broadcast((books, moved))  # PARTS * ENTRIES entries
        state = stored(state.mapInArrow(_assigned(shared), _STATE), "vector-bounds")
        if number < rounds:
            new = _moved(state, books)
            moved, books = np.sqrt(((new - books) ** 2).sum(axis=2)) * _WIDER, new
    final = session.sparkContext.broadcast(books)
    return state.mapInArrow(_coded(final), "vec_id long, label string, code string, error long"), Codebooks(books)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Rows with ``label_error``: the error summed over rows of equal label, nulls together.

    Sums are made before the join; they go to all tasks if there are at most MOST_LABELS of
    them, else they are joined by label, the rows of a label spread over SALTS tasks.
    """
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    sums = stored(sums, "label-errors")
    same = coded["label"].eqNullSafe(sums["__label"])
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("__label")
    each = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = coded.withColumn("__of", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    both = salted["label"].eqNullSafe(each["__label"]) & (salted["__of"] == each["__salt"])
    return salted.join(each, both).drop("__label", "__of", "__salt")
