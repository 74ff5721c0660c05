"""MinHash near-duplicates by a multi-index Hamming join (operator 1).

A document's set holds its distinct word shingles. Its signature has
``chunks * chunk_len`` MinHash symbols of ``bits`` bits. Signatures are split
into chunks; two signatures that differ in at most ``2 * chunks - 1`` symbols
have, by the pigeonhole principle, a chunk with at most one differing symbol.
Each chunk is therefore indexed ``chunk_len`` times, each time without one of
its symbols (the allowed chunk error), so that every pair within that distance
meets under some key. Pairs that meet are confirmed on their full shingle sets,
so that the result has no false link.

Skew: equal sets become one node before any join. In a key's bucket nobody is
paired with everybody: first all members are tested against the bucket's least
node, the pairs of a node with many of them being split over tasks. Where members of a bucket are then still in different components, pairs
that a prefix filter on their full sets leaves over are tested too (no other pair
can change a component). Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.operators.graph import components

from .common import blocks, cut, stored

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Nodes with more than this share of all pairs (so fewer than its inverse) have them split.
HOT, SPLIT = 10_000, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Fewer
    words than ``width`` make one shingle; no words make the empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix(total + each[i : len(words) - size + 1 + i])
    return np.unique(total)


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One 16-bit MinHash symbol for each multiplier."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[i : i + 2048, None] * multipliers).min(axis=0), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240601).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _describe(width: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(n)
        for keys, places, texts, tokens in blocks(batches, "id", "place", "text", "text_hash"):
            sizes, prints, sigs = [], [], []
            for text in texts:
                hashes = shingle_set(text, width)
                sizes.append(len(hashes))
                prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sigs.append(signature(hashes, multipliers).tobytes() if len(hashes) else None)
            whole = [pa.array(x, pa.int64()) for x in (keys, places, tokens, sizes)]
            yield pa.record_batch(
                [*whole, pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "place", "text_hash", "n_shingles", "fp", "sig"],
            )

    return run


def _keys(chunks: int, chunk_len: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _multipliers(chunks * chunk_len + chunk_len)
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["sig"]), "<u2").reshape(len(batch), chunks, chunk_len)
            each = _mix((sig.astype(np.uint64) + np.uint64(1)) * salt[: chunks * chunk_len].reshape(chunks, chunk_len))
            whole = each.sum(axis=2, dtype=np.uint64)[:, :, None]
            keys = _mix(whole - each + salt[chunks * chunk_len :])  # one symbol left out
            flat = keys.reshape(len(batch), -1).view(np.int64)
            yield pd.DataFrame({"node": batch["node"], "keys": list(flat)})

    return run


def _confirm(width: int, num: int, den: int):
    """Links among rows in order of (a, part, b): first the text of ``a`` (b null), then those of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int | None, np.ndarray] = None, np.empty(0, np.uint64)
        for rows in blocks(batches, "a", "b", "text"):
            linked = []
            for a, b, text in zip(*rows):
                found = shingle_set(text, width)
                if b is None:
                    kept = a, found
                    continue
                if kept[0] != a:
                    raise ValueError(f"no text of node {a}")
                both = len(np.intersect1d(kept[1], found, assume_unique=True))
                if den * both >= num * (len(kept[1]) + len(found) - both):
                    linked.append((a, b))
            ends = list(zip(*linked)) or [(), ()]
            yield pa.record_batch([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order_col: str | None = None,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    chunks: int = 10,
    chunk_len: int = 6,
    max_distance: int = 28,
) -> DataFrame:
    """Near-duplicate classes: (id_col, n_shingles, component_id, kept), a row per row.

    Two documents are linked if ``den * |A & B| >= num * |A | B|`` for their sets of
    ``width``-word shingles; component_id is the least id that links reach, kept
    marks that document. Candidates are all pairs within ``2 * chunks - 1``
    differing symbols (guaranteed) and any farther pair that meets under a key, up to
    ``max_distance``. At a similarity of 0.8 a pair meets under no key with
    probability (1 - 0.8^6 - 6 * 0.2 * 0.8^5)^10 < 3e-5, at 0.85 below 4e-7; it has
    over 28 differing symbols with probability 7e-7, at 0.85 below 1e-9.

    ``order_col`` (else the id) numbers the sets, which decides nothing but how many
    pairs are looked at.

    Null and empty texts (or texts of white space) have no shingles and link with
    nothing. Rows that repeat an id with another text are documents of their own; rows
    with a null id link with nothing, have no component and keep themselves. Other
    columns are ignored, so their names can't clash; an empty table gives an empty
    result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(order_col or id_col).cast("long").alias("place"),
        F.col(text_col).cast("string").alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    base = stored(
        rows.mapInArrow(
            _describe(width, chunks * chunk_len), "id long, place long, text_hash long, n_shingles long, fp binary, sig binary"
        ),
        "near-base",
    )
    # A node for each distinct set; its number is stored with it, so that it never changes. Numbers follow
    # order_col: where the first of a family is what the others were made from, it is the centre of most stars.
    nodes = stored(
        base.filter("n_shingles > 0 and id is not null")
        .groupBy("fp")
        .agg(
            F.min("id").alias("least_id"),
            F.min(F.struct("place", "id", "text_hash")).alias("one"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")
        )
        .select("fp", "least_id", "one.place", "one.id", "one.text_hash", "sig", "n")
        .repartitionByRange("place")
        .sortWithinPartitions("place")
        .select(F.monotonically_increasing_id().alias("node"), "fp", "least_id", "id", "text_hash", "sig", "n"),
        "near-nodes",
    )
    entries = (
        nodes.select("node", "sig")
        .mapInPandas(_keys(chunks, chunk_len), "node long, keys array<bigint>")
        .select("node", F.explode("keys").alias("key"))
    )
    shared = (
        entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    )
    members = stored(entries.join(shared.select("key", "least"), "key"), "near-members")

    star = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    args = (rows, nodes, width, num, den, max_distance)
    links = cut(_confirmed(star, *args))
    found = components(links)

    placed = members.select("key", "node").join(found, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")
    )
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
    mixed = placed.join(split.select("key"), "key", "left_semi").select("node", "root").distinct()
    far = _reachable(stored(mixed, "near-mixed"), rows, nodes, width, num, den)
    tested = star.select("a", "b").distinct()
    more = cut(_confirmed(far.join(tested, ["a", "b"], "left_anti"), *args))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    rooted = nodes.select("fp", "least_id", "node").join(found, "node", "left").select(
        "fp", "least_id", F.coalesce("root", "node").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component")
    result = base.select("id", "n_shingles", "fp").join(classes, "fp", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return result.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _with_texts(roles: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``roles`` (column node) with the text of their node; one row speaks for each.

    Documents are shuffled once, by the key under which they are then counted once and joined.
    """
    key = ["id", "text_hash"]
    named = nodes.select("node", *key).join(roles, "node")
    texts = rows.select(*key, "text").join(named.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min("text").alias("text"))
    return texts.join(named, key).drop(*key)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, roots, texts in blocks(batches, "node", "root", "text"):
            found = [shingle_set(text, width).view(np.int64) for text in texts]
            yield pa.record_batch(
                [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["node", "root", "shingles"],
            )

    return run


def _reachable(mixed: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ``mixed`` (node, root), of different roots, that may still be linked.

    A link between sets of x and y shingles needs num/den of either in common. In
    any order of all shingles, the first ``x - ceil(num * x / den) + 1`` of one must
    then hold one of the other's. The order here starts with shingles of a single
    component, which no such pair shares, and goes on from rare to frequent ones.
    Shingles before the first common one can't be shared either. Documents with
    enough shingles of their own drop out, so that the variants of a large family
    aren't paired.
    """
    sets = stored(
        _with_texts(mixed, rows, nodes)
        .select("node", "root", "text")
        .mapInArrow(_sets(width), "node long, root long, shingles array<bigint>"),
        "near-sets",
    )
    each = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    useful = (
        each.groupBy("shingle")
        .agg(F.count("*").alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        .filter("r0 < r1")
        .select("shingle", "df")
    )
    own = Window.partitionBy("node")
    within = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1
    first = (
        each.join(useful, "shingle")
        .withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")))
        .filter(F.col("place") <= within)
        .select("node", "root", "n", "shingle", "place")
    )
    first = stored(first, "near-first")
    # what two sets can share from their first common shingle on, against what a link needs
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    return (
        first.alias("x")
        .join(first.alias("y"), "shingle")
        .filter("x.node < y.node and x.root <> y.root")
        .filter((num + den) * most >= num * (F.col("x.n") + F.col("y.n")))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, num: int, den: int, far: int) -> DataFrame:
    """Pairs (a, b) whose full sets are linked. Set sizes and signatures rule most others out first."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    near = (
        pairs.distinct()
        .join(side("a"), "a")
        .join(side("b"), "b")
        .filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        .mapInPandas(_within(far), "a long, b long")
    )
    near = stored(near, "near-pairs")
    # pairs are dealt out by a, those of the (under HOT) nodes with a share of all pairs in parts of some SPLIT
    total = near.count()
    hot = near.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"), F.count("*").alias("pairs"))
    hot = hot.filter(F.col("pairs") * HOT > total).select("a", "parts")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))
    near = near.join(F.broadcast(hot), "a", "left").select("a", "b", part.alias("part"))
    heads = near.select(F.col("a").alias("node"), "a", F.lit(None).cast("long").alias("b"), "part").distinct()
    others = near.select(F.col("b").alias("node"), "a", "b", "part")
    return (
        _with_texts(heads.union(others), rows, nodes)
        .select("a", "b", "part", "text")
        .repartition("a", "part")
        .sortWithinPartitions("a", "part", "b")
        .mapInArrow(_confirm(width, num, den), "a long, b long")
    )


def _within(far: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
                yield batch.loc[(a != b).sum(axis=1) <= far, ["a", "b"]]

    return run
