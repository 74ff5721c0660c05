"""Operators on contigs, genes, pieces of genomes and alignments of many sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from seqloom.functions.sequences import gc_content, kmer_of
from seqloom.storage import cut, dealt, in_small_groups, stored
from .blocks import block_pairs, number_of_blocks, of_block
from .graph import components
from .joins import divided, point_in_interval, range_join


def coding_density(contigs: DataFrame, genes: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, density): summed gene lengths (end - start) over summed contig lengths.

    ``contigs`` has by and length, ``genes`` by, start and end.
    """
    coding = genes.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("coding"))
    sizes = contigs.groupBy(*by).agg(F.sum("length").alias("size"))
    density = F.try_divide(F.coalesce("coding", F.lit(0)).cast("double"), F.col("size").cast("double"))
    return sizes.join(coding, by, "left").select(*by, "size", density.alias("density"))


def contig_table(contigs: DataFrame, depth: DataFrame, genes: DataFrame) -> DataFrame:
    """(genome, contig, size, gc, avg_cov, med_cov, density) of contigs (genome, contig, seq),
    depth (genome, contig, pos, cov) and genes (genome, contig, start, end)."""
    key = ["genome", "contig"]
    lengths = contigs.select(*key, F.char_length("seq").cast("long").alias("length"), gc_content(F.col("seq")).alias("gc"))
    coverage = depth.groupBy(*key).agg(F.avg("cov").alias("avg_cov"), F.median("cov").alias("med_cov"))
    return (
        coding_density(lengths, genes, key)
        .join(lengths.select(*key, "gc"), key)
        .join(coverage, key, "left")
        .select(*key, "size", "gc", "avg_cov", "med_cov", "density")
    )


def genome_table(contigs: DataFrame, depth: DataFrame, genes: DataFrame) -> DataFrame:
    """(genome, size, n_contigs, avg_cov, med_cov, density): coverage over all places of a genome."""
    lengths = contigs.select("genome", F.char_length("seq").cast("long").alias("length"))
    coverage = depth.groupBy("genome").agg(F.avg("cov").alias("avg_cov"), F.median("cov").alias("med_cov"))
    counts = lengths.groupBy("genome").agg(F.count("*").alias("n_contigs"))
    found = coding_density(lengths, genes, ["genome"]).join(counts, "genome").join(coverage, "genome", "left")
    return found.select("genome", "size", "n_contigs", "avg_cov", "med_cov", "density")


def gene_table(depth: DataFrame, genes: DataFrame, width: int = 1000) -> DataFrame:
    """(genome, contig, gene, size, avg_cov, med_cov, copies) of genes with depth (both ends inclusive).

    ``copies`` is the gene's coverage over its genome's median.
    """
    spans = genes.select("genome", "contig", "gene", "start", "end")
    held = point_in_interval(depth, spans, ["genome", "contig"], "pos", "start", "end", width, how="inner")
    per = held.groupBy("genome", "contig", "gene").agg(
        F.any_value(F.col("end") - F.col("start")).alias("size"), F.avg("cov").alias("avg_cov"), F.median("cov").alias("med_cov")
    )
    medians = depth.groupBy("genome").agg(F.median("cov").alias("genome_med"))
    return per.join(medians, "genome").select(
        "genome", "contig", "gene", "size", "avg_cov", "med_cov", F.try_divide("avg_cov", "genome_med").alias("copies")
    )


def coverage_summary(contigs: DataFrame, by: str) -> DataFrame:
    """(by, weighted, mean, sd): coverage weighted by size, and the plain mean of contigs with its population deviation."""
    weighted = F.try_divide(F.sum(F.col("avg_cov") * F.col("size")), F.sum("size"))
    return contigs.groupBy(by).agg(weighted.alias("weighted"), F.avg("avg_cov").alias("mean"), F.stddev_pop("avg_cov").alias("sd"))


def ambiguous_runs(df: DataFrame, by: str, at: str, letter: str, min_length: int, most: int) -> DataFrame:
    """(by, first, last): regions of a consensus with at most ``most`` ambiguity codes and no gap.

    A region starts at a plain letter after a code, a gap or the start, and reaches to
    the place before the first code too many, a gap or the end. ``at`` counts from 0.
    """
    w = Window.partitionBy(by).orderBy(at)
    gap, plain = F.col(letter) == "-", F.col(letter).isin("A", "C", "G", "T")
    placed = df.select(
        by,
        at,
        gap.alias("__gap"),
        plain.alias("__plain"),
        F.coalesce(F.lag(plain).over(w), F.lit(False)).alias("__before"),
        F.sum(gap.cast("int")).over(w).alias("__run"),
    ).filter(~F.col("__gap"))
    run = Window.partitionBy(by, "__run").orderBy(at)
    codes = F.sum((~F.col("__plain")).cast("int")).over(run)
    placed = placed.withColumn("__codes", codes).withColumn("__end", F.max(at).over(Window.partitionBy(by, "__run")))
    starts = placed.filter(F.col("__plain") & ~F.col("__before"))
    stops = placed.filter(~F.col("__plain")).select(by, "__run", (F.col("__codes") - most - 1).alias("__codes"), F.col(at).alias("__stop"))
    found = starts.join(stops, [by, "__run", "__codes"], "left")
    last = F.coalesce(F.col("__stop") - 1, F.col("__end"))
    return found.select(by, F.col(at).alias("first"), last.alias("last")).filter(F.col("last") - F.col("first") + 1 >= min_length)


def _planes(strings: pd.Series) -> Callable[[pd.Series], np.ndarray]:
    """A function that packs strings of the letters in ``strings``: rows x bits of a letter x longs."""
    letters = sorted(set().union(*strings))
    code = {c: i for i, c in enumerate(letters)}
    bits = max(1, (len(letters) - 1).bit_length())
    table = {ord(c): chr(i) for c, i in code.items()}

    def pack(some: pd.Series) -> np.ndarray:
        text = [s.translate(table) for s in some]
        codes = np.array([np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in text], np.uint32)
        codes = np.pad(codes, [(0, 0), (0, -codes.shape[1] % 64)])
        planes = [np.packbits((codes >> b & 1).astype(np.uint8), axis=1).view(np.uint64) for b in range(bits)]
        return np.stack(planes, axis=1)

    return pack


def _differing(rows: pd.DataFrame, width: int = 128):
    """(keys of a strip of block i, keys of block j, matrix of how many places differ, places of a string)."""
    x, y = of_block(rows, "i"), of_block(rows, "j")
    if not (len(x) and len(y)):
        return
    pack = _planes(rows["s"])
    px, py = pack(x["s"]), pack(y["s"])
    kx, ky = x["k"].to_numpy(), y["k"].to_numpy()
    for at in range(0, len(kx), width):
        some = px[at : at + width]
        d = np.zeros((len(some), len(py)), np.uint16)
        for word in range(py.shape[2]):
            apart = some[:, None, 0, word] ^ py[None, :, 0, word]
            for b in range(1, py.shape[1]):
                apart |= some[:, None, b, word] ^ py[None, :, b, word]
            d += np.bitwise_count(apart)
        yield kx[at : at + width], ky, d


def _dealt(one: DataFrame) -> tuple[int, Column]:
    n = number_of_blocks(one.count())
    return n, F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")


def near_pairs(df: DataFrame, key: str, seq: str, length: int, most: int) -> DataFrame:
    """(a, b, distance): pairs of distinct strings of ``length`` letters that differ in at most ``most`` places.

    a and b are the least keys of equal strings (see same_strings() for the others).
    All strings are compared, block by block, as packed bits: parts that near strings
    agree in are too short here to set many apart.
    """
    one = cut(df.groupBy(F.col(seq).alias("s")).agg(F.min(key).alias("k")).filter("s IS NOT NULL"))
    kind = dict(one.dtypes)["k"]

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        for kx, ky, d in _differing(rows):
            p, q = np.nonzero(d <= most)
            if same:
                later = kx[p] < ky[q]
                p, q = p[later], q[later]
            a, b = kx[p], ky[q]
            swap = a > b
            yield pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "distance": d[p, q].astype(int)})

    return block_pairs(one, *_dealt(one), run, f"a {kind}, b {kind}, distance int")


def same_strings(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, group, n): rows that nothing sets apart, by the least key of their string."""
    groups = df.groupBy(seq).agg(F.min(key).alias("group"), F.count("*").alias("n"))
    return df.join(groups, seq).select(key, "group", "n")


def least_distances(df: DataFrame, key: str, seq: str, length: int) -> DataFrame:
    """(key, distance): how many places set each row apart from the row most like it; null for a single row.

    Strings have ``length`` letters. Equal strings are 0 apart; all others are compared, block by
    block, and each block names a row's least distance in it.
    """
    groups = cut(df.groupBy(F.col(seq).alias("s")).agg(F.min(key).alias("k"), F.count("*").alias("n")).filter("s IS NOT NULL"))
    kind = dict(groups.dtypes)["k"]

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        none = np.iinfo(np.uint16).max
        below, other = None, None
        for kx, ky, d in _differing(rows):
            if same:
                d[kx[:, None] == ky[None, :]] = none
            yield pd.DataFrame({"k": kx, "distance": d.min(axis=1).astype(int)})
            other = ky
            below = d.min(axis=0) if below is None else np.minimum(below, d.min(axis=0))
        if other is not None and not same:
            yield pd.DataFrame({"k": other, "distance": below.astype(int)})

    met = block_pairs(groups.select("k", "s"), *_dealt(groups), run, f"k {kind}, distance int")
    each = met.filter(F.col("distance") < int(np.iinfo(np.uint16).max)).groupBy("k").agg(F.min("distance").alias("d"))
    known = groups.join(each, "k", "left").select(F.col("s").alias("__s"), F.when(F.col("n") > 1, 0).otherwise(F.col("d")).cast("int").alias("distance"))
    return df.join(known, F.col(seq) == F.col("__s")).select(key, "distance")


def least_distance(df: DataFrame, key: str, seq: str, length: int) -> int | None:
    """The least distance of two rows' strings; None for fewer than two rows."""
    return least_distances(df, key, seq, length).agg(F.min("distance")).first()[0]


def near_groups(df: DataFrame, key: str, seq: str, length: int, most: int) -> DataFrame:
    """(key, group): rows linked by strings at most ``most`` apart, straight or by others; the group's least key."""
    same = same_strings(df, key, seq)
    linked = components(near_pairs(df, key, seq, length, most).select("a", "b"))
    return same.join(linked, same["group"] == linked["node"], "left").select(key, F.coalesce("root", "group").alias("group"))


def consensus(cells: DataFrame, by: str, at: str, letter: str) -> DataFrame:
    """(by, at, entropy, code) of alignment columns given as cells: Shannon entropy (base 2) and IUPAC code."""
    from seqloom.functions.sequences import iupac_consensus, shannon_entropy

    counts = cells.groupBy(by, at, letter).agg(F.count("*").alias("n"))
    return counts.groupBy(by, at).agg(
        shannon_entropy(F.collect_list(F.col("n").cast("double"))).alias("entropy"),
        iupac_consensus(F.collect_set(letter)).alias("code"),
    )


def failing_histograms(failed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (amplicon, genome) failures: ((failing, n) amplicons by how many genomes fail; (genome, n) failures;
    (genome, n) failures where the genome is the only one)."""
    rows = failed.select("amplicon", "genome").distinct()
    per = rows.groupBy("amplicon").agg(F.count("*").alias("failing"), F.min("genome").alias("genome"))
    by_number = per.groupBy("failing").agg(F.count("*").alias("n"))
    by_genome = rows.groupBy("genome").agg(F.count("*").alias("n"))
    return by_number, by_genome, per.filter("failing = 1").groupBy("genome").agg(F.count("*").alias("n"))


def shared_pairs(hits: DataFrame, genomes: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b): pieces that follow each other within the given span in every genome.

    ``hits``: (piece, genome, contig, start); ``genomes``: (genome).
    """
    near = range_join(hits, hits, ["genome", "contig"], "start", "start", low, high).filter(F.col("piece") != F.col("r_piece"))
    pairs = near.select("genome", F.struct(F.col("piece").alias("a"), F.col("r_piece").alias("b")).alias("pair"))
    return divided(pairs, "pair", "genome", genomes).select("pair.a", "pair.b")


def fuzzy_division(kmers: DataFrame, links: DataFrame, genomes: DataFrame) -> DataFrame:
    """(fuzzy, kmer): fuzzy k-mers that every genome has in some spelling, with all of these.

    ``kmers``: (kmer, genome); ``links``: (kmer, fuzzy), the bridge between them.
    """
    held = kmers.join(genomes, "genome", "left_semi").select("kmer", "genome").distinct().join(links, "kmer")
    common = divided(held, "fuzzy", "genome", genomes)
    return held.join(common, "fuzzy", "left_semi").select("fuzzy", "kmer").distinct()


def conserved_in_groups(kmers: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """(label, kmer, n_genomes): k-mers in at least ``share`` of a group's genomes, for groups of two or more.

    ``kmers``: (genome, kmer); ``groups``: (genome, taxon). The label is ``taxon(n=k)``.
    """
    sizes = groups.groupBy("taxon").agg(F.count_distinct("genome").alias("size")).filter("size > 1")
    held = kmers.select("genome", "kmer").distinct().join(groups.select("genome", "taxon").distinct(), "genome")
    counts = held.groupBy("taxon", "kmer").agg(F.count("*").alias("n_genomes")).join(sizes, "taxon")
    label = F.concat("taxon", F.lit("(n="), F.col("size").cast("string"), F.lit(")"))
    return counts.filter(F.col("n_genomes") >= F.ceil(share * F.col("size"))).select(label.alias("label"), "kmer", "n_genomes")


def kmer_codes(df: DataFrame, seq: str, k: int, distinct: bool = True) -> DataFrame:
    """Rows with ``kmers`` (array<int>): the k-mers of their As, Cs, Gs and Ts alone, as numbers of base 4 (see kmer_of()).

    All other letters are left out first, so that k-mers may bridge them. k is at most 15. A few rows
    at a time are taken through as one array of letters. ``distinct``: each k-mer of a row once, in order.
    """
    keys = [c for c in df.columns if c != seq]
    code = np.full(256, 4, np.uint8)
    code[list(b"ACGT")] = range(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [s or b"" for s in part.column(seq).cast(pa.binary()).to_pylist()]
                letters = code[np.frombuffer(b"".join(texts), np.uint8)]
                row = np.repeat(np.arange(len(texts)), [len(s) for s in texts])[letters < 4]
                letters = letters[letters < 4]
                n = max(0, len(letters) - k + 1)
                value = np.zeros(n, np.int64)
                for i in range(k):
                    value = value << 2 | letters[i : n + i]
                whole = row[:n] == row[len(row) - n :]
                found = row[:n][whole] << 2 * k | value[whole]
                found = np.unique(found) if distinct else found
                ends = np.searchsorted(found >> 2 * k, np.arange(len(texts) + 1))
                kmers = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((found & (1 << 2 * k) - 1), pa.int32()))
                yield pa.record_batch([*[part.column(c) for c in keys], kmers], [*keys, "kmers"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "kmers array<int>"]))


def conserved_of_sets(sets: DataFrame, k: int, share: float) -> DataFrame:
    """conserved_in_groups() of sets (genome, taxon, kmers), kmers being kmer_codes().

    Only sets are shuffled; k-mers are counted where they lie first. Several rows of a genome are one.
    """
    lists = sets.filter(F.size("kmers") > 0).groupBy("genome", "taxon").agg(F.collect_list("kmers").alias("l"))
    whole = F.when(F.size("l") == 1, F.get("l", F.lit(0))).otherwise(F.array_distinct(F.flatten("l")))
    one = stored(lists.select("genome", "taxon", whole.alias("kmers")), "kmer-sets")
    sizes = one.groupBy("taxon").agg(F.count("genome").alias("size")).filter("size > 1")
    counts = one.select("taxon", F.explode("kmers").alias("code")).groupBy("taxon", "code").agg(F.count("*").alias("n_genomes")).join(sizes, "taxon")
    label = F.concat("taxon", F.lit("(n="), F.col("size").cast("string"), F.lit(")"))
    kept = counts.filter(F.col("n_genomes") >= F.ceil(share * F.col("size")))
    return kept.select(label.alias("label"), kmer_of(F.col("code"), k).alias("kmer"), "n_genomes")


def signature_differences(counts: DataFrame, k: int) -> DataFrame:
    """(a, b, difference) of all pairs of profiles (name, kmer, value): mean absolute difference over all 4^k k-mers.

    Only k-mers that both have are joined: |x - y| = x + y - 2 min(x, y).
    """
    sums = counts.groupBy("name").agg(F.sum("value").alias("total"))
    x, y = counts.alias("x"), counts.alias("y")
    both = x.join(y, (F.col("x.kmer") == F.col("y.kmer")) & (F.col("x.name") < F.col("y.name"))).groupBy(
        F.col("x.name").alias("a"), F.col("y.name").alias("b")
    ).agg(F.sum(F.least("x.value", "y.value")).alias("shared"))
    sa, sb = sums.select(F.col("name").alias("a"), F.col("total").alias("ta")), sums.select(F.col("name").alias("b"), F.col("total").alias("tb"))
    return both.join(sa, "a").join(sb, "b").select("a", "b", ((F.col("ta") + F.col("tb") - 2 * F.col("shared")) / F.lit(4**k)).alias("difference"))


def painted(alignments: DataFrame, by: str, start: str, end: str, key: str, width: int = 10_000) -> DataFrame:
    """(by, key, start, end): which alignment each place of a subject is taken from, the longest first (ties: the least key).

    Ends are inclusive. Places between two neighbouring ends of alignments belong
    together, so that only these segments are looked up; ``width`` is about the length of an alignment.
    """
    most = 2 * alignments.count()
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    ends = alignments.select(by, F.explode(F.array(F.col(start), F.col(end) + 1)).alias("at"))
    w = Window.partitionBy(by).orderBy("at")
    segments = dealt(ends, [by], most).distinct().withColumn("__to", F.lead("at").over(w) - 1).filter("__to IS NOT NULL")
    cells = alignments.select(by, start, end, key, F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))).alias("__bucket"))
    p = dealt(segments.withColumn("__bucket", bucket(F.col("at"))), [by, "__bucket"], most)
    held = p.join(dealt(cells, [by, "__bucket"], most), [by, "__bucket"]).filter(F.col("at").between(F.col(start), F.col(end)))
    best = held.groupBy(by, "__bucket", "at", "__to").agg(F.min_by(key, F.struct((F.col(start) - F.col(end)).alias("n"), key)).alias(key))
    best = dealt(best.drop("__bucket"), [by], most)
    # neighbouring segments of one alignment are one stretch
    before = F.lag(F.struct(key, "__to")).over(w)
    opens = before.isNull() | (before[key] != F.col(key)) | (before["__to"] + 1 != F.col("at"))
    runs = best.withColumn("__run", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    return runs.groupBy(by, key, "__run").agg(F.min("at").alias(start), F.max("__to").alias(end)).drop("__run")


def _beside(a_contig: Column, a_node: Column, b_contig: Column, b_node: Column) -> Column:
    return (a_contig == b_contig) & (F.abs(a_node - b_node) == 1)


def pieces_in_order(pieces: DataFrame, by: str) -> DataFrame:
    """Found pieces with ``ordered``: whether both neighbours lie beside them on the other assembly.

    ``pieces``: (by, piece, contig, node, last), contig null for a piece not found; node
    is its place on the contig and last the contig's last. Two pieces that both end a
    contig fit too: the assembly may break there. Missing pieces are skipped.
    """
    return pieces.filter("contig IS NOT NULL").withColumn("ordered", _in_order(Window.partitionBy(by).orderBy("piece")))


def _in_order(w: WindowSpec) -> Column:
    """Whether the pieces before and after, of found ones only, lie beside this one."""
    end = (F.col("node") == 0) | (F.col("node") == F.col("last"))
    me = F.struct("contig", "node", end.alias("end"))

    def fits(other: Column) -> Column:
        beside = _beside(other["contig"], other["node"], F.col("contig"), F.col("node"))
        return other.isNull() | beside | (other["end"] & end)

    return fits(F.lag(me).over(w)) & fits(F.lead(me).over(w))


def found_and_ordered(pieces: DataFrame, by: str, min_identity: float) -> DataFrame:
    """(by, found, ordered): shares of all pieces that are found with enough identity, and that lie in order."""
    there = F.col("contig").isNotNull()
    # missing pieces are a window of their own, so that found ones are neighbours without a join
    marked = pieces.withColumn("ordered", there & _in_order(Window.partitionBy(by, there).orderBy("piece")))
    good = there & (F.col("identity") >= min_identity)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return marked.groupBy(by).agg(share(good).alias("found"), share(F.col("ordered")).alias("ordered"))


#: Placements of a run of ambiguous pieces that one task may hold.
MOST_PLACEMENTS = 5000


def chosen_placements(placements: DataFrame, by: str) -> DataFrame:
    """(by, piece, contig, node): one placement for each piece, (by, piece, contig, node, last).

    Pieces with one placement keep it. For a run of neighbouring pieces with several,
    the longest chain of placements of which each fits the one before (beside it, or
    both at ends of contigs) is taken; among equally long ones that which fits best to the
    pieces next to the run (beside: 3, both at ends: 1), then the first. Runs are
    short; one of more than MOST_PLACEMENTS placements is an error.
    """
    w = Window.partitionBy(by, "piece")
    ambiguous = placements.withColumn("n", F.count("*").over(w))
    # runs: a break wherever the piece before isn't ambiguous
    several = ambiguous.filter("n > 1").select(by, "piece").distinct()
    order = Window.partitionBy(by).orderBy("piece")
    runs = several.withColumn("__new", (F.lag("piece").over(order).isNull() | (F.lag("piece").over(order) < F.col("piece") - 1)).cast("int"))
    runs = runs.withColumn("run", F.sum("__new").over(order)).drop("__new")
    bounds = runs.groupBy(by, "run").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    single = ambiguous.filter("n = 1").select(by, "piece", "contig", "node", "last")
    inside = ambiguous.filter("n > 1").join(runs, [by, "piece"]).select(by, "run", "piece", "contig", "node", "last", F.lit(0).alias("side"))
    near = single.select(by, F.col("piece").alias("__p"), "contig", "node", "last")
    side = lambda at, name: bounds.select(by, "run", (F.col(at) + (-1 if name < 0 else 1)).alias("__p"), F.lit(name).alias("side")).join(near, [by, "__p"])
    flanks = reduce(DataFrame.unionByName, [side("low", -1), side("high", 1)]).withColumnRenamed("__p", "piece")
    kind = dict(placements.dtypes)
    schema = f"{by} {kind[by]}, piece {kind['piece']}, contig {kind['contig']}, node {kind['node']}"
    best = in_small_groups(inside.unionByName(flanks), [by, "run"], _best_chain, schema)
    return single.select(by, "piece", "contig", "node").unionByName(best)


def _best_chain(rows: list[tuple]) -> list[tuple]:
    """Of rows (by, run, piece, contig, node, last, side) the chosen (by, piece, contig, node)."""
    at = sorted(r[2:6] for r in rows if r[6] == 0)
    if len(at) > MOST_PLACEMENTS:
        raise ValueError(f"a run of {len(at)} placements")
    flank = {r[6]: r[2:6] for r in rows if r[6] != 0}
    beside = lambda x, y: x[1] == y[1] and abs(x[2] - y[2]) == 1
    ends = lambda x: x[2] in (0, x[3])
    fit = lambda x, y: 3 if beside(x, y) else 1 if ends(x) and ends(y) else 0
    longest: list[tuple[int, int, int | None]] = []  # length, score of its start, the one before
    for i, x in enumerate(at):
        best = (1, fit(flank[-1], x) if -1 in flank else 0, None)
        for j in range(i):
            if at[j][0] < x[0] and fit(at[j], x) and (longest[j][0] + 1, longest[j][1]) > best[:2]:
                best = (longest[j][0] + 1, longest[j][1], j)
        longest.append(best)
    last = max(range(len(at)), key=lambda i: (longest[i][0], longest[i][1] + (fit(at[i], flank[1]) if 1 in flank else 0), -i))
    chain: list[int] = []
    now: int | None = last
    while now is not None:
        chain.append(now)
        now = longest[now][2]
    return [(rows[0][0], *at[i][:3]) for i in reversed(chain)]


def least_unique_regions(msa: DataFrame, by: str, seq: str, margin: int, step: int = 5) -> DataFrame:
    """(by, start, end): about the shortest middle part (0-based half-open) that tells all rows of an alignment apart.

    Halves the distance between the widest region (``margin`` from either end) and the
    middle on both sides for as long as more than ``step`` places are at stake. Nulls where
    even the widest doesn't tell them apart.

    All alignments are bisected side by side: a round counts equal parts by (alignment, part), so
    that neither many alignments nor one of very many rows comes into one task.
    """
    rows = cut(msa.select(F.col(by).alias("g"), F.col(seq).alias("s")).filter("s IS NOT NULL"))
    total = rows.groupBy("g").agg(F.min(F.char_length("s")).alias("t"))
    middle = F.floor(F.col("t") / 2).cast("int")
    state = cut(total.select("g", F.lit(margin).alias("low"), (F.col("t") - margin).alias("high"), middle.alias("left"), middle.alias("right")))

    def apart(asked: DataFrame) -> DataFrame:
        """(g, apart) of regions (g, a, b)."""
        part = F.substr("s", F.col("a") + 1, F.col("b") - F.col("a"))
        equal = rows.join(asked, "g").groupBy("g", F.md5(F.encode(part, "UTF-8")).alias("part")).agg(F.count("*").alias("n"))
        return equal.groupBy("g").agg((F.max("n") == 1).alias("apart"))

    verdict = apart(state.filter("low < high").select("g", F.col("low").alias("a"), F.col("high").alias("b")))
    state = cut(state.join(verdict.filter("apart").select("g"), "g", "left_semi"))
    closed = state.limit(0)
    while True:
        wide = f"left - low > {step} OR high - right > {step}"
        closed = cut(closed.unionByName(state.filter(f"NOT ({wide})")))
        state = state.filter(wide)
        if state.isEmpty():
            break
        asked = state.withColumns({"a": F.floor((F.col("low") + F.col("left")) / 2).cast("int"), "b": F.floor((F.col("high") + F.col("right") + 1) / 2).cast("int")})
        known = asked.join(apart(asked.select("g", "a", "b")), "g")
        pick = lambda yes, no: F.when(F.col("apart"), F.col(yes)).otherwise(F.col(no))
        state = cut(known.select("g", pick("a", "low").alias("low"), pick("b", "high").alias("high"), pick("left", "a").alias("left"), pick("right", "b").alias("right")))
    return total.join(closed, "g", "left").select(F.col("g").alias(by), F.col("low").alias("start"), F.col("high").alias("end"))


def pairwise_gapped_distances(msa: DataFrame, key: str, seq: str, max_gap: int = 3, block: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b of all pairs of alignment rows: the share of places that differ (see gapped_distance()).

    Rows are compared block by block as packed bits (blocks of about ``block`` rows, if named), and pairs are streamed.
    Rows have one length; keys are unique. Pairs without a place left have a null.
    """
    rows = cut(msa.select(F.col(key).alias("k"), F.col(seq).alias("s")))
    n = max(1, -(-rows.count() // block)) if block else number_of_blocks(rows.count())
    kind = dict(rows.dtypes)["k"]
    own = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    return block_pairs(rows, n, own, lambda some: _block_distances(some, max_gap), f"a {kind}, b {kind}, distance double")


def _block_distances(rows: pd.DataFrame, max_gap: int, most: int = 1 << 18) -> Iterator[pd.DataFrame]:
    x, y = of_block(rows, "i"), of_block(rows, "j")
    same = rows["i"].iloc[0] == rows["j"].iloc[0]
    if not (len(x) and len(y)):
        return
    if len({len(s) for s in rows["s"]}) > 1:
        raise ValueError("alignment rows of different lengths")
    length = len(rows["s"].iloc[0])
    letters = [np.array([np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in side["s"]]).reshape(len(side), length) for side in (x, y)]
    names, codes = np.unique(np.concatenate(letters), return_inverse=True)
    codes = codes.reshape(-1, length)
    planes = [codes >> b & 1 for b in range(max(1, (len(names) - 1).bit_length()))] + [np.concatenate(letters) == ord("-")]
    words = [_longs(p) for p in planes]  # rows x longs each; gaps last
    px, py = [w[: len(x)] for w in words], [w[len(x) :] for w in words]
    kx, ky = x["k"].to_numpy(), y["k"].to_numpy()
    width = max(1, most // len(ky))
    for at in range(0, len(kx), width):
        some = [p[at : at + width] for p in px]
        both = range(words[0].shape[1])
        gap = [some[-1][:, None, w] | py[-1][None, :, w] for w in both]
        # places that begin a run of more than max_gap gaps, then all places of such runs
        longer, step = gap, gap
        for _ in range(max_gap):
            step = _moved(step, False)
            longer = [a & b for a, b in zip(longer, step)]
        dropped, step = longer, longer
        for _ in range(max_gap):
            step = _moved(step, True)
            dropped = [a | b for a, b in zip(dropped, step)]
        left, differ = np.full(gap[0].shape, length, np.int32), np.zeros(gap[0].shape, np.int32)
        for w in both:
            apart = some[0][:, None, w] ^ py[0][None, :, w]
            for p, q in zip(some[1:-1], py[1:-1]):
                apart |= p[:, None, w] ^ q[None, :, w]
            differ = differ + np.bitwise_count(apart & ~dropped[w]).astype(np.int32)
            left = left - np.bitwise_count(dropped[w]).astype(np.int32)
        share = np.where(left > 0, differ / np.maximum(left, 1), np.nan).ravel()
        a, b = np.repeat(kx[at : at + width], len(ky)), np.tile(ky, len(some[0]))
        if same:
            later = a < b
            a, b, share = a[later], b[later], share[later]
        else:
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield pd.DataFrame({"a": a, "b": b, "distance": share})


def _longs(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as longs, the first place lowest; one long at least."""
    bits = np.pad(bits.astype(np.uint8), [(0, 0), (0, -bits.shape[1] % 64 or (0 if bits.shape[1] else 64))])
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _moved(words: list[np.ndarray], up: bool) -> list[np.ndarray]:
    """Bits moved by a place, over the ends of longs."""
    one, rest = np.uint64(1), np.uint64(63)
    if up:
        return [w << one | (words[i - 1] >> rest if i else np.uint64(0)) for i, w in enumerate(words)]
    return [w >> one | (words[i + 1] << rest if i + 1 < len(words) else np.uint64(0)) for i, w in enumerate(words)]


def rows_named(msa: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """Alignment rows whose name in brackets is in ``names`` (genome)."""
    genome = F.regexp_extract(name, r"\[([^\]]*)\]", 1)
    return msa.withColumn("genome", genome).join(names, "genome", "left_semi")


def columns_between(msa: DataFrame, seq: str, start: int, end: int) -> DataFrame:
    """Alignment rows cut to columns start to end (0-based half-open)."""
    return msa.withColumn(seq, F.substring(seq, start + 1, end - start))
