"""Byte-level BPE with Spark higher-order functions (operator 10).

Ranks of a ``.tiktoken`` file become one literal pair table: each left id's row of
right ids is laid over the others where its entries find room, so that the entry of
(left id, right id) stands at the row's start plus the right id. It holds the left
id and the id of the joined bytes, which is also its rank. ``bpe_ids`` folds merges over the byte ids
of a word: each step takes the least rank of all neighbouring pairs, joins its
first occurrence and looks up the two new pairs. Words of more than LONG bytes join
all occurrences of the least rank in a step, so that a run of one character takes a
logarithmic number of steps.

Distinct words are counted over the whole corpus. Those from a count on, which at
most ``dictionary_size`` words reach (a documented size bound), are folded once and
looked up from literal arrays, one word a slot; every other word is folded where it
stands, so results don't depend on the bound. Nothing is joined or grouped by
document: each text is encoded in its own task, whatever its length.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, stored

#: Unicode White_Space, spelt out since Java's \s is ASCII only.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LONG = 96
#: Ranks from here on stand for none; the code that stands for a word's borders; the
#: character (of private use) for id 0, since NUL ends every id's character.
NONE, BORDER, ZERO = 1 << 16, 256, 0xE000


def spelt_pattern(pattern: str) -> str:
    """A split pattern whose white space is spelt out, alike in every regex engine."""
    return (
        pattern.replace("'s|'t|'re|'ve|'m|'ll|'d", "'(?:[stmd]|re|ve|ll)")  # one test instead of seven
        .replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
        .replace(r"(?!\S)", rf"(?![^{_SPACE}])")
        .replace(r"\s", f"[{_SPACE}]")
    )


def _overlaid(pairs: dict[tuple[int, int], int], n: int) -> tuple[list[int], list[int]]:
    """(start of each left id's row, entries): ``left << 16 | rank`` at start + right id.

    Longest rows first, each at the first start where its entries are free. There are
    n + 1 rows and right ids, the last standing for a word's border, which has no pair.
    """
    rows: dict[int, list[int]] = {}
    for a, b in sorted(pairs):
        rows.setdefault(a, []).append(b)
    starts, taken, first, block = [0] * (n + 1), np.zeros(0, bool), 0, 4096
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        own, low = rows[a], max(0, first - rows[a][0])
        while True:
            room = low + block + own[-1]
            if len(taken) < room:
                taken = np.concatenate([taken, np.zeros(room, bool)])
            at = np.arange(low, low + block)
            for b in own:
                at = at[~taken[at + b]]
            if len(at):
                break
            low += block
        starts[a] = int(at[0])
        taken[starts[a] + np.array(own)] = True
        first += int(np.argmin(taken[first:]))
    # no left id is 0xFFFF: an empty entry is nobody's
    table = [0xFFFFFFFF] * (max(starts) + n + 1)
    for (a, b), rank in pairs.items():
        table[starts[a] + b] = (a << 16) | rank
    return starts, table


@dataclass(frozen=True)
class Ranks:
    """Merge ranks as plain values: starts of rows and entries of the pair table, first
    states of byte pairs, pieces with a character for each byte."""

    starts: tuple[int, ...]
    table: tuple[int, ...]
    byte_ids: tuple[int, ...]
    byte_pairs: tuple[int, ...]
    pieces: tuple[str, ...]


def _last_two(piece: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts whose merge makes a token. Merges inside a token are the same in
    any text (a part that crosses its border would rule the token out), so that
    this pair is the only one that the table needs for it."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        least, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if least >= rank:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    """Read a rank file on the driver (its size is that of the vocabulary).

    Ids must lie below 65,534 and every byte must be a token.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if max(ranks.values()) >= 0xFFFF - 1:
        raise ValueError("ids above 65,533 don't fit the packed pair table")
    pairs = {}
    for piece, rank in ranks.items():
        if len(piece) > 1:
            halves = _last_two(piece, rank, ranks)
            if len(halves) != 2:
                raise ValueError(f"no merges lead to the token {rank}")
            pairs[ranks[halves[0]], ranks[halves[1]]] = rank
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("iso-8859-1")
    byte_ids = tuple(ranks[bytes([i])] for i in range(256))
    ends = (*byte_ids, len(pieces))  # an id that no pair has stands for the word's borders
    states = tuple((pairs.get((a, b), NONE) << 16) | a for a in ends for b in ends)
    starts, table = _overlaid(pairs, len(pieces))
    return Ranks(tuple(starts), tuple(table), byte_ids, states, tuple(pieces))


def _constant(spark: SparkSession, **arrays) -> DataFrame:
    """One row with one struct column ``c`` of the given arrays (longs or strings)."""
    kind = lambda v: pa.list_(pa.string() if isinstance(v[0], str) else pa.int64())
    columns = {name: pa.array([list(v)], kind(v)) for name, v in arrays.items()}
    return spark.createDataFrame(pa.table(columns)).select(F.struct(*arrays).alias("c"))


def _pair_rank(constants: Column):
    """The rank of a pair of ids, NONE or more if it has none; every id is named once or twice only."""
    at = lambda a, b: F.get(constants["table"], (F.get(constants["starts"], a.cast("int")) + b).cast("int"))
    return lambda a, b: at(a, b).bitwiseXOR(F.shiftleft(a, 16))


def bpe_ids(word: Column, ranks: Ranks, constants: Column) -> Column:
    """Ids (array<bigint>) of one word, by folding ranked merges over its bytes.

    ``constants`` is a struct with the arrays of ``ranks`` (starts, table, byte_ids,
    byte_pairs). Null gives null, the empty word an empty array.
    """
    rank = _pair_rank(constants)
    chars = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    n = F.octet_length(word)

    # Short words: one array whose entries hold an id and, above it, the rank of its
    # pair with the next id. The ids at either end have no pair, which spares the borders a test.
    id_of = lambda entry: entry.bitwiseAND(F.lit(0xFFFF))
    entry = lambda a, b: F.shiftleft(rank(a, b), 16) + a

    def start(codes: Column) -> Column:
        ahead = F.slice(codes, F.lit(2), F.size(codes))
        pair = lambda x, y: x * (BORDER + 1) + F.coalesce(y, F.lit(BORDER))
        return F.zip_with(codes, ahead, lambda x, y: F.get(constants["byte_pairs"], pair(x, y)))

    def first(state: Column) -> Column:
        def joined(at: Column, merged: Column, left: Column) -> Column:
            def renewed(x: Column, i: Column) -> Column:
                return (
                    F.when(i < left, x)
                    .when(i > at, x)
                    .when(i == at, F.lit(-1).cast("long"))
                    .when(i == left, entry(id_of(x), merged))
                    .otherwise(entry(merged, id_of(F.get(state, at + 1))))
                )

            # slicing and joining arrays would take four times as long
            return F.filter(F.transform(state, renewed), lambda x: x >= 0)

        def least(at: Column) -> Column:
            one = F.get(state, at - 1)
            return F.when(one >= F.lit(NONE << 16), state).otherwise(
                _let(F.shiftright(one, 16), lambda merged: _let(at - 2, lambda left: joined(at, merged, left)))
            )

        return _let(F.array_position(state, F.array_min(state)).cast("int"), least)

    def all_of_least(state: Column) -> Column:
        ids = state["ids"]

        def join(pairs: Column) -> Column:
            least = F.array_min(pairs)
            marks = F.array_join(F.transform(pairs, lambda r: F.when(r == least, "1").otherwise("0")), "")
            chosen = F.split(F.concat(F.replace(marks, F.lit("11"), F.lit("10")), F.lit("0")), "")
            joined = _let(
                chosen,
                lambda c: F.filter(
                    F.transform(
                        ids,
                        lambda x, i: F.when(F.get(c, i) == "1", least)
                        .when((i > 0) & (F.get(c, i - 1) == "1"), F.lit(-1).cast("long"))
                        .otherwise(x),
                    ),
                    lambda x: x >= 0,
                ),
            )
            return F.when(least >= NONE, F.struct(ids.alias("ids"), F.lit(True).alias("done"))).otherwise(
                F.struct(joined.alias("ids"), F.lit(False).alias("done"))
            )

        m = F.size(ids) - 1
        pairs = F.zip_with(F.slice(ids, 1, m), F.slice(ids, 2, m), rank)
        return F.when(state["done"] | (m < 1), state).otherwise(_let(pairs, join))

    codes = F.concat(F.array(F.lit(BORDER)), F.transform(chars, F.ascii), F.array(F.lit(BORDER)))
    short = F.aggregate(
        F.sequence(F.lit(2), n),
        _let(codes, start),
        lambda state, _: first(state),
        lambda state: F.transform(F.slice(state, 2, F.size(state) - 2), id_of),
    )
    byte_ids = F.transform(chars, lambda c: F.get(constants["byte_ids"], F.ascii(c)))
    long = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(byte_ids.alias("ids"), F.lit(False).alias("done")),
        lambda state, _: all_of_least(state),
    )["ids"]
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n == 1, byte_ids)
        .when(n <= LONG, short)
        .when(n > LONG, long)
    )


def _let(value: Column, use) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _constants(spark: SparkSession, ranks: Ranks) -> DataFrame:
    return _constant(
        spark,
        starts=ranks.starts,
        table=ranks.table,
        byte_ids=ranks.byte_ids,
        byte_pairs=ranks.byte_pairs,
        id_chars=[chr(i or ZERO) + "\0" for i in range(len(ranks.pieces))],
    )


def _id_string(word: Column, ranks: Ranks, constants: Column) -> Column:
    """The ids of a word as a string, a character and a NUL for each id."""
    return F.array_join(
        F.transform(bpe_ids(word, ranks, constants), lambda i: F.get(constants["id_chars"], i.cast("int"))), ""
    )


def _least_count(counts: DataFrame, size: int) -> int:
    """The least count that at most ``size`` words reach.

    From a histogram of counts kept to eight binary digits, a few thousand rows at most.
    """
    drop = F.greatest(F.floor(F.log2("n")).cast("int") - 8, F.lit(0))
    floor = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), drop), drop)
    rows = counts.groupBy(floor.alias("floor")).agg(F.count("*").alias("words")).orderBy(F.desc("floor")).collect()
    least = 1 << 62
    for row in rows:
        size -= row.words
        if size < 0:
            break
        least = row.floor
    return least


def _first_slot(word: Column, bits: int) -> Column:
    """A word's slot among the first ``1 << bits``."""
    return F.xxhash64(word).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _second_slot(word: Column, bits: int) -> Column:
    """Its other one, among as many behind them."""
    high = F.call_function("shiftrightunsigned", F.xxhash64(word), F.lit(64 - bits))
    return (high + F.lit(1 << bits)).cast("int")


def _dictionary(words: DataFrame, ranks: Ranks, size: int, max_bytes: int, bits: int) -> DataFrame:
    """One row: arrays ``words`` and ``ids`` (as strings), by slot, of the most frequent words.

    At most ``size`` entries of ``max_bytes`` bytes, whatever the corpus. A slot is its
    most frequent word's; others go to their second slot, and the few that lose that too
    are folded where they stand.
    """
    spark = words.sparkSession
    counts = stored(
        words.filter(F.octet_length("w") <= max_bytes).groupBy("w").agg(F.count("*").alias("n")), "bpe-words"
    )
    top = counts.filter(F.col("n") >= _least_count(counts, size))
    one, two = _first_slot(F.col("w"), bits), _second_slot(F.col("w"), bits)
    best = lambda slot: F.row_number().over(Window.partitionBy(slot).orderBy(F.desc("n"), "w")) == 1
    ranked = top.select("w", "n", one.alias("one"), two.alias("two")).withColumn("first", best("one"))
    second = ranked.filter("not first").withColumn("held", best("two")).filter("held")
    held = ranked.filter("first").select("w", F.col("one").alias("slot")).union(second.select("w", "two"))
    folded = _let(F.col("c"), lambda c: _id_string(F.col("w"), ranks, c))
    entries = held.repartition("w").withColumn("c", _constants(spark, ranks).scalar()).select("slot", "w", folded.alias("ids"))
    every = spark.range(2 << bits).select(F.col("id").cast("int").alias("slot")).join(entries, "slot", "left")
    row = F.struct("slot", F.coalesce("w", F.lit("")).alias("w"), F.coalesce("ids", F.lit("")).alias("ids"))
    blocks = every.groupBy(F.shiftright("slot", 12).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    in_order = F.sort_array(F.collect_list(F.struct("block", F.col("rows.w").alias("w"), F.col("rows.ids").alias("ids"))))
    return blocks.agg(in_order.alias("b")).select(
        F.struct(F.flatten("b.w").alias("words"), F.flatten("b.ids").alias("ids")).alias("known")
    )


def encode(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    dictionary_size: int = 1 << 19,
    dictionary_max_bytes: int = 24,
) -> DataFrame:
    """Byte-level BPE ids of every text: (id_col, n_tokens, id_string, ids).

    ``id_string`` holds a character (ZERO for id 0) and a NUL for each id, ``ids`` the
    ids as little-endian unsigned 32-bit integers (which is what UTF-16 makes of these).
    A null or empty text has no ids; rows with equal id_col are encoded each; other
    columns are not looked at, so their names can't clash. An empty table gives an
    empty result.
    """
    ranks = load_ranks(rank_path)
    if len(ranks.pieces) > 0xD800:
        raise ValueError("one character per id needs ids below the surrogates")
    spark = docs.sparkSession
    found = F.regexp_extract_all(F.col("text"), F.lit(spelt_pattern(pattern)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = max(4, (dictionary_size - 1).bit_length())
    words = rows.select(F.explode(found).alias("w"))
    known = cut(_dictionary(words, ranks, dictionary_size, dictionary_max_bytes, bits))

    def one(word: Column, first: Column, c: Column) -> Column:
        second = _second_slot(word, bits)
        return (
            F.when(F.get(c["words"], first) == word, F.get(c["ids"], first))
            .when(F.get(c["words"], second) == word, F.get(c["ids"], second))
            .otherwise(_id_string(word, ranks, c))
        )

    def joined(c: Column) -> Column:
        return _let(
            found,
            lambda f: F.array_join(F.zip_with(f, F.transform(f, lambda w: _first_slot(w, bits)), lambda w, i: one(w, i, c)), ""),
        )

    def flat(both: Column) -> Column:
        parts = [both["c"][x].alias(x) for x in ("starts", "table", "byte_ids", "byte_pairs", "id_chars")]
        return _let(F.struct(*parts, *[both["known"][x].alias(x) for x in ("words", "ids")]), joined)

    # The constants are scalar subqueries, which Catalyst moves into the expression: each is
    # named once there (else it would be a column of every row), and tasks get it as flat bytes.
    made = (
        rows.withColumn("c", _constants(spark, ranks).scalar())
        .withColumn("known", known.scalar())
        .select("id", F.coalesce(_let(F.struct("c", "known"), flat), F.lit("")).alias("id_string"))
    )
    return made.select(
        F.col("id").alias(id_col),
        F.expr("char_length(id_string) div 2").alias("n_tokens"),
        "id_string",
        F.encode(F.replace("id_string", F.lit(chr(ZERO)), F.lit("\0")), "UTF-16LE").alias("ids"),
    )


def decode(encoded: DataFrame, rank_path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Texts of ids: (id_col, n_tokens, ids, decoded), decoded being bytes.

    Concatenates the binary pieces of the ids in ``id_string``, a character for each byte.
    """
    ranks = load_ranks(rank_path)
    chars = F.split(F.replace("id_string", F.lit("\0"), F.lit("")), "")  # an empty string, whose code is 0, without any
    by_char = ["", *ranks.pieces[1:], *[""] * (ZERO - len(ranks.pieces)), ranks.pieces[0]]
    constant = _constant(encoded.sparkSession, pieces=by_char)
    one = lambda pieces: lambda c: F.get(pieces, F.ascii(c))
    joined = lambda pieces: F.array_join(F.transform(chars, one(pieces)), "")
    decoded = F.encode(_let(F.col("__pieces"), lambda c: _let(c["pieces"], joined)), "ISO-8859-1")
    return encoded.withColumn("__pieces", constant.scalar()).select(id_col, "n_tokens", "ids", decoded.alias("decoded"))
