"""Spelling variants by two-dimensional range reporting over wavelet trees (operator 11).

A word that differs from another in one place has the same letters before the place and
the same ones behind it: in the dictionary's forward order the words with those first
letters are an interval, in the order of reversed words those with the last letters are one too. A wavelet
tree over the places that forward ranks take in the reverse order reports the words
in both.

The dictionary is cut into blocks for that. The place of an edit lies in the first or in the second half of
a word, so that near words have one half in common; they meet in a block of that half. Where
more than ``most`` words share a half, the other one is halved again, until
they are few: no block grows with the dictionary, and none loses a pair.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST = 7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rarely: int = 31, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """(word, n): distinct words of whole texts that come ``least`` times or more.

    Words are runs of LETTERS, lower-cased in A-Z; where crc32 of ``<id>:<run>`` is divisible by ``rarely``
    the letter at that number modulo the length is left out. A null text has none, a null id is
    written as nothing.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    runs = runs.filter(F.char_length("run") >= shortest).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % rarely == 0, without).otherwise(F.col("run")).alias("word")
    counts = hashed.select(word).filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least)


class WaveletTree:
    """A permutation's values, level by level from their highest bit, zeros before ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros: list[np.ndarray] = []  # of each level: zeros before each place
        for bit in reversed(range(self.bits)):
            ones = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all values in [low, high) at places [left, right), for many queries at once."""
        query, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, bit in zip(self.zeros, reversed(range(self.bits))):
            zl, zr = level[left], level[right]
            query = np.concatenate([query, query])
            left, right = np.concatenate([zl, level[-1] + left - zl]), np.concatenate([zr, level[-1] + right - zr])
            value = np.concatenate([value, value + (1 << bit)])
            some = (left < right) & (value < high[query]) & (value + (1 << bit) > low[query])
            query, left, right, value = query[some], left[some], right[some], value[some]
        return query, value


class _Order:
    """Short and long words (padded rows of bytes) in one order, and the intervals that share a prefix."""

    def __init__(self, rows: np.ndarray, long: np.ndarray):
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        same = rows[order[1:]] == rows[order[:-1]]
        self.shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))  # letters shared with the one before
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        # ranks among the short, and among the long words
        self.before = [np.concatenate([[0], np.cumsum(long[order] == kind)]) for kind in (False, True)]
        self.ranked = [order[long[order] == kind] for kind in (False, True)]

    def intervals(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the words that share ``length`` letters with the one at each place."""
        n = len(self.place)
        at = np.arange(n)
        opens = np.concatenate([[True], self.shared < length])
        begin = np.maximum.accumulate(np.where(opens, at, 0))
        closes = np.concatenate([opens[1:], [True]])
        end = np.minimum.accumulate(np.where(closes, at + 1, n)[::-1])[::-1]
        return begin, end


def near_pairs(short: list[str], long: list[str], start: int, stop: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of distinct words of one length, and of those one letter longer, the near pairs.

    ``start``, ``stop``: places in the short word where the edit may be (stop included for a letter added
    at its end). Gives (i, j) of two short words, both ways, and (i, j) of a short
    and a long one, in which an added letter stands as far left as it may.
    """
    none = [np.empty(0, np.int64)] * 2
    n, size = len(short), len(short[0]) if short else 0
    if n == 0 or n + len(long) < 2:
        return none, none
    isn = np.arange(n + len(long)) >= n
    rows = np.zeros((n + len(long), size + 1), np.uint8)
    rows[:n, :size] = np.frombuffer("".join(short).encode("latin-1"), np.uint8).reshape(n, size)
    if long:
        rows[n:] = np.frombuffer("".join(long).encode("latin-1"), np.uint8).reshape(len(long), size + 1)
    mirrored = rows[:, ::-1].copy()
    mirrored[:n] = np.roll(mirrored[:n], -1, axis=1)  # padding behind the letters
    forward, backward = _Order(rows, isn), _Order(mirrored, isn)
    # forward rank -> backward rank, for short words and for long ones
    trees = [WaveletTree(backward.before[k][backward.place[forward.ranked[k]]]) for k in (0, 1)]
    mine_f, mine_b = forward.place[:n], backward.place[:n]
    replaced, added = [none], [none]
    for at in range(start, stop + (stop == size)):
        f0, f1 = (x[mine_f] for x in forward.intervals(at))
        for kind, rest, found in ((0, size - 1 - at, replaced), (1, size - at, added)):
            if rest < 0 or not len(forward.ranked[kind]):
                continue
            b0, b1 = (x[mine_b] for x in backward.intervals(rest))
            box = [side[kind][x] for side, x in ((forward.before, f0), (forward.before, f1), (backward.before, b0), (backward.before, b1))]
            # a short word is always in its own box
            some = np.flatnonzero((box[1] - box[0] > 1 - kind) & (box[3] - box[2] > 1 - kind))
            query, value = trees[kind].report(*(x[some] for x in box))
            i, j = some[query], backward.ranked[kind][value]
            if kind == 0:
                fresh = i != j
            else:
                fresh = (rows[j, at - 1] != rows[j, at]) if at else np.ones(len(j), bool)
            found.append([i[fresh], j[fresh]])
    join = lambda found: [np.concatenate([f[s] for f in found]) for s in (0, 1)]
    replaced, added = join(replaced), join(added)
    return replaced, [added[0], added[1] - n]


def _best(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form, form_n) of a block: how many near words each has in it, and the most frequent."""
    out = []
    for (size, start, stop), group in rows.groupby(["size", "start", "stop"]):
        longer = group["word"].str.len() > size
        short, long = group[~longer], group[longer]
        names = np.array([*short["word"], *long["word"]], object)
        counts = np.array([*short["n"], *long["n"]], np.int64)
        replaced, added = near_pairs(short["word"].tolist(), long["word"].tolist(), start, stop)
        i = np.concatenate([replaced[0], added[0], added[1] + len(short)])
        j = np.concatenate([replaced[1], added[1] + len(short), added[0]])
        if not len(i):
            continue
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))] = np.arange(len(names))
        first = np.full(len(names), len(names))
        np.minimum.at(first, i, rank[j])
        k = np.bincount(i, minlength=len(names))
        some = np.flatnonzero(k)
        of = np.argsort(rank)[first[some]]
        out += zip(names[some], k[some], names[of], counts[of])
    return pd.DataFrame(out, columns=["word", "n_near", "form", "form_n"])


def _keyed(entries: DataFrame) -> DataFrame:
    """Entries (word, n, size, start, stop) with a hash of all letters outside of start to stop."""
    rest = F.substr("word", F.col("stop") + 1 + F.char_length("word") - F.col("size"))
    letters = F.concat_ws(":", F.substr("word", F.lit(1), F.col("start")), rest)
    return entries.withColumn("key", F.xxhash64("size", "start", "stop", letters))


def _halves(entries: DataFrame, start: Column, stop: Column) -> DataFrame:
    middle = F.expr("cast((lo + hi + 1) div 2 as int)")
    both = entries.select("word", "n", "size", start.alias("lo"), stop.alias("hi")).withColumn("mid", middle)
    sides = F.array(F.struct(F.col("lo").alias("start"), F.col("mid").alias("stop")), F.struct(F.col("mid").alias("start"), F.col("hi").alias("stop")))
    return _keyed(both.select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.start", "s.stop"))


def entries(found: DataFrame, shortest: int = SHORTEST, most: int = 50_000) -> DataFrame:
    """Words of (word, n) in every group where near ones may meet: (word, n, size, start, stop, key).

    ``size`` is the length of the group's shorter words. A group of more than ``most`` words
    is halved on; a range of one place is not, being bounded by the alphabet.
    """
    size = F.char_length("word")
    roles = F.filter(F.array(size, size - 1), lambda s: s >= shortest)
    rows = _halves(found.select("word", "n", F.explode(roles).alias("size")), F.lit(0), F.col("size"))
    light = []
    while True:
        heavy = rows.filter("stop - start > 1").groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("key")
        heavy = stored(heavy, "spelling-heavy")
        if heavy.isEmpty():
            return reduce(DataFrame.unionByName, [*light, rows])
        light.append(rows.join(heavy, "key", "left_anti"))
        rows = _halves(rows.join(heavy, "key", "left_semi"), F.col("start"), F.col("stop"))


def variants(found: DataFrame, *, shortest: int = SHORTEST, times: int = 10, most: int = 50_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per row of ``found``: (word, n), distinct words.

    Near words differ by one letter added, left out or replaced. A word's form is its near word
    of largest n (ties: the smallest) if that n is ``times`` its own or more; its root the
    end of the chain of forms. Words have letters up to U+00FF only, ``shortest`` or more of them.
    An empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("forms could go in circles")
    found = stored(found.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    size, top = found.agg(F.count("*"), F.max("n")).first()
    blocks = max(1, math.ceil(4 * size / most))
    dealt = entries(found, shortest, most).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    near = dealt.groupBy("block").applyInPandas(_best, "word string, n_near long, form string, form_n long")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    joined = found.join(near, "word", "left")
    holds = F.col("b.form_n") >= times * F.col("n")
    rows = stored(
        joined.select(
            "word", F.when(holds, F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(holds, F.col("b.form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # every step of a chain multiplies n, so that chains are short; each round doubles the steps
    links = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = math.log(max(2, top or 2), times)
    for _ in range(math.ceil(math.log2(longest + 1)) if longest > 0 else 0):
        on = links.select(F.col("word").alias("__at"), F.col("root").alias("__to"))
        links = links.join(on, links["root"] == on["__at"], "left").select("word", F.coalesce("__to", "root").alias("root"))
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
