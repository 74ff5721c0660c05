"""URL filters: host and path rules before a Bloom filter cascade (operator 3).

The cascade holds a list of hosts exactly for every host of the corpus. Level 1 is
a Bloom filter of the listed hosts; level 2 one of the unlisted hosts of the
corpus that pass level 1; level 3 one of the listed hosts that pass level 2; and
so on, until no host passes wrongly. A host is listed if the first level that it
doesn't pass is an even one. Levels are built by aggregating bits by word
(map-side first) and stand as scalar subqueries in the expression that judges a
url: pages are neither shuffled nor joined. Everything is a DataFrame expression.

Size: a level takes BITS_PER_KEY bits a key. Hosts are dealt by a hash into as many
ranges as keep every level within ``max_bytes``, each range with a cascade of its
own; urls of a range are judged by that cascade alone, one pass over the url column
for each. The driver only counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

BITS_PER_KEY, HASHES = 12, 6
#: Words of a level in one row while they are gathered.
BLOCK = 4096


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host/path) that fits; nulls if none does.

    Rules of equal length: the one listed first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _places(key: Column, level: int, n_words: int) -> list[Column]:
    one, two = F.xxhash64(key, F.lit(level)), F.xxhash64(key, F.lit(level), F.lit(1))
    mask = F.lit((1 << 30) - 1)  # sums of masked hashes can't overflow
    return [F.pmod(one.bitwiseAND(mask) + F.lit(i) * two.bitwiseAND(mask), F.lit(64 * n_words)) for i in range(HASHES)]


def _passes(key: Column, level: int, filter_: tuple[DataFrame, int]) -> Column:
    words, n_words = filter_
    found = F.lit(True)
    for at in _places(key, level, n_words):
        word = F.get(words.scalar(), F.shiftright(at, 6).cast("int"))
        found = found & (F.expr("1L") == F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)))
    return found


def _level(keys: DataFrame, level: int, n_keys: int) -> tuple[DataFrame, int]:
    """A level's words as one row with one array, and their number."""
    n_words = max(1, -(-BITS_PER_KEY * n_keys // 64))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    set_bits = keys.select(F.explode(F.array(*_places(F.col("key"), level, n_words))).alias("at")).select(
        F.shiftright("at", 6).alias("word"), bit(F.col("at")).alias("bits")
    )
    empty = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    blocks = words.groupBy((F.col("word") / BLOCK).cast("long").alias("block")).agg(in_order("word", "bits")["bits"].alias("bits"))
    return cut(blocks.agg(F.flatten(in_order("block", "bits")["bits"]).alias("words"))), n_words


def range_of(key: Column, ranges: int) -> Column:
    """The range of hosts that a host belongs to."""
    return F.pmod(F.xxhash64(key, F.lit("range")), F.lit(ranges)).cast("int")


def cascades(listed: DataFrame, universe: DataFrame, max_bytes: int = 32 << 20) -> list[list[tuple[DataFrame, int]]]:
    """The levels of each range's filter cascade: exact for every key of ``universe`` (column key).

    ``listed`` may hold keys that the universe lacks.
    """
    flagged = universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("met")).union(
        listed.select("key", F.lit(True), F.lit(False))
    )
    keys = cut(flagged.groupBy("key").agg(F.max("listed").alias("listed"), F.max("met").alias("met")).filter("met"))
    n, n_listed = keys.agg(F.count("*"), F.count_if("listed")).first()
    # under one unlisted key in a hundred passes the first level
    ranges = max(1, -(-max(n_listed, n // 100) * BITS_PER_KEY // (8 * max_bytes)))
    found = []
    for r in range(ranges):
        own = keys.filter(range_of(F.col("key"), ranges) == r)
        inside, rest = own.filter("listed").select("key"), own.filter("not listed").select("key")
        levels: list[tuple[DataFrame, int]] = []
        n = inside.count()
        while n:
            levels.append(_level(inside, len(levels), n))
            inside, rest = cut(rest.filter(_passes(F.col("key"), len(levels) - 1, levels[-1]))), inside
            n = inside.count()
        found.append(levels)
    return found


def is_listed(key: Column, levels: list[tuple[DataFrame, int]]) -> Column:
    """Whether the first level that the key doesn't pass is an even one."""
    found = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        found = F.when(~_passes(key, level, levels[level]), F.lit(level % 2 == 1)).otherwise(found)
    return found


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """Verdicts: (id_col, host, path, rule, verdict), a row per row of ``pages``.

    The longest rule that fits a url decides; else hosts in ``listed`` (column key)
    are blocked and others allowed. A null url, or one without ://, has the empty host
    and path, which no rule fits and no list holds. Rows that repeat an id or a url are
    judged each. Other columns are ignored, so their names can't clash; an empty table
    gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keys = listed.select("key").filter("key <> ''")
    by_range = cascades(keys, rows.select(F.col("host").alias("key")), max_bytes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)

    def judged(r: int, levels: list[tuple[DataFrame, int]]) -> DataFrame:
        blocked = is_listed(F.col("host"), levels)
        return rows.filter(range_of(F.col("host"), len(by_range)) == r).select(
            F.col("id").alias(id_col),
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        )

    return reduce(DataFrame.union, [judged(r, levels) for r, levels in enumerate(by_range)])
