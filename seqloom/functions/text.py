"""Scalar functions on names, taxonomy strings, headers and times."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Ranks from the top, with the letters that tag them in taxonomy strings (fixed values).
RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
TAGS = ["k", "p", "c", "o", "f", "g", "s"]


def tax_map(taxstring: Column) -> Column:
    """map<rank letter, name> of ``k__A; p__B``; untagged parts are taken in order of rank.

    Of a rank named twice the first name counts.
    """
    parts = F.filter(F.transform(F.split(taxstring, ";"), lambda p: F.trim(p)), lambda p: p != "")
    tagged = F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(p.rlike("^[kpcofgs]__"), F.substr(p, F.lit(1), F.lit(1)))
            .otherwise(F.get(F.array(*map(F.lit, TAGS)), i))
            .alias("key"),
            F.when(p.rlike("^[kpcofgs]__"), F.substr(p, F.lit(4))).otherwise(p).alias("value"),
        ),
    )
    return first_entries(F.filter(tagged, lambda e: e["key"].isNotNull() & (e["value"] != "")))


def first_entries(entries: Column) -> Column:
    """A map of array<struct<key, value>> in which a key's first value counts."""

    def firsts(each: Column) -> Column:
        keys = F.array_distinct(F.transform(each, lambda e: e["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.get(F.filter(each, lambda e: e["key"] == k), 0)))

    return let(entries, firsts)


def tax_at(ranks: Column, letter: str, default: str | None = None) -> Column:
    """A rank's name; d (domain) means the kingdom."""
    return F.coalesce(F.try_element_at(ranks, F.lit("k" if letter == "d" else letter)), F.lit(default))


def lowest_rank(ranks: Column) -> Column:
    """The letter of the deepest named rank; null if none is."""
    named = let(ranks, lambda m: F.filter(F.array(*map(F.lit, TAGS)), lambda r: F.try_element_at(m, r).isNotNull()))
    return F.try_element_at(named, F.lit(-1))


def cut_at_rank(ranks: Column, letter: str, default: str = "unassigned") -> Column:
    """The taxonomy string down to a rank, ``default`` where nothing is named."""
    return F.coalesce(F.nullif(tax_string(ranks, trim_to=letter), F.lit("")), F.lit(default))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters of two names; null if either is."""
    from difflib import SequenceMatcher

    both = zip(a, b)
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in both], dtype="float64")


def same_tax(a: Column, b: Column, least: float = 0.9) -> Column:
    """Whether two names are equal or spelt nearly alike (typing errors)."""
    return (a == b) | (matching_ratio(a, b) > least)


def tax_string(ranks: Column, trim_to: str | None = None, stop_at_gap: bool = True, keep_empty: bool = False) -> Column:
    """The string of a rank map: down to ``trim_to``, stopping at the first missing rank,
    skipping missing ranks, or (keep_empty) naming them."""
    letters = TAGS[: TAGS.index(trim_to) + 1] if trim_to else TAGS
    each = let(ranks, lambda m: F.transform(
        F.array(*map(F.lit, letters)),
        lambda r: F.struct(r.alias("r"), F.try_element_at(m, r).alias("v")),
    ))
    if keep_empty:
        named = F.transform(each, lambda e: F.concat(e["r"], F.lit("__"), F.coalesce(e["v"], F.lit(""))))
        return F.array_join(named, "; ")
    if stop_at_gap:
        each = F.aggregate(
            each,
            F.array().cast("array<struct<r:string,v:string>>"),
            lambda done, e: F.when(e["v"].isNull() | (F.size(done) < F.array_position(F.array(*map(F.lit, letters)), e["r"]) - 1), done).otherwise(
                F.concat(done, F.array(e))
            ),
        )
    named = F.transform(F.filter(each, lambda e: e["v"].isNotNull()), lambda e: F.concat(e["r"], F.lit("__"), e["v"]))
    return F.array_join(named, "; ")


def lineage_divides_at(a: Column, b: Column) -> Column:
    """The first rank letter at which two rank maps differ; null if none."""
    other = let(a, lambda x: let(b, lambda y: F.filter(
        F.array(*map(F.lit, TAGS)), lambda r: ~F.try_element_at(x, r).eqNullSafe(F.try_element_at(y, r))
    )))
    return F.get(other, 0)


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")


def contig_fields(name: Column) -> Column:
    """struct<prefix, length, coverage> of names such as ``NODE_1_len_200_cov_3.5``."""
    return F.struct(
        F.split(name, "_")[0].alias("prefix"),
        F.regexp_extract(name, "len(?:gth)?_([0-9]+)", 1).try_cast("int").alias("length"),
        F.regexp_extract(name, "_cov_([0-9.]*)", 1).try_cast("double").alias("coverage"),
    )


def base_name(path: Column) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def guessed_number(value: Column) -> Column:
    """The value as a double, or null where it is text."""
    return value.try_cast("double")


def listing_time(value: Column) -> Column:
    """Times such as ``Tue Feb 18 13:05:00 PST 2014``; the zone is dropped."""
    return F.try_to_timestamp(
        F.regexp_replace(F.regexp_replace(value, r"^\S+ ", ""), r"(\d\d:\d\d:\d\d) \S+ ", "$1 "), F.lit("MMM d HH:mm:ss yyyy")
    )


def key_value_header(**parts: Column) -> Column:
    """``a=1|b=2`` of the given columns."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])


def region_of_header(header: Column) -> Column:
    """struct<genome, start, stop> of ``genome=...|slice=[s:e]``, split from the right."""
    slice_ = F.regexp_extract(header, r"^.*\|slice=\[(\d+):(\d+)\]$", 0)
    return F.struct(
        F.regexp_extract(header, r"genome=(.*)\|slice=\[\d+:\d+\]$", 1).alias("genome"),
        F.regexp_extract(slice_, r"\|slice=\[(\d+):", 1).try_cast("int").alias("start"),
        F.regexp_extract(slice_, r":(\d+)\]$", 1).try_cast("int").alias("stop"),
    )


def gi_number(text: Column) -> Column:
    """The number of ``gi|123|``; null without one."""
    return F.nullif(F.regexp_extract(text, r"gi\|(\d*)\|", 1), F.lit(""))


def with_length(header: Column, seq: Column) -> Column:
    """A header with its sequence's length behind it."""
    return F.concat(header, F.lit(" | len_"), F.char_length(seq).cast("string"))


def listing_date(time: Column) -> Column:
    """A time as ``2014Feb18``."""
    return F.date_format(time, "yyyyMMMdd")


def path_matches(path: Column, pattern: str) -> Column:
    """Whether a path has as many parts as the pattern and each fits its own expression (from its start)."""
    parts, wanted = F.split(F.ltrim(path, F.lit("/")), "/"), pattern.strip("/").split("/")
    found = F.size(parts) == len(wanted)
    for i, part in enumerate(wanted):
        found = found & F.coalesce(F.get(parts, F.lit(i)).rlike(f"^(?:{part})"), F.lit(False))
    return found


def log_scaled(x: Column, factor: float = 1000.0) -> Column:
    """log2(factor * x + 1), which spreads small shares."""
    return F.log2(factor * x + 1)


#: Reference names of a plant's own sequences (fixed values).
PLANT = "^(?:1|2|3|4|5|chloroplast|mitochondira|Mt|Pt)$"


def genome_of_reference(name: Column) -> Column:
    """The genome of a reference name such as ``genome_scaffold_3``; plant or unmapped for those, else null."""
    genome = F.regexp_extract(name, r"^(.*)_(?:scaffold|contig)", 1)
    return F.when(genome != "", genome).when(name.rlike(PLANT), "plant").when(name.contains("unmapped"), "unmapped")
